"""WARC archives with a globally ordered capture index.

Writing: every row becomes one record of a WARC/1.1 file, each record a gzip member of its own. Rows with equal
payloads (SHA-1, SHA-256 and length agree) are counted first, per payload and combined before the shuffle; the
row with the largest id keeps the payload as a ``response``, the others are ``revisit`` records that refer to
it. A task writes its files into the shared folder under names that no other attempt uses, and hands on the
captures of each file as runs of bounded length, sorted in the task by URL key, time and id. Only files named in
the written runs belong to the archive, so what a lost task left behind is never read.

Index: runs are dealt by key ranges, so that a hot URL is split by time and id. In each range a loser tree
merges the slices of all runs: the winning run gives all its captures up to the runner-up's at once. Ranges in
their order are the global order; a capture's number in its URL's history carries over from range to range.

Reading: a task reads whole files record by record, recomputes the digest of every payload and fails if one
differs; records and index entries meet by file and offset.

Defined results: a null text is an empty payload, which counts like any other. Rows with equal payload and the
largest id, given more than once, are all responses. A null id is smaller than any; where a payload has null ids
only, all are responses. A null URL has no target header and the empty key. Payloads below ``least_bytes`` are
all responses. Other columns are ignored; an empty table gives no rows and no files.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from lithos.llm.store import written
from lithos.llm.text import tidy
from lithos.session import ensure_checkpoint_dir

#: Bytes of a finished archive file; captures of a run; captures of a key range; bytes of the table of repeated
#: payloads that is broadcast at most.
FILE_BYTES, RUN_ROWS, RANGE_ROWS, BROADCAST_BYTES = 256 << 20, 50_000, 100_000, 32 << 20
_CHUNK = 1 << 16
_CRLF = b"\r\n"
# Names of the WARC/1.1 format.
_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "<urn:page:{}>"
_NO_TIME = "1970-01-01T00:00:00Z"


# ---- records -----------------------------------------------------------------------------------------------

def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _head(fields: list[tuple[str, str | None]]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None)


def _uri(value) -> str:
    return _ID.format("" if value is None else quote(str(value), safe=""))


def _of_uri(text: str) -> str | None:
    return unquote(text.removeprefix("<urn:page:").removesuffix(">")) or None


def record(kind: str, page, url: str | None, time: str, payload: bytes, refers_to=None) -> bytes:
    """One WARC record: a response holds the payload, a revisit only the head of the response."""
    http = b"HTTP/1.1 200 OK\r\n" + _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + _CRLF
    block = http + payload if kind == "response" else http
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _uri(page)), ("WARC-Date", time),
              ("WARC-Target-URI", None if url is None else quote(url, safe=";/?:@&=+$,-_.!~*'()#%[]")),
              ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
              ("WARC-Profile", _PROFILE if kind == "revisit" else None),
              ("WARC-Refers-To", _uri(refers_to) if kind == "revisit" else None),
              ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return _VERSION + _CRLF + _head(fields) + _CRLF + block + _CRLF + _CRLF


def info(time: str) -> bytes:
    """The record that opens a file."""
    block = b"software: lithos\r\nformat: WARC File Format 1.1\r\n"
    return _VERSION + _CRLF + _head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                                     ("WARC-Date", time), ("Content-Type", "application/warc-fields"),
                                     ("Content-Length", str(len(block)))]) + _CRLF + block + _CRLF + _CRLF


def packed(data: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of every gzip member of a stream, one at a time."""
    at, data = 0, stream.read(_CHUNK)
    while data:
        z, out, used = zlib.decompressobj(31), [], 0
        while True:
            out.append(z.decompress(data))
            used += len(data) - len(z.unused_data)
            if z.eof:
                break
            data = stream.read(_CHUNK)
            if not data:
                raise ValueError(f"the archive ends inside the record at {at}")
        yield at, b"".join(out)
        at += used
        data = z.unused_data or stream.read(_CHUNK)


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-case name, block) of one record."""
    head, _, rest = content.partition(_CRLF + _CRLF)
    lines = head.split(_CRLF)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record")
    fields = {}
    for line in lines[1:]:
        k, _, v = line.partition(b":")
        fields[k.strip().lower().decode()] = v.strip().decode()
    n = int(fields["content-length"])
    if len(rest) < n:
        raise ValueError("a record is shorter than its length")
    return fields, rest[:n]


def read_back(content: bytes) -> tuple[str, str | None, int, str, str | None] | None:
    """(type, id, payload bytes, payload digest, id referred to) of a record; None for other records. A payload
    that does not have its digest is an error."""
    fields, block = parsed(content)
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    head, _, payload = block.partition(_CRLF + _CRLF)
    length = next(int(line.split(b":")[1]) for line in head.split(_CRLF) if line.lower().startswith(b"content-length:"))
    said = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or digest(payload) != said):
        raise ValueError(f"record {fields['warc-record-id']}: the payload is not the one its digest names")
    refers = _of_uri(fields["warc-refers-to"]) if kind == "revisit" else None
    return kind, _of_uri(fields["warc-record-id"]), length, said, refers


def url_key(url: str | None) -> str:
    """Sortable key of a URL: host labels reversed, without scheme, ``www``, default port and fragment; query
    arguments in order; what is no URL stays as it is."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname, parts.port
    except ValueError:
        return url
    if not host:
        return url
    labels = host.split(".")
    if labels[0] == "www" and len(labels) > 2:
        labels = labels[1:]
    default = {"http": 80, "https": 443}.get(parts.scheme.lower())
    key = ",".join(reversed(labels)) + (f":{port}" if port and port != default else "") + ")" + (parts.path.rstrip("/") or "/")
    return key + ("?" + "&".join(sorted(parts.query.split("&"))) if parts.query else "")


# ---- the loser tree ----------------------------------------------------------------------------------------

class LoserTree:
    """k sorted lists merged by a tree of losers: every inner node holds the loser of its match, node 0 the
    winner, so that a step replays one path from leaf to root."""

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.k = max(1, len(runs))
        self.tree = [-1] * self.k
        for leaf in range(len(runs)):
            self._replay(leaf, first=True)

    def _less(self, a: int, b: int) -> bool:
        """Whether run ``a`` comes before run ``b``; an ended run comes after all others."""
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        return self.runs[a][self.at[a]] < self.runs[b][self.at[b]]

    def _replay(self, winner: int, first: bool = False) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if first and other == -1:
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def spans(self) -> Iterator[tuple[int, int, int]]:
        """(run, from, to): what the winning run gives until the best of the others comes before it."""
        if not self.runs:
            return
        while True:
            run = self.tree[0]
            lo, entries = self.at[run], self.runs[run]
            if lo >= len(entries):
                return
            # the runner-up lost to the winner on its path
            node, second = (run + self.k) // 2, -1
            while node > 0:
                other = self.tree[node]
                if second == -1 or self._less(other, second):
                    second = other
                node //= 2
            if second == -1 or self.at[second] >= len(self.runs[second]):
                hi = len(entries)
            else:
                hi = max(lo + 1, bisect_right(entries, self.runs[second][self.at[second]], lo))
            yield run, lo, hi
            self.at[run] = hi
            self._replay(run)


# ---- Spark ---------------------------------------------------------------------------------------------------

def _opened(folder: str):
    """(file system, path) of the shared folder, whatever store it is in."""
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder.removeprefix("file:")
    return pafs.FileSystem.from_uri(folder)


def with_roles(rows: DataFrame, least_bytes: int) -> DataFrame:
    """``rows`` (id, url, text, time) with ``bytes`` and ``top``: the largest id of the rows with that payload,
    where there are several, else null."""
    rows = rows.withColumn("bytes", F.octet_length("text").cast("long"))
    rows = rows.withColumn("s1", F.unhex(F.sha1("text"))).withColumn("s2", F.unhex(F.sha2("text", 256)))
    key = ["s1", "s2", "bytes"]
    same = rows.where(F.col("bytes") >= least_bytes).groupBy(*key).agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
    same = written(same.where((F.col("n") > 1) & F.col("top").isNotNull()).select(*key, "top"), "payloads")
    small = same.count() * 100 <= BROADCAST_BYTES
    return rows.join(F.broadcast(same) if small else same, key, "left").drop("s1", "s2")


def archive(rows: DataFrame, id_col: str, url_col: str, text_col: str, time: Column, folder: str,
            least_bytes: int = 0) -> DataFrame:
    """Write one record for every row into WARC files in ``folder`` and return the captures in sorted runs:
    (run, seq, url_key, time, id, file, offset, length). ``time`` is the capture time (timestamp)."""
    kind = rows.schema[id_col].dataType.simpleString()
    plain = rows.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                        F.coalesce(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(_NO_TIME)).alias("time"))
    given = with_roles(plain, least_bytes)
    stored = "bigint" if kind in ("bigint", "int", "smallint", "tinyint") else "string"
    id_type = pa.int64() if stored == "bigint" else pa.string()
    given = given.withColumn("id", F.col("id").cast(stored)).withColumn("top", F.col("top").cast(stored))
    schema = pa.schema([("run", pa.string()), ("seq", pa.int64()), ("url_key", pa.string()), ("time", pa.string()),
                        ("id", id_type), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    now = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches):
        store, base = _opened(folder)
        out, name, size, held = None, "", 0, []

        def run() -> pa.RecordBatch:
            held.sort(key=_order)
            label = uuid.uuid4().hex
            columns = [[label] * len(held), range(len(held)), *zip(*held, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        try:
            for batch in batches:
                for page, url, text, time_, top in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "text", "time", "top")), strict=True):
                    if out is None or size >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                        size = out.write(packed(info(now)))
                    revisit = top is not None and page != top
                    data = packed(record("revisit" if revisit else "response", page, url, time_, text.encode(), top))
                    out.write(data)
                    held.append((url_key(url), time_, page, name, size, len(data)))
                    size += len(data)
                    if len(held) >= RUN_ROWS:
                        yield run()
        finally:
            if out is not None:
                out.close()
        if held:
            yield run()

    return written(given.select("id", "url", "text", "time", "top").mapInArrow(
        tidy(write), f"run string, seq long, url_key string, time string, id {stored}, file string, offset long, length long"), "runs")


def _order(capture: tuple):
    """Sort key of (url_key, time, id, file, offset, ...): the order of Spark's ranges."""
    key, time, page, file, offset = capture[:5]
    return key, time, page is not None, page, file, offset


def merged(runs: DataFrame) -> DataFrame:
    """The global index: all captures with ``position`` (0-based, by URL key, time and id) and ``capture``, the
    1-based number in the URL key's history."""
    order = ["url_key", "time", "id", "file", "offset"]
    spark = runs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    columns = ["url_key", "time", "id", "file", "offset", "length"]

    def merge(batches):
        # slices of the runs, each in its own order
        parts: list[list[tuple]] = []
        last = None
        for batch in batches:
            labels = batch.column("run").to_pylist()
            for label, capture in zip(labels, zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
                if label != last:
                    parts.append([])
                    last = label
                parts[-1].append(_order(capture) + (capture[5],))
        if not parts:
            return
        ends = min(p[0] for p in parts)[0], max(p[-1] for p in parts)[0]
        pid, local, key, number = TaskContext.get().partitionId(), 0, None, 0
        held: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            cols = [list(c) for c in zip(*held, strict=True)]
            held.clear()
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), id_type, pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                              names=["range", "local", "number", "edge", *columns])

        for run, lo, hi in LoserTree(parts).spans():
            for at in range(lo, hi):
                url, time, _, page, file, offset, length = parts[run][at]
                number = number + 1 if url == key else 1
                key = url
                held.append((pid, local, number, url in ends, url, time, page, file, offset, length))
                local += 1
            if len(held) >= 10_000:
                yield batch_of()
        if held:
            yield batch_of()

    stored = dict(runs.dtypes)["id"]
    id_type = pa.int64() if stored == "bigint" else pa.string()
    dealt = runs.repartitionByRange(n, *order).sortWithinPartitions("run", "seq")
    index = written(dealt.mapInArrow(tidy(merge), f"range int, local long, number long, edge boolean, url_key string, time string, "
                                                  f"id {stored}, file string, offset long, length long"), "index")
    # one row a range: how many captures come before it
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = index.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select(
        "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # two rows a range at most: captures of its first and last key in the ranges before
    earlier = Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = index.where("edge").groupBy("range", "url_key").agg(F.count(F.lit(1)).alias("n")).select(
        "range", "url_key", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("carry"))
    out = index.join(F.broadcast(starts), "range").join(F.broadcast(carried), ["range", "url_key"], "left")
    return out.select(*columns, (F.col("start") + F.col("local")).cast("long").alias("position"),
                      (F.col("number") + F.coalesce("carry", F.lit(0))).cast("long").alias("capture"))


def records(files: DataFrame, folder: str) -> DataFrame:
    """(file, offset, id, payload_bytes, payload_digest, record_type, refers_to) of all records of the archive
    files named in ``files`` (column ``file``); ids as text."""
    names = ["file", "offset", "id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def read(batches):
        store, base = _opened(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held = []
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for offset, content in members(stream):
                        found = read_back(content)
                        if found:
                            kind, page, length, said, refers = found
                            held.append((name, offset, page, length, said, kind, refers))
                        if len(held) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds, strict=True)], names=names)
                            held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds, strict=True)], names=names)

    n = max(1, files.count())
    return files.select("file").repartitionByRange(min(n, 10_000), "file").mapInArrow(
        tidy(read), "file string, offset long, id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def round_trip(rows: DataFrame, id_col: str, url_col: str, text_col: str, time: Column, least_bytes: int = 0) -> DataFrame:
    """Write archives, merge their index, read the archives back: (id_col, payload_bytes, payload_digest,
    record_type, refers_to, url_key, time, capture, position, file, offset) of every row, in no order."""
    kind = rows.schema[id_col].dataType.simpleString()
    folder = f"{ensure_checkpoint_dir(rows.sparkSession).rstrip('/')}/llm-warc-{uuid.uuid4().hex}"
    store, base = _opened(folder)
    store.create_dir(base, recursive=True)
    runs = archive(rows, id_col, url_col, text_col, time, folder, least_bytes)
    index = merged(runs).drop("id", "length")
    files = written(runs.select("file").distinct(), "files")
    # the records are as many as the rows, which Spark cannot tell from the list of files: no broadcast
    found = records(files, folder).hint("merge").join(index.hint("merge"), ["file", "offset"])
    return found.select(F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type",
                        F.col("refers_to").cast(kind).alias("refers_to"), "url_key", "time", "capture", "position", "file", "offset")
