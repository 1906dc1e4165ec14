"""WARC archives, the loser tree and the capture index against plain versions."""

import base64
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from lithos.llm import warc

SCHEMA = "page_id long, url string, html string, run string, file string, id long, position int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "r", "f", 3, 4) for i, u, h in rows], SCHEMA)


def plain(rows, least=0):
    top = {}
    count = {}
    for i, _, h in rows:
        b = (h or "").encode()
        count[b] = count.get(b, 0) + 1
        if i is not None:
            top[b] = max(i, top.get(b, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= least and count[b] > 1 and b in top and i != top[b]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response",
                    top[b] if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_loser_tree_merges_like_sort(seed):
    rng = random.Random(seed)
    runs = [sorted(rng.randrange(30) * 1000 + r for _ in range(rng.choice([0, 1, 5, 40]))) for r in range(rng.choice([0, 1, 2, 3, 7, 16, 33]))]
    got = [x for run, lo, hi in warc.LoserTree(runs).spans() for x in runs[run][lo:hi]]
    assert got == sorted(x for r in runs for x in r)


def test_loser_tree_takes_whole_spans():
    """Runs that do not overlap are taken in one step each."""
    assert list(warc.LoserTree([list(range(100, 200)), list(range(100)), []]).spans()) == [(1, 0, 100), (0, 0, 100)]


@pytest.mark.parametrize("url,key", [
    (None, ""), ("", ""), ("no url", "no url"), ("http://www.Example.com:80/a/?b=2&a=1#x", "com,example)/a?a=1&b=2"),
    ("https://example.com/", "com,example)/"), ("https://m.example.com:8080", "com,example,m:8080)/"),
    ("http://[broken", "http://[broken"), ("http://www.com/x", "com,www)/x")])
def test_url_key(url, key):
    assert warc.url_key(url) == key


def test_record_round_trip():
    payload = "a\r\n\r\nWARC/1.1\r\n\x00ü".encode()
    for kind, refers in (("response", None), ("revisit", "9>\r\n")):
        data = warc.record(kind, "7 \r\n>", "http://x/\r\nEvil: 1 ü", "2024-01-01T00:00:00Z", payload, refers)
        assert warc.read_back(data) == (kind, "7 \r\n>", len(payload), warc.digest(payload), refers)
        assert b"\r\nEvil" not in data
    broken = warc.record("response", 1, None, "t", payload).replace(b"WARC/1.1\r\n\x00", b"WARC/1.1\r\n\x01")
    with pytest.raises(ValueError):
        warc.read_back(broken)
    content = [b"x" * 200_000, b"", b"y"]
    stream = b"".join(map(warc.packed, content))
    found = list(warc.members(io.BytesIO(stream)))
    assert [c for _, c in found] == content
    assert all(gzip.decompress(stream[o:]) .startswith(c) for o, c in found)
    with pytest.raises((ValueError, Exception)):
        list(warc.members(io.BytesIO(stream[:-3])))


ROWS = [(i, f"http://h{i % 3}.example.com/p{i % 11}?b=1&a={i % 2}", f"<p>{i % 40}</p>") for i in range(300)] + [
    (300, None, None), (301, "", ""), (302, "http://h0.example.com/p0", None), (None, "http://x", "<p>3</p>"),
    (None, None, "only null"), (None, None, "only null"), (303, "http://long", "ä中 " * 400_000),
    (304, "http://twice", "same row"), (304, "http://twice", "same row"), (305, "http://nul", "a\x00b\r\n\r\n")]


@pytest.mark.parametrize("broadcast,least", [(1 << 25, 0), (0, 0), (1 << 25, 9)])
def test_round_trip_against_plain(spark, monkeypatch, broadcast, least):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", broadcast)
    out = warc.round_trip(pages(spark, ROWS).repartition(5), "page_id", "url", "html", F.timestamp_seconds("page_id"), least).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=repr)
    assert got == plain(ROWS, least)


@pytest.mark.parametrize("run_rows,range_rows,file_bytes", [(50_000, 100_000, 1 << 28), (7, 20, 2_000)])
def test_index_is_globally_ordered(spark, monkeypatch, run_rows, range_rows, file_bytes):
    """Also with many short runs, many ranges, and a URL whose history spans several of them."""
    monkeypatch.setattr(warc, "RUN_ROWS", run_rows)
    monkeypatch.setattr(warc, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(warc, "FILE_BYTES", file_bytes)
    rows = ROWS + [(i, "http://hot.example.com/", str(i)) for i in range(1000, 1150)]
    out = warc.round_trip(pages(spark, rows).repartition(6), "page_id", "url", "html", F.timestamp_seconds("page_id")).collect()
    out.sort(key=lambda r: r["position"])
    assert [r["position"] for r in out] == list(range(len(rows)))
    keys = [(r["url_key"], r["time"], r["page_id"] is not None, r["page_id"]) for r in out]
    assert keys == sorted(keys)
    seen = {}
    for r in out:
        seen[r["url_key"]] = seen.get(r["url_key"], 0) + 1
        assert r["capture"] == seen[r["url_key"]]
    assert seen["com,example,hot)/"] == 150


def test_empty_and_text_ids(spark):
    assert warc.round_trip(pages(spark, []), "page_id", "url", "html", F.timestamp_seconds("page_id")).count() == 0
    rows = pages(spark, ROWS[:50]).withColumn("page_id", F.concat(F.lit("p\n>"), F.col("page_id")))
    out = warc.round_trip(rows, "page_id", "url", "html", F.lit(None).cast("timestamp")).collect()
    assert {r["page_id"] for r in out} == {f"p\n>{i}" for i in range(50)} and {r["time"] for r in out} == {"1970-01-01T00:00:00Z"}


def test_query_matches_sql(spark, sf_dir):
    import __spark_entry__ as E
    from tests.oracle_harness import compare, duck

    ok, message = compare(spark, duck(sf_dir), sf_dir, "op13_warc", E.queries()["op13_warc"], E.oracle_sql()["op13_warc"])
    assert ok, message
