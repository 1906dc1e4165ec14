"""Typed CSV scan with the missing-value words and the whole-column type ladder (SRC-1/2).

Spark's CSV reader takes one ``nullValue`` and infers types per value, so the files are read as text, once: while the
text columns are written to the checkpoint folder, one set of mergeable counts a column is taken, off which the types
are read:

* all values missing                       -> double (all NULL)
* every present value an integer, none NA  -> long
* every present value an integer or float  -> double (an integer column with a NA is double)
* every value a boolean word, none NA      -> boolean
* every present value a boolean word       -> string, spelled ``True`` / ``False``
* anything else                            -> string (missing words become NULL)

Dates stay text (no date parsing is requested by the readers this mirrors). Columns named in
``text_columns`` (ids) skip the ladder, so ``001`` stays ``001`` and a blank elsewhere in the
column does not turn ``1`` into ``1.0``. A doubled quote inside quotes is a quote, and a line break inside quotes
belongs to the value: files with such breaks are still read in splits, whose records are cut at their true ends
(``records``; lines end with a line feed there). A row with more fields than the header, and a quote left open at the
end of a file, are parse errors (``csv_problems``), never silently cut rows; a row with fewer fields has NULLs and is
counted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithos.functions.numeric import coerce_double
from lithos.functions.text import na_to_null
from lithos.operators.position import SPLIT, materialize, with_split, with_split_position

# Boolean words recognised by the default CSV parser of the pandas family.
TRUE_WORDS = ("True", "TRUE", "true")
FALSE_WORDS = ("False", "FALSE", "false")

_INT_RE = r"^\s*[+-]?[0-9]+\s*$"


@dataclass(frozen=True)
class SourceStatus:
    path: str
    status: str  # "ok" or "error"
    error: str | None = None


def source_status(spark: SparkSession, path: str, fmt: str = "csv") -> SourceStatus:
    """Missing-source check returned as a status instead of an exception (SRC-2)."""
    try:
        spark.read.format(fmt).option("header", True).load(path).schema  # noqa: B018 - listing only
        return SourceStatus(path, "ok")
    except AnalysisException as e:  # PATH_NOT_FOUND and friends
        return SourceStatus(path, "error", f"File not found: {path}" if "PATH_NOT_FOUND" in str(e) else str(e))


# A character that no text file holds: an empty field then stays apart from an absent one.
_ABSENT = "\u0001"
_SURPLUS = "__surplus"


class CsvParseError(ValueError):
    """Rows that do not fit their header."""


def _reader(spark: SparkSession, multi_line: bool):
    return (spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"')
            .option("multiLine", multi_line).option("nullValue", _ABSENT).option("columnPruning", False))


def read_raw_csv(spark: SparkSession, path: str, with_metadata: bool = False, multi_line: bool = False,
                 keep_surplus: bool = False) -> DataFrame:
    """CSV as text columns named by the header; missing-value words become NULL. ``multi_line``: quoted
    fields may hold line breaks, by Spark's own reader (a file is then one task's work; ``scan_text`` takes them in
    splits). ``keep_surplus`` adds what follows the
    header's fields as ``__surplus`` and whether fields are absent as ``__short``."""
    names = _reader(spark, multi_line).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _SURPLUS]])
    # the surplus field is expected and mostly absent; other files of the folder repeat the header
    raw = _reader(spark, multi_line).option("enforceSchema", True).schema(schema).csv(path)
    cols = [na_to_null(F.col(f"`{c}`")).alias(c) for c in names]
    if keep_surplus:
        cols += [F.col(_SURPLUS), (F.col(f"`{names[-1]}`").isNull() if names else F.lit(False)).alias("__short")]
    if with_metadata:
        cols.append(F.col("_metadata"))
    return raw.select(*cols)


#: Aggregates of one column that decide its type: missing, integer, float and boolean-word values, values with a quote.
_LATTICE = "mifbq"


def _lattice(columns: Sequence[str]) -> list:
    """Counts per column, mergeable row by row and task by task: the type ladder is read off their final values."""
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`")
        present = v.isNotNull()
        whole = v.rlike(_INT_RE) & F.trim(v).try_cast("long").isNotNull()
        aggs += [
            F.count_if(~present).alias(f"m{i}"),
            F.count_if(present & whole).alias(f"i{i}"),
            F.count_if(present & (whole | coerce_double(v).isNotNull())).alias(f"f{i}"),
            F.count_if(present & v.isin(*TRUE_WORDS, *FALSE_WORDS)).alias(f"b{i}"),
            F.count_if(F.contains(v, F.lit('"'))).alias(f"q{i}"),
        ]
    return aggs


def _ladder(counts: dict, columns: Sequence[str]) -> dict[str, str]:
    """{name: sql type} from the final counts."""
    out = {}
    for i, c in enumerate(columns):
        m, n_int, n_float, n_bool = (counts[f"{k}{i}"] for k in "mifb")
        p = counts["rows"] - m
        if p == 0:
            out[c] = "double"
        elif n_int == p:
            out[c] = "bigint" if m == 0 else "double"
        elif n_float == p:
            out[c] = "double"
        elif n_bool == p:
            out[c] = "boolean" if m == 0 else "boolean text"
        else:
            out[c] = "string"
    return out


@dataclass(frozen=True)
class TextScan:
    """The rows of CSV files as written text columns (with ``SPLIT``), and what was counted while they were written."""

    rows: DataFrame
    columns: list[str]
    counts: dict

    def problems(self) -> dict[str, int]:
        return {k: self.counts[k] for k in ("surplus", "short", "open_quote")}

    def types(self, text_columns: Sequence[str] = ()) -> dict[str, str]:
        ladder = _ladder(self.counts, self.columns)
        return {c: t for c, t in ladder.items() if c not in set(text_columns)}


def _written(raw: DataFrame, names: list[str]) -> tuple[DataFrame, Observation]:
    """Write the text columns and count, in the same pass, all that types and structure depend on."""
    seen = Observation()
    raw = raw.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(_SURPLUS).isNotNull()).alias("surplus"),
                      F.count_if("__short").alias("short"), *_lattice(names))
    return materialize(raw.drop(_SURPLUS, "__short")), seen


def scan_text(spark: SparkSession, path: str, multi_line: bool = False) -> TextScan:
    """Read CSV files once: text columns are written, and types and structure are counted on the way.

    Line breaks inside quotes need no option. Rows cut at them are short or hold a stray quote; where the counts show
    any (or the files have one column), the lines' quotes are followed, and if some line ends inside a quote the records
    are cut anew (``records``). ``multi_line`` does that at once."""
    names = _reader(spark, True).csv(path).columns
    if not multi_line:
        raw = read_raw_csv(spark, path, with_metadata=True, keep_surplus=True)
        rows, seen = _written(with_split(raw), names)
        counts = dict(seen.get)
        suspect = len(names) < 2 or counts["short"] or counts["surplus"] or any(counts[f"q{i}"] for i in range(len(names)))
        if not suspect or not ends_inside_quotes(spark, path):
            return TextScan(rows, names, {**counts, "open_quote": 0})
    found, still_open = records(spark, path)
    rows, seen = _written(_parsed(found, names), names)
    return TextScan(rows, names, {**dict(seen.get), "open_quote": still_open})


def csv_problems(spark: SparkSession, path: str, multi_line: bool = False) -> dict[str, int]:
    """Counts: ``surplus`` (rows with more fields than the header), ``short`` (fewer), ``open_quote`` (files that end
    inside a quote)."""
    return scan_text(spark, path, multi_line).problems()


def check_csv(scan: TextScan, path: str) -> list[str]:
    """Raise CsvParseError for rows that would lose data; warnings for short rows."""
    found = scan.problems()
    if found["surplus"] or found["open_quote"]:
        raise CsvParseError(f"{path}: {found['surplus']} rows with more fields than the header, "
                            f"{found['open_quote']} files that end inside a quote")
    return [f"{found['short']} rows have fewer fields than the header"] if found["short"] else []


# ---- records across lines ------------------------------------------------------------------------------------

# A quote opens a field only at its start; inside, a doubled quote is a quote; after the closing one the field runs
# to the next comma. Possessive runs: no recursion, whatever the length of a line.
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_FIELDS = rf'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+)?,)*+'
_OPENS = rf'^{_FIELDS}"{_INSIDE}\z'
_STAYS = rf'^{_INSIDE}(?:\z|"[^,]*+,{_FIELDS}"{_INSIDE}\z)'


def _lines(spark: SparkSession, path) -> DataFrame:
    """Lines with where they end when they start outside (``t0``) and inside (``t1``) a quoted field: 1 inside."""
    raw = spark.read.option("lineSep", "\n").text(path).select("value", "_metadata")
    return with_split(raw).withColumn("t0", F.col("value").rlike(_OPENS).cast("int")).withColumn(
        "t1", F.col("value").rlike(_STAYS).cast("int"))


def ends_inside_quotes(spark: SparkSession, path: str) -> bool:
    """Whether any line, read as the start of a record, ends inside a quoted field. If none does, every line is a
    record: the first of a file starts outside, and so, one after the other, do all."""
    return bool(_lines(spark, path).agg(F.max("t0")).first()[0])


def records(spark: SparkSession, path, headers: bool = False) -> tuple[DataFrame, int]:
    """(records as (text, SPLIT), number of files that end inside a quote) of a path or a list of them; the first
    record of every file, its header, only with ``headers``.

    A line maps the state it starts in (outside or inside a quote) to the one it ends in: to a fixed one, to the same,
    or to the other. The state before a line is the last fixed one, turned as often as lines since then turn it. That
    is a running sum inside every split; one row a split carries it, in the same way, from split to split of a file.
    Records on one line stay where they are; the lines of longer ones are gathered per record."""
    lines = materialize(_lines(spark, path))
    split = Window.partitionBy("__file", "__block").orderBy("__mid")
    upto, before = split.rowsBetween(Window.unboundedPreceding, 0), split.rowsBetween(Window.unboundedPreceding, -1)
    fixed, turn = F.col("t0") == F.col("t1"), ((F.col("t0") == 1) & (F.col("t1") == 0)).cast("int")
    lines = lines.withColumn("turns", F.sum(turn).over(upto))
    mark = F.when(fixed, F.struct(F.col("turns").alias("n"), F.col("t0").alias("v")))
    lines = lines.withColumn("mark", mark).withColumn("last", F.last("mark", ignorenulls=True).over(before)).withColumn(
        "turned", F.col("turns") - turn)

    def after(last, turned, start):
        """State once ``turned`` turns are made, ``last`` the last fixed state with the turns made by then."""
        return F.when(last.isNull(), (start + turned) % 2).otherwise((last["v"] + turned - last["n"]) % 2)

    per = lines.groupBy("__file", "__block").agg(F.max("turns").alias("turns"), F.max(F.struct(
        F.col("mark").isNotNull(), F.when(F.col("mark").isNotNull(), F.col("__mid")), "mark"))["mark"].alias("mark"))
    # a split is a fixed state, or turns its start or not
    own = F.when(F.col("mark").isNull(), F.col("turns") % 2).otherwise(0)
    file_upto = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)
    file_before = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("own", own).withColumn("all", F.sum("own").over(file_upto)).withColumn("fix", F.when(
        F.col("mark").isNotNull(), F.struct(F.col("all").alias("n"), ((F.col("mark.v") + F.col("turns") - F.col("mark.n")) % 2).alias("v"))))
    per = per.withColumn("last", F.last("fix", ignorenulls=True).over(file_before))
    per = per.withColumn("start", after(F.col("last"), F.col("all") - F.col("own"), F.lit(0)))
    per = per.withColumn("end", F.when(F.col("fix").isNotNull(), F.col("fix.v")).otherwise((F.col("start") + F.col("own")) % 2))
    lines = lines.join(per.select("__file", "__block", "start"), ["__file", "__block"])
    state = after(F.col("last"), F.col("turned"), F.col("start"))
    lines = lines.withColumn("state", state).withColumn("end", F.when(F.col("state") == 0, F.col("t0")).otherwise(F.col("t1")))
    cut = materialize(lines.select("value", *SPLIT, "state", "end"))
    ends = per.groupBy("__file").agg(F.max_by("end", "__block").alias("end"))
    still_open = ends.agg(F.coalesce(F.sum("end"), F.lit(0))).first()[0]
    # the record of a line that goes on: the last one that started, in this split or in one before
    started = F.when(F.col("state") == 0, F.struct("__block", "__mid"))
    longer = cut.withColumn("rec", F.last(started, ignorenulls=True).over(upto)).where((F.col("state") == 1) | (F.col("end") == 1))
    last_start = cut.where("state = 0").groupBy("__file", "__block").agg(F.max(F.struct("__block", "__mid")).alias("rec"))
    carried = per.select("__file", "__block").join(last_start, ["__file", "__block"], "left").withColumn(
        "carry", F.last("rec", ignorenulls=True).over(file_before)).select("__file", "__block", "carry")
    pieces = longer.join(carried, ["__file", "__block"]).withColumn("rec", F.coalesce("rec", "carry"))
    gathered = pieces.groupBy("__file", "rec").agg(F.sort_array(F.collect_list(F.struct("__block", "__mid", "value"))).alias("p"))
    whole = gathered.select(F.array_join(F.col("p.value"), "\n").alias("text"), "__file", F.col("rec.__block").alias("__block"),
                            F.col("rec.__mid").alias("__mid"))
    single = cut.where("state = 0 and end = 0").select(F.col("value").alias("text"), *SPLIT)
    found = single.unionByName(whole)
    if not headers:
        header = cut.groupBy("__file").agg(F.min(F.struct("__block", "__mid")).alias("h"))
        found = found.join(header, "__file").where(F.struct("__block", "__mid") > F.col("h")).drop("h")
    found = found.withColumn("text", F.regexp_replace("text", r"\r\z", "")).where(F.trim("text") != "")
    # places in a split are consecutive again
    return found.withColumn("__mid", F.row_number().over(split)), still_open


def _parsed(found: DataFrame, names: list[str]) -> DataFrame:
    """Records as text columns, ``_SURPLUS`` and ``__short``, by Spark's parser of single CSV texts."""
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, _SURPLUS])
    options = {"mode": "PERMISSIVE", "escape": '"', "nullValue": _ABSENT, "multiLine": "true"}
    row = found.select(*SPLIT, F.from_csv("text", F.lit(schema), options).alias("r"))
    at = lambda c: F.col("r").getField(c)
    return row.select(*[na_to_null(at(c)).alias(c) for c in names], at(_SURPLUS).alias(_SURPLUS),
                      (at(names[-1]).isNull() if names else F.lit(False)).alias("__short"), *SPLIT)


def apply_ladder(text_df: DataFrame, types: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    cols = []
    for c in text_df.columns:
        v = F.col(f"`{c}`")
        t = types.get(c)
        if t is None:
            cols.append(v)
        elif t == "bigint":
            cols.append(F.trim(v).try_cast("long").alias(c))
        elif t == "double":
            cols.append(coerce_double(v).alias(c))
        elif t == "boolean":
            cols.append(F.when(v.isin(*TRUE_WORDS), F.lit(True)).when(v.isin(*FALSE_WORDS), F.lit(False)).alias(c))
        elif t == "boolean text":
            cols.append(F.when(v.isin(*TRUE_WORDS), F.lit("True")).when(v.isin(*FALSE_WORDS), F.lit("False")).alias(c))
        else:
            cols.append(v.alias(c))
    return text_df.select(*cols, *(keep or []))


def read_typed_csv(spark: SparkSession, path: str, with_position: bool = False, pos_name: str = "pos",
                   text_columns: Sequence[str] = (), multi_line: bool = False) -> DataFrame:
    """CSV -> typed DataFrame; with ``with_position`` a dense file-order ``pos_name`` column. The files are scanned once
    and their text is written; what is returned reads that. Raises CsvParseError where rows do not fit the header."""
    scan = scan_text(spark, path, multi_line)
    check_csv(scan, path)
    rows = with_split_position(scan.rows, pos_name) if with_position else scan.rows.drop(*SPLIT)
    return apply_ladder(rows, scan.types(text_columns))
