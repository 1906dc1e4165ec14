"""CSV files whose quoted values hold line breaks, read in small splits, against a plain reader."""

import csv
import io
import random

import pytest

from lithos.functions.text import NA_WORDS
from lithos.operators.position import SPLIT
from lithos.plans.preview import preview_csv
from lithos.sources import csv_scan as S


@pytest.fixture
def small_splits(spark):
    """Splits of 1 KB, so that records and quotes cross many of them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
           if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "16")
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
        spark.conf.unset(k)
    for k, v in old.items():
        spark.conf.set(k, v)


def value(rng):
    kind = rng.randrange(8)
    if kind < 3:
        return str(rng.randrange(1000))
    parts = ["a", "b,", "\n", '"', "\r\n" if kind == 7 else "x", "é", ",,", "\n\n", "word ", '","', '"\n"']
    return "".join(rng.choice(parts) for _ in range(rng.randrange(1, 30)))


def content(rng, rows, columns, end="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow([f"c{i}" for i in range(columns)])
    for i in range(rows):
        w.writerow([str(i), *[value(rng) for _ in range(columns - 1)]] if columns > 1 else [f"{i}\n{value(rng)}"])
    return out.getvalue()


def plain(text):
    return [tuple(v if v not in NA_WORDS else None for v in r) for r in list(csv.reader(io.StringIO(text, newline="")))[1:] if r]


@pytest.mark.parametrize("seed,columns,end", [(1, 3, "\n"), (3, 2, "\r\n"), (4, 1, "\n")])
def test_records_against_a_single_task(spark, tmp_path, small_splits, seed, columns, end):
    rng = random.Random(seed)
    text = content(rng, 250, columns, end)
    (tmp_path / "a.csv").write_bytes(text.encode())
    path = str(tmp_path / "a.csv")
    assert spark.read.text(path).rdd.getNumPartitions() > 5
    scan = S.scan_text(spark, path)
    assert scan.problems() == {"surplus": 0, "short": 0, "open_quote": 0}
    got = [tuple(r) for r in scan.rows.orderBy(*SPLIT).drop(*SPLIT).collect()]
    assert got == plain(text)
    assert scan.rows.select("__block").distinct().count() > 5
    typed = S.read_typed_csv(spark, path, with_position=True)
    first = {r["pos"]: r[0] for r in typed.collect()}
    assert sorted(first) == list(range(len(got))) and [str(first[i]) for i in range(len(got))] == [r[0] for r in got]


def test_many_files_one_of_them_with_breaks(spark, tmp_path, small_splits):
    rng = random.Random(9)
    texts = [content(rng, 60, 3) if i == 2 else "c0,c1,c2\n" + "".join(f"{i}{j:03d},x,y\n" for j in range(200)) for i in range(4)]
    for i, t in enumerate(texts):
        (tmp_path / f"f{i}.csv").write_text(t)
    got = [tuple(r) for r in S.scan_text(spark, str(tmp_path)).rows.orderBy(*SPLIT).drop(*SPLIT).collect()]
    assert got == [r for t in texts for r in plain(t)]


def test_line_functions():
    """Regular expressions of the state after a line against a state machine read character by character."""
    import re

    def run(line, inside):
        at_start = not inside
        i = 0
        while i < len(line):
            c = line[i]
            if inside:
                if c == '"':
                    if line[i + 1:i + 2] == '"':
                        i += 1
                    else:
                        inside = False
            elif c == '"' and at_start:
                inside = True
            at_start = c == "," and not inside
            i += 1
        return inside

    rng = random.Random(3)
    opens, stays = (re.compile(p.replace(r"\z", r"\Z")) for p in (S._OPENS, S._STAYS))
    for _ in range(20_000):
        line = "".join(rng.choice('"",,ab ') for _ in range(rng.randrange(12)))
        assert (opens.match(line) is not None) == run(line, False), line
        assert (stays.match(line) is not None) == run(line, True), line


def test_long_values_and_quotes_that_open_nothing(spark, tmp_path, small_splits):
    long = '"' + 'x""y\n' * 5000 + '"'
    text = f'a,b\n1,{long}\n2,5" pipe\n3,"z"tail\n'
    (tmp_path / "l.csv").write_text(text)
    assert [tuple(r) for r in S.scan_text(spark, str(tmp_path / "l.csv")).rows.orderBy(*SPLIT).drop(*SPLIT).collect()] == [
        ("1", 'x"y\n' * 5000), ("2", '5" pipe'), ("3", '"z"tail')]


def test_types_and_structure_from_one_scan(spark, tmp_path):
    (tmp_path / "t.csv").write_text("i,f,b,m,e,t\n1,1.5,true,1,,x\n2,2,False,,NA,\n")
    scan = S.scan_text(spark, str(tmp_path / "t.csv"))
    assert scan.types() == {"i": "bigint", "f": "double", "b": "boolean", "m": "double", "e": "double", "t": "string"}
    assert scan.types(["i"]) == {k: v for k, v in scan.types().items() if k != "i"}
    plan = S.read_typed_csv(spark, str(tmp_path / "t.csv"))._jdf.queryExecution().executedPlan().toString()
    assert "csv" not in plan.lower().split("location")[0] and plan.count("FileScan") == 1


def test_preview_of_a_file_with_breaks(spark, tmp_path, small_splits):
    text = content(random.Random(12), 100, 3)
    (tmp_path / "p.csv").write_text(text)
    out = preview_csv(spark, str(tmp_path / "p.csv"), 5)
    assert out["status"] == "ok" and out["shape"].first()["total_rows"] == 100
    assert [str(r[0]) for r in out["sample"].collect()] == [r[0] for r in plain(text)[:5]]


def test_empty_and_header_only(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n")
    assert S.read_typed_csv(spark, str(tmp_path / "h.csv"), with_position=True).count() == 0
    (tmp_path / "q.csv").write_text('a,b\n1,"\n')
    assert S.csv_problems(spark, str(tmp_path / "q.csv"))["open_quote"] == 1


def test_text_is_told_from_numbers_before_it_is_cast(spark):
    from lithos.functions.numeric import coerce_double

    texts = ["1", " 2.5 ", "\t3", "-4e2", "+.5", "inf", "-Infinity", "NaN", "R", "nine", "Infinite", "1d", "0x1p3", "-", "", None, "e5"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", coerce_double("t").alias("d"))
    got = [r["d"] for r in rows.orderBy("i").collect()]
    assert got[:7] == [1.0, 2.5, 3.0, -400.0, 0.5, float("inf"), float("-inf")] and got[7] != got[7] and got[8:] == [None] * 9
