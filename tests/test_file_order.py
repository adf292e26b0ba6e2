"""Numbers of lines and years of login files: several blocks, equal names, mixed encodings, plans without a sort of the text."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.operators import syslog as Y
from palisade.sources import files as R


@pytest.fixture
def small_blocks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_line_numbers_over_blocks_and_equal_names(spark, tmp_path, small_blocks):
    want = {}
    for folder, lines in (("a", 900), ("b", 333), ("c", 1)):
        (tmp_path / folder).mkdir()
        rows = [f"  {folder} line {i} {'x' * (i % 40)}" if i % 9 else "   " for i in range(lines)]
        (tmp_path / folder / "auth.log").write_text("\n".join(rows) + "\n")
        want.update({(r.strip()): i for i, r in enumerate(rows) if r.strip()})
    read = R.read_log_lines(spark, [str(tmp_path / f) for f in "abc"])
    assert read.rdd.getNumPartitions() > 1
    got = {r["line"]: r["line_number"] for r in read.collect()}
    assert got == want
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    assert {r[0] for r in read.select("source_file").distinct().collect()} == {"auth.log"}


def test_blocks_that_change_are_noticed(spark, tmp_path, small_blocks):
    (tmp_path / "auth.log").write_text("\n".join(f"line {i}" for i in range(2000)))
    read = R.read_log_lines(spark, str(tmp_path))
    assert read.agg(F.max("line_number")).first()[0] == 1999
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    again = R.read_log_lines(spark, str(tmp_path))
    assert again.agg(F.max("line_number")).first()[0] == 1999
    numbered = R.placed(spark.read.text(str(tmp_path)).select("value", F.col("_metadata"))).drop("_metadata")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    moved = R.numbered_rows(numbered.withColumn("_block", F.col("_block") + 1), "n")
    assert moved.agg(F.max("n")).first()[0] == 1999  # blocks are only names
    shifted = R.numbered_rows(numbered.withColumn("_read_order", F.when(F.rand(3) < 0.5, F.col("_read_order") + 5000).otherwise(F.col("_read_order"))), "n")
    with pytest.raises(Exception, match="blocks of a file changed"):
        shifted.agg(F.max("n")).collect()


def test_flow_rows_over_blocks(spark, tmp_path, small_blocks):
    head = "Flow ID,Source IP,SYN Flag Count,Label\n"
    for name, code in (("a.csv", "cp1252"), ("b.csv", "utf-8"), ("c.csv", "utf-8-sig")):
        rows = [f"f{i},10.0.0.{i % 9},{i},Web Attack – {i % 3}\n" for i in range(400)]
        (tmp_path / name).write_bytes((head + "".join(rows)).encode(code))
    flows = R.read_flows(spark, str(tmp_path))
    rows = flows.select("source_file", "row_number", "syn_flags", "flow_label", "entity_id").collect()
    assert len(rows) == 1200
    for r in rows:
        assert r["row_number"] == int(r["syn_flags"]) and r["flow_label"] == f"Web Attack – {r['row_number'] % 3}"


MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def brute_years(rows):
    out, before, year = {}, {}, {}
    for name, n, month in sorted(rows):
        year[name] = year.get(name, Y.FIRST_YEAR) + (name in before and month < before[name])
        before[name] = month
        out[name, n] = year[name]
    return out


@pytest.mark.parametrize("piece", [1, 3, 50, 100_000])
def test_years_by_pieces(spark, piece):
    draw = random.Random(piece)
    rows, n = [], 0
    for name in ("x.log", "y.log", "z.log"):
        month = 1
        for _ in range(300):
            n += draw.choice([1, 1, 1, 40])  # gaps, as lines without an address have
            month = draw.choice([month, month, month, month, month % 12 + 1, draw.randrange(1, 13)])
            rows.append((name, n, month))
    lines = [(name, n, f"{MONTHS[m - 1]} 11 10:00:00 h sshd[1]: Failed password for root from 1.1.1.1 port 1 ssh2") for name, n, m in rows]
    parsed = Y.parse_syslog(spark.createDataFrame(lines, "source_file string, line_number long, line string").repartition(5))
    dated = Y.infer_years(parsed, piece=F.floor(F.col("line_number") / piece))
    got = {(r["source_file"], r["line_number"]): r["event_year"] for r in dated.collect()}
    assert got == brute_years(rows)
    assert "rangepartitioning" not in dated._jdf.queryExecution().executedPlan().toString()
