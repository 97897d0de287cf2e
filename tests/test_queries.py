"""Every registered engine query against its SQL, the entry contract, and streams against their batch counterparts."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from sessionlake import queries as Q
from sessionlake.operators.merge import Store, sessions_of
from sessionlake.operators.normalize import as_events
from sessionlake.streaming import live

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@needs_data
@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_against_sql(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    want = duck.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    pick = sorted(columns)
    at = [columns.index(c) for c in pick]
    assert plain(tuple(r) for r in df.select(*pick).collect()) == plain(tuple(r[i] for i in at) for r in want.fetchall())


@needs_data
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_engine_stands_without_the_corpus_operators():
    """Only __spark_entry__ may know them."""
    code = "import sys; sys.modules['sessionlake.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport sessionlake.cli, sessionlake.streaming.live, sessionlake.queries\nprint(len(sessionlake.queries.queries()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ROOT})
    assert got.returncode == 0 and int(got.stdout.split()[-1]) > 30


def stream_rows(spark):
    rows = [("s1", i, 60_000.0 * m, "Bash" if i % 2 else "Read") for i, m in enumerate([0, 5, 20, 70, 71, 200])] + [("s2", 0, 60_000.0, "Bash")]
    df = spark.createDataFrame(rows, "s string, i int, t double, tool string")
    return as_events(df, source=F.lit("Claude"), session_id=F.col("s"), event_id=F.col("i").cast("string"), event_type=F.lit("tool_call"), tool_name=F.col("tool"), timestamp=F.col("t"), source_file=F.lit("f"), line_no=F.col("i"), block_pos=F.lit(0))


@pytest.mark.parametrize("report", [live.windowed_tool_counts, live.activity_windows])
def test_streamed_reports(spark, tmp_path, report):
    events = stream_rows(spark)
    events.write.parquet(str(tmp_path / "in"))
    q = report(live.event_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(f"t_{report.__name__}").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert plain(map(tuple, spark.table(f"t_{report.__name__}").collect())) == plain(map(tuple, report(events).collect()))


def test_streamed_merge(spark, tmp_path):
    events = stream_rows(spark)
    for i, part in enumerate((events.filter("line_no < 3"), events.filter("line_no >= 3"), events.filter("line_no = 1"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        store = Store(spark, str(tmp_path / "store"))
        live.merge_into(live.event_stream(spark, str(tmp_path / "in")), store, str(tmp_path / "cp")).awaitTermination()
    want = sessions_of(events, spark.createDataFrame([("f", 0.0, None, None)], "source_file string, mtime double, project_path string, metadata string"))
    assert plain(map(tuple, store.sessions().select("id", "started_at", "ended_at").collect())) == plain(map(tuple, want.select("id", "started_at", "ended_at").collect()))
    assert store.events().count() == 7
