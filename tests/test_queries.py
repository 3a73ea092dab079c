"""Every query with SQL against DuckDB on the smallest tables, and loops, streams and figures."""

import os

import pytest

from pyspark.sql import functions as F

import ringweave.feature_queries  # registers its queries  # noqa: F401
from ringweave import recipes, stats, streaming
from ringweave.operators import Checkpoint, route, routed, row_loop, tagged
from ringweave.plans.nodes import run_item
from ringweave.queries import ORACLES, QUERIES, _to_value
from ringweave.sources import lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, tables, name):
    got, expected = QUERIES[name](spark, SF).toPandas(), tables.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    rows = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))
    plain = lambda found: [r.replace(".0,", ",").replace(".0]", "]") for r in found]
    assert plain(rows(got)) == plain(rows(expected))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_nested_golden(spark):
    got = sorted(r.total for r in QUERIES["recur_nested"](spark, SF).collect())
    assert got[:2] == sorted(got)[:2] and {9716, 11660, 4532, 5180, 5828, 6476, 7124, 7772, 8420, 9068} <= set(got)


def test_checkpoints(spark, tmp_path):
    at = Checkpoint(f"file://{tmp_path}/loop", "one", stop_after=2)
    assert at.modified(spark) == -1 and "no checkpoint" in at.info(spark)
    with pytest.raises(Checkpoint.Stopped):
        _to_value(spark, SF, at)
    assert "stopped after step 2" in at.info(spark) and at.modified(spark) > 0
    with pytest.raises(Checkpoint.Mismatch):
        _to_value(spark, SF, Checkpoint(at.folder, "other"))
    whole = sorted(_to_value(spark, SF, Checkpoint(at.folder, "one")).collect())
    assert whole == sorted(_to_value(spark, SF).collect())
    assert "finished" in at.info(spark)
    assert sorted(_to_value(spark, SF, Checkpoint(at.folder, "one")).collect()) == whole


def test_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(" 1\n\n  \n2 \n")
    assert sorted(r.value for r in lines.read_lines(spark, f"{tmp_path}/in", "int").collect()) == [1, 2]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        lines.lines(spark.createDataFrame([("x",)], "value string"), "value", "int").collect()
    assert lines.source_of(spark, seed=["a", "b"], queued=[1], stream=["c"]) == ["a b"]
    assert lines.source_of(spark, queued=[1], stream=["c"]) == [1]
    assert lines.source_of(spark, stream=[" c \n", "\n"]) == ["c"]
    assert lines.source_of(spark) == []
    seen = []
    lines.handle(spark.range(3), seen.append)
    assert [r.id for r in seen] == [0, 1, 2]
    lines.write_csv(spark.range(2), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2


def test_streams_go_on_where_they_were(spark, tmp_path):
    (tmp_path / "in").mkdir()
    found = []
    for k in range(2):
        (tmp_path / "in" / f"{k}.txt").write_text(f"{k}\n{k + 10}\n")
        stream = streaming.line_stream(spark, f"{tmp_path}/in", "int")
        streaming.run_stream(stream, lambda df, _: found.extend(r.value for r in df.collect()), f"{tmp_path}/at", once=True).awaitTermination()
    assert sorted(found) == [0, 1, 10, 11]


def _waits(batches):
    import time

    for batch in batches:
        time.sleep(0.5)
        yield batch


def test_row_loops(spark):
    many = spark.range(1_000_000).selectExpr("id", "cast(id % 1000 as int) as v")
    got = row_loop(many, ["id"], "v", "value < 1000", "value + 70")
    assert got.agg({"value": "max"}).first()[0] == 1069 and got.where("value < 1000 or first <> id % 1000").count() == 0
    assert [tuple(r) for r in row_loop(spark.sql("SELECT 1 AS k, CAST(null AS int) AS v"), ["k"], "v", "value < 5", "value + 1").collect()] == [(1, None, None)]
    with pytest.raises(Exception, match="more than 20 steps"):
        row_loop(spark.range(3), [], "id", "value < 100", "value + 1", most=20).collect()
    assert row_loop(spark.range(3), [], "id", "value < 22", "value + 1", most=22).agg({"value": "min"}).first()[0] == 22


def test_routes(spark):
    df = spark.range(6)
    even = {"even": (F.col("id") % 2 == 0, {"v": F.col("id") * 10}), "large": (F.col("id") > 3, {"v": -F.col("id")})}
    got = sorted(map(tuple, routed(df, even, keep=["id"]).collect()))
    assert got == [(0, "even", 0), (2, "even", 20), (4, "even", 40), (4, "large", -4), (5, "large", -5)]
    assert route(df, {"a": (F.col("id") < 2, lambda x: x), "b": (F.col("id") < 1, lambda x: x)}).count() == 3
    with pytest.raises(Exception, match="unknown kind: other"):
        tagged(spark.sql("SELECT 'other' AS k"), F.col("k"), {"one": F.lit(1)}, "v").collect()


def test_evolution_is_what_one_process_finds(spark):
    """The frame in tasks gives what the same plan gives here, item by item."""
    expected = sorted(tuple(out[k] for k in ("seed", "generations", "error")) for r in range(5) for out in run_item(recipes.evolution(), r))
    assert sorted(map(tuple, QUERIES["frame_evolve"](spark, SF).collect())) == expected
    assert all(error < 0.05 or n >= 200 for _, n, error in expected)


def test_figures(spark):
    with stats.measured(spark) as run:
        df = run.observe(spark.range(100).where("id % 2 = 0"), "even")
        lines.noop(df)
    assert run.count("even") == 50 and run.jobs >= 1 and run.tasks >= 1 and run.seconds > 0
    with stats.measured(spark) as run:
        spark.range(4, numPartitions=4).mapInArrow(_waits, "id long").collect()
    assert run.run_seconds > 1 and run.cpu_seconds > 0 and run.user_share > 1 and "4 tasks" in str(run)
    assert stats.cpu_count(spark) == spark.sparkContext.defaultParallelism


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["job_filter"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,100000" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    assert "Exchange" not in QUERIES["reduce_per_item"](spark, SF)._jdf.queryExecution().toString()
