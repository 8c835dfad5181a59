"""Steps that read their rows several times read written ones; tasks that group many rows have a bound."""

import pytest
from pyspark.sql import functions as F

from contrapair import session
from contrapair.functions import ordered
from contrapair.operators import audit, contrasts, ingest, resample


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def scores(spark):
    return spark.range(400).select(
        (F.col("id") % 57).alias("k"), F.when(F.col("id") % 3 == 0, "base").when(F.col("id") % 3 == 1, "A").otherwise("B").alias("arm"),
        (F.col("id") * 7 % 11).cast("double").alias("x"), F.when(F.col("id") % 13 > 0, F.col("id") * 5 % 389).cast("double").alias("y"))


def test_many_rows_are_dealt_to_bounded_tasks(spark, scores, monkeypatch):
    """F16: more tasks with more rows, the same counts and ranks."""
    few = sorted(map(tuple, ordered.average_ranks(scores, ["arm"], "x", "r").collect()), key=str)
    assert session.spread(scores, 400, "k").rdd.getNumPartitions() == scores.rdd.getNumPartitions()
    monkeypatch.setattr(session, "TASK_ROWS", 20)
    assert session.spread(scores, 400, "k").rdd.getNumPartitions() == 20
    assert sorted(map(tuple, ordered.average_ranks(scores, ["arm"], "x", "r").collect()), key=str) == few


def test_several_values_stay_in_one_row(scores):
    """values side by side give what one row for each value gives."""
    long = scores.select("k", "arm", F.inline(F.array(F.struct(F.lit("x").alias("K2"), F.col("x").alias("v")), F.struct(F.lit("y").alias("K2"), F.col("y").alias("v")))))
    want = contrasts.absolute_difference_to_base(long, ["k", "K2"], "arm", "v", "base").collect()
    got = contrasts.absolute_difference_to_base(scores, ["k"], "arm", ["x", "y"], "base").collect()
    assert sorted((r["arm"], r["n"], round(r["mad"], 9)) for r in got) == sorted((r["arm"], r["n"], round(r["mad"], 9)) for r in want)


def test_reproduction_joins_once(spark, scores, monkeypatch):
    """the passes of the median read the written differences."""
    seen = []
    monkeypatch.setattr(audit, "exact_quantiles", lambda df, *a: seen.append(df) or ordered.exact_quantiles(df, *a))
    x = spark.range(50).select("id", (F.col("id") / 7).alias("v"))
    got = audit.reproduction(x, x.withColumn("v", F.col("v") + F.col("id") % 3), ["id"], "v").first()
    assert (got["n"], round(got["max_abs"], 9), round(got["median_abs"], 9)) == (50, 2.0, 1.0)
    assert "Join" not in plan(seen[0])


def test_last_complete_run_numbers_lines_once(spark):
    """runs are numbered once, not again for each use."""
    lines = spark.createDataFrame([("a", i, s) for i, s in enumerate([1, 2, 1, 2, 3, 1, 2, 3, 1])], "job string, seq long, step long")
    out = ingest.last_complete_run(lines, "job", "seq", "step", 1, 3)
    assert sorted((r["seq"], r["run"]) for r in out.collect()) == [(5, 3), (6, 3), (7, 3)]
    assert "Window" not in plan(out)


def test_hash_ranks_need_no_search_for_cuts(scores, monkeypatch):
    """hashes are spread evenly, so no pass over all replicates looks for cut points."""
    monkeypatch.setattr(ordered, "_cuts", lambda *a: pytest.fail("looked for cut points"))
    x = scores.select("arm", F.monotonically_increasing_id().alias("u"), "x", "k").withColumn("rn", F.expr("row_number() over (partition by arm order by u)"))
    got = resample.permuted_within(x, "arm", "rn", F.col("u"), "x", 2, 89)
    assert got.count() == 800
    assert got.groupBy("arm", "rep").agg(F.sum("x").alias("s")).select("arm", "s").distinct().count() == 3
