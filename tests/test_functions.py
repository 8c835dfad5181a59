"""Numeric helpers against worked values and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrapair.functions import critical as cr
from contrapair.functions import ordered as o
from contrapair.functions import vectors as V
from contrapair.functions.hashing import portable_hash


def test_critical_values(near):
    near(cr.t_quantile(0.995, 11), 3.1058, 2e-5)
    near(cr.t_quantile(0.995, 5), 4.0321, 2e-5)
    near(cr.t_quantile(0.99, 10), 2.763769, 1e-6)
    near(cr.normal_quantile(0.975), 1.959963985, 1e-8)
    near(cr.f_sf(4.0, 1, 10), 2 * cr.t_sf(2.0, 10), 1e-9)
    near(cr.t_sf(cr.t_quantile(0.99, 7.3), 7.3), 0.01, 1e-9)


def test_large_df_expansion(spark, near):
    got = spark.range(1).select(cr.t_crit(F.lit(61), 0.995).alias("a"), cr.t_crit(F.lit(500), 0.99).alias("b"), cr.t_crit(F.lit(0), 0.99).alias("c")).first()
    near(got["a"], cr.t_quantile(0.995, 61), 1e-7)
    near(got["b"], cr.t_quantile(0.99, 500), 1e-8)
    assert got["c"] is None


def test_hash_is_uniform_and_independent(spark):
    x = spark.range(2000).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(1))))
    h = x.select("r", "id", portable_hash(F.col("id"), F.col("r"), 3).alias("h"))
    a = np.array([r["h"] for r in h.where("r = 0").orderBy("id").collect()], float)
    b = np.array([r["h"] for r in h.where("r = 1").orderBy("id").collect()], float)
    assert len(set(a)) == 2000
    assert abs(np.corrcoef(a[1:], a[:-1])[0, 1]) < 0.1 and abs(np.corrcoef(a, b)[0, 1]) < 0.1


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows and one value is heavily tied."""
    random.seed(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, float(random.choice([1, 1, 1, 2, 5, random.random()]))) for i in range(600)]
    return rows, spark.createDataFrame(rows, "k string, id bigint, v double").repartition(5)


def test_rank_equals_window(spark, skewed):
    rows, df = skewed
    got = {(r["k"], r["id"]): (r["rn"], r["n"]) for r in o.with_rank(df, ["k"], ["id"], "rn", "n").collect()}
    for k in {r[0] for r in rows}:
        ids = sorted(r[1] for r in rows if r[0] == k)
        assert [got[(k, i)] for i in ids] == [(n + 1, len(ids)) for n in range(len(ids))]


def test_running_folds(spark, skewed):
    rows, df = skewed
    out = o.with_running(df, ["k"], ["id"], {"s": ("sum", "v"), "m": ("max", "v")})
    got = {(r["k"], r["id"]): (r["s"], r["m"]) for r in out.collect()}
    before = o.with_running(df, ["k"], ["id"], {"p": ("max", "v")}, inclusive=False)
    prev = {(r["k"], r["id"]): r["p"] for r in before.collect()}
    for k in {r[0] for r in rows}:
        s, m = 0.0, None
        for _, i, v in sorted(r for r in rows if r[0] == k):
            assert prev[(k, i)] == m
            s, m = s + v, v if m is None else max(m, v)
            assert abs(got[(k, i)][0] - s) < 1e-9 and got[(k, i)][1] == m


def test_quantiles_and_ranks(spark, skewed):
    rows, df = skewed
    q = {r["k"]: r for r in o.exact_quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.99, "c": 0.0}).collect()}
    ranks = {(r["k"], r["id"]): r["r"] for r in o.average_ranks(df, ["k"], "v", "r").collect()}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        v = np.array([r[2] for r in mine])
        assert np.allclose([q[k]["a"], q[k]["b"], q[k]["c"]], [np.quantile(v, 0.5), np.quantile(v, 0.99), v.min()])
        for _, i, x in mine:
            assert ranks[(k, i)] == (v < x).sum() + ((v == x).sum() + 1) / 2


def test_quantile_of_constant_column(spark):
    df = spark.createDataFrame([(1.0,)] * 9, "v double")
    assert o.exact_quantiles(df, [], "v", {"m": 0.5, "h": 0.9}).first().asDict() == {"m": 1.0, "h": 1.0}


def test_vector_functions(spark, near):
    a, b = [1.0, 2.0, 4.0, 3.0], [2.0, -1.0, 0.5, 1.0]
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    r = df.select(
        V.dot(F.col("a"), F.col("b")).alias("d"), V.roll(F.col("a"), F.lit(1)).alias("r"), V.moving_average(F.col("a"), 1).alias("m"),
        V.cosine(F.col("a"), F.col("b")).alias("c"), V.sign_code(F.col("b")).alias("s"), V.median(F.col("a")).alias("med"),
    ).first()
    near(r["d"], float(np.dot(a, b)))
    assert r["r"] == [2.0, 4.0, 3.0, 1.0] and r["m"] == [1.5, 7 / 3, 3.0, 3.5] and r["s"] == 0b1101 and r["med"] == 2.5
    near(r["c"], float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)))
