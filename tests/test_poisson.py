"""One-pass bootstraps against plain NumPy, and their multiplicities."""

import numpy as np
import pytest

from contrapair.functions.hashing import hash_array
from contrapair.operators import poisson


def weights(uid, rep, salt, stream=None):
    h = hash_array(np.array([uid]), np.array([rep]), salt)
    return int(poisson.copies(h if stream is None else hash_array(h, np.array([stream]), salt + 1))[0])


def test_multiplicities_are_poisson_and_streams_differ():
    uid, rep = np.arange(1000)[:, None], np.arange(2000)[None, :]
    h = hash_array(uid, rep, 5)
    m = poisson.copies(h)
    for j in range(5):
        want = np.exp(-1) / np.prod(np.arange(1, j + 1))
        assert abs((m == j).mean() - want) < 0.002
    assert abs(np.corrcoef(m[:, 0], m[:, 1])[0, 1]) < 0.12 and abs(np.corrcoef(m[0], m[1])[0, 1]) < 0.1
    # 600 clusters x 2,000 replicates: no stream of (replicate, slot) is another's
    slots = np.arange(600) * 2
    first = np.concatenate([hash_array(h[:3, r][:, None], slots[None, :], 6).T for r in range(0, 2000, 40)])
    assert len(np.unique(first, axis=0)) == len(first)


@pytest.mark.parametrize("partitions", [1, 4])
def test_means_of_groups(spark, near, partitions):
    rng = np.random.default_rng(2)
    rows = [("AB"[i % 2], i, float(rng.normal()), float(rng.normal())) for i in range(200)]
    df = spark.createDataFrame([*rows, ("A", 999, None, 1.0)], "g string, u long, c double, e double").repartition(partitions)
    got = {(r["g"], r["rep"]): (r["c"], r["e"]) for r in poisson.poisson_means(df, ["g"], "u", ["c", "e"], 7, 11).collect()}
    for g in "AB":
        for rep in range(7):
            m = np.array([weights(u, rep, 11) for k, u, _, _ in rows if k == g])
            for v in (2, 3):
                near(got[g, rep][v - 2], (m * [r[v] for r in rows if r[0] == g]).sum() / m.sum(), 1e-12)
    assert len(got) == 14 and poisson.poisson_means(df, [], "u", ["c"], 3, 11).count() == 3


@pytest.mark.parametrize("shared", [False, True])
def test_hierarchical_means(spark, near, shared):
    rng = np.random.default_rng(3)
    arms = {"A": 3, "B": 4, "C": 2}  # any number of arms, each with a stream of its own
    clusters = [(a, f"{a}{p}", p) for a, k in arms.items() for p in range(1, k + 1)]
    rows = [(a, p, 10 * i + p, float(rng.normal())) for a, _, p in clusters for i in range(30)]
    items = spark.createDataFrame(rows, "arm string, place int, u long, c double").repartition(3)
    made = spark.createDataFrame(clusters, "arm string, tag string, place int")
    got = poisson.hierarchical_means(items, made, "arm", "tag", "place", "u", ["c"], 5, 21, 23, shared).collect()
    assert len(got) == 5 * sum(arms.values())
    for r in got:
        at = sorted(arms).index(r["arm"])
        place = int(hash_array(np.array([r["slot"]]), np.array([r["rep"] * 3 + at]), 21)[0]) % arms[r["arm"]] + 1
        assert r["tag"] == f"{r['arm']}{place}"
        mine = [x for x in rows if x[:2] == (r["arm"], place)]
        m = np.array([weights(x[2], r["rep"], 23, 0 if shared else r["slot"] * 3 + at) for x in mine])
        near(r["c"], (m * [x[3] for x in mine]).sum() / m.sum(), 1e-12)


def test_plan_holds_no_row_for_item_and_replicate(spark):
    items = spark.range(1000).selectExpr("id AS u", "'A' AS g", "CAST(id AS double) AS c")
    df = poisson.poisson_means(items, ["g"], "u", ["c"], 50, 1)
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("tile", [4, 4096])
def test_signatures_of_replicates(spark, near, tile):
    rng = np.random.default_rng(5)
    y, w = rng.normal(10, 1, (12, 10)), rng.normal(size=(12, 10))
    df = spark.createDataFrame([("ab"[i % 2], i, y[i].tolist(), w[i].tolist()) for i in range(12)], "d string, u long, y array<double>, w array<double>").repartition(3)
    got = {(r["d"], r["rep"], r["pos"]): r["k"] for r in poisson.bootstrap_signatures(df, "d", "u", "y", "w", 4, 9, tile).collect()}
    assert len(got) == 2 * 4 * 10
    for (dev, rep, pos), k in got.items():
        at = [i for i in range(12) if "ab"[i % 2] == dev]
        m = np.array([weights(i, rep, 9) for i in at])
        near(k, (m * y[at, pos] * w[at, pos]).sum() / max((m * y[at, pos] ** 2).sum(), 1e-6), 1e-12)
