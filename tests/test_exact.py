"""Exact tests by half sums against dynamic programming and full enumeration."""

import itertools
import random
from collections import Counter
from math import comb

import pytest
from pyspark.errors import PySparkException

from contrapair.operators import exact
from contrapair.operators import resample as rs


def flips(values):
    """Subset sums with their numbers, by dynamic programming over distinct sums."""
    sums = Counter({0: 1})
    for v in values:
        grown = Counter(sums)
        for s, c in sums.items():
            grown[s + v] += c
        sums = grown
    return sum(c for s, c in sums.items() if s >= sum(values))


def test_thirty_and_forty_signs_by_dynamic_programming(spark):
    rng = random.Random(1)
    groups = {"thirty": [rng.randrange(-60, 90) for _ in range(30)], "forty": [rng.randrange(-3, 5) for _ in range(40)], "odd": [5, -7, 0], "one": [3], "all": [2] * 35}
    rows = [(g, i, float(v)) for g, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "arm string, seed int, theta double").repartition(3)
    got = {r["arm"]: r for r in rs.sign_flip(df, "arm", "seed", "theta", 1).collect()}
    for g, vs in groups.items():
        assert (got[g]["k"], got[g]["hits"], got[g]["assignments"]) == (len(vs), flips(vs), 2 ** len(vs)), g
    with pytest.raises(PySparkException):
        rs.sign_flip(spark.createDataFrame([("x", i, 1.0) for i in range(61)], df.schema), "arm", "seed", "theta").collect()


def test_half_sums_stay_few_rows(spark):
    g = spark.createDataFrame([(list(range(1, 21)),)], "v array<long>")
    sums = exact.half_sums(g, [], g["v"], 20, False, "at")
    assert sums.count() == 211 and sums.agg({"c": "sum"}).first()[0] == 2**20  # distinct sums, not subsets


def by_size(values, na):
    sums = Counter({(0, 0): 1})
    for v in values:
        grown = Counter(sums)
        for (k, s), c in sums.items():
            grown[k + 1, s + v] += c
        sums = grown
    return [(s, c) for (k, s), c in sums.items() if k == na]


@pytest.mark.parametrize("na,nb", [(15, 15), (3, 27), (1, 1), (20, 18)])
def test_relabellings_of_any_sizes(spark, na, nb):
    rng = random.Random(na)
    a, b = [rng.randrange(0, 40) for _ in range(na)], [rng.randrange(0, 30) for _ in range(nb)]
    rows = [("A", i, float(v)) for i, v in enumerate(a)] + [("B", i, float(v)) for i, v in enumerate(b)]
    got = rs.label_permutation(spark.createDataFrame(rows, "arm string, seed int, theta double"), "arm", ["arm", "seed"], "theta", scale=1).first()
    want = sum(c for s, c in by_size(a + b, na) if s >= sum(a))
    assert (got["n"], got["n_first"], got["hits"], got["relabellings"]) == (na + nb, na, want, comb(na + nb, na))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 12])
def test_swaps_are_enumerated_in_halves(spark, n):
    rng = random.Random(n)
    names = sorted(rng.sample(range(100), n))
    d = {(names[i], names[j]): rng.randrange(-20, 30) for i in range(n) for j in range(n) if i != j and rng.random() < 0.8} or {(names[0], names[0]): 0}
    df = spark.createDataFrame([(x, y, v) for (x, y), v in d.items()], "sx int, sy int, d long")
    at = {s: i for i, s in enumerate(names)}
    sums = [sum(v * z[at[x]] * z[at[y]] for (x, y), v in d.items()) for z in itertools.product([1, -1], repeat=n)]
    got = exact.swap_counts(df, n).first()
    assert (got["hits"], got["relabellings"]) == (sum(s >= sums[0] for s in sums), 2**n)


def test_many_swaps_without_many_rows(spark):
    """All weights equal: the sum is (p - q)^2, so only the two constant sign vectors reach it."""
    df = spark.createDataFrame([(i, j, 2) for i in range(24) for j in range(i)], "sx int, sy int, d long")
    assert exact.swap_counts(df, 24).first()["hits"] == 2
