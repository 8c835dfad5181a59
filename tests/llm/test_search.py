"""Vector searches: recall and exactness against brute force, and odd inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrapair.llm import bitsliced_topk, hilbert_ann
from contrapair.llm.curves import hilbert_index

SCHEMA = "vec_id long, embedding array<float>, rank string, score string"
DOUBLES = "vec_id long, embedding array<double>, rank string, score string"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], schema)


def brute(rows, k, scale=None):
    best = {}
    clean = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    vec = {i: np.array(v, dtype=np.float32).astype(np.float64) for i, v in clean}
    if scale:
        vec = {i: np.floor(v * scale).astype(np.int64) for i, v in vec.items()}
    else:
        vec = {i: v for i, v in vec.items() if v.any()}
    for q in vec:
        if q % 20 == 0:
            found = sorted((-float((vec[q] * v).sum()), i) for i, v in vec.items() if i != q and len(v) == len(vec[q]))
            best[q] = [(i, -s) for s, i in found[:k]]
    return best


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


ODD = [
    (0, [1.0, 0.5, -0.25]), (1, [1.0, 0.5, -0.25]), (2, [1.0, 0.5, -0.25]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]),
    (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (20, [-1.0, 2.0, 0.125]), (21, [-1.0, 2.0, 0.125]),
    (21, [-1.0, 2.0, 0.125]), (40, None), (60, [0.5, 0.5]), (61, [0.25, -3.0]), (80, [7.0]),
]


def test_hilbert_curve_is_one():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes), axis=-1).reshape(-1, axes)
        key = hilbert_index(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_exact_top_k_on_odd_rows(spark):
    found = got(bitsliced_topk.top_k(table(spark, ODD), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 3, scale=64.0, block_rows=4, query_rows=2))
    want = brute(ODD, 3, 64)
    assert found == {q: r for q, r in want.items() if r}


def test_nearest_on_odd_rows(spark):
    found = got(hilbert_ann.nearest(table(spark, ODD), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 3))
    want = {q: r for q, r in brute(ODD, 3).items() if r}
    assert found.keys() == want.keys()
    for q in want:
        assert [i for i, _ in found[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in found[q]], [s for _, s in want[q]], rtol=1e-12)


@pytest.mark.parametrize("search", [
    lambda d: hilbert_ann.nearest(d, "vec_id", "embedding", F.col("vec_id") % 20 == 0),
    lambda d: bitsliced_topk.top_k(d, "vec_id", "embedding", F.col("vec_id") % 20 == 0)])
def test_empty_table(spark, search):
    df = search(table(spark, []))
    assert df.columns == ["query_id", "rank", "vec_id", "score"] and df.count() == 0


def test_many_equal_vectors_keep_all_places(spark):
    rows = [(i, [0.5, 0.5]) for i in range(200)] + [(i, [0.5, 0.25 + i / 4000]) for i in range(200, 240)]
    for found, scale in ((hilbert_ann.nearest(table(spark, rows), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20), None),
                         (bitsliced_topk.top_k(table(spark, rows), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20), 64)):
        assert {q: [i for i, _ in r] for q, r in got(found).items()} == {q: [i for i, _ in r] for q, r in brute(rows, 20, scale).items()}


def test_large_components_end_at_long(spark):
    """Components and scores beyond ``long`` count as its ends, for their pairs only; brute force with whole integers."""
    top, bottom = 2 ** 63 - 1, -2 ** 63
    rows = [(0, [1.0, 2.0]), (1, [1e18, 0.0]), (2, [-1e18, 0.0]), (3, [3.0, 1.0]), (4, [1e17, 1e17]), (5, [-1e17, 1e15]), (6, [1e18, -1e18]), (20, [1e18, 1.0])]
    whole = {i: [min(max(math.floor(64 * x), bottom), top) for x in v] for i, v in rows}
    found = got(bitsliced_topk.top_k(table(spark, rows, DOUBLES), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 5, block_rows=4))
    for q in (0, 20):
        score = {i: min(max(sum(a * b for a, b in zip(v, whole[q], strict=True)), bottom), top) for i, v in whole.items() if i != q}
        want = sorted(((-s, i) for i, s in score.items()))[:5]
        assert found[q] == [(i, -s) for s, i in want]


def test_id_of_several_vectors_takes_one_place(spark):
    rows = [(0, [1.0, 0.0])] + [(7, [100.0 + j, float(j)]) for j in range(40)] + [(i, [i / 8.0, 1.0]) for i in range(1, 60) if i != 7 and i % 20]
    df = table(spark, rows)
    for found in (bitsliced_topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20), hilbert_ann.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20, ranges_factor=0.1)):
        ids = [i for i, _ in got(found)[0]]
        assert ids == [7] + [i for i in range(59, 0, -1) if i % 20 and i != 7][:19]


def test_nearest_of_vectors_that_overflow(spark):
    rows = [(i, [1e200, float(i)]) for i in range(30)] + [(40, [-1e200, 1e200]), (41, [1e-300, 1.0]), (42, [1e200, 1e200])]
    found = got(hilbert_ann.nearest(table(spark, rows, DOUBLES), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 5))
    assert found[0] == [(i, math.inf) for i in (1, 2, 3, 4, 5)]
    # against 42, +1e400 and -1e400 meet and are no number term by term; scaled, the two cancel
    assert dict(found[40])[42] == 0.0 and len(found[40]) == 5


def test_parts_of_a_range_find_what_the_range_finds(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    df = table(spark, rows)
    whole, parts = (got(hilbert_ann.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 5, range_rows=n)) for n in (10**6, 8))
    assert whole == parts and sorted(map(len, whole.values())) == [5] * 20


def test_recall_on_given_vectors(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    df = spark.read.parquet(path)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want, found = brute(rows, 20), got(hilbert_ann.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in found[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.95
    assert all(len(r) == 20 for r in found.values())
