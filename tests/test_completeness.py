"""Absent items and cells against sets."""

import numpy as np
from pyspark.sql import functions as F

from contrapair.functions.hashing import hash_array
from contrapair.operators import audit, resample


def test_absent_items(spark):
    rows = [("t", "A", 1), ("t", "A", 1), ("t", "A", 32768), ("t", "B", 32769), ("t", "B", -5), ("u", "A", 7), ("u", "A", None), (None, "A", 1), ("t", "A", 99)]
    df = spark.createDataFrame(rows, "tag string, cand string, item long")
    wanted = [-40000, -5, 0, 1, 7, 32768, 32769, 100000]
    expected = spark.createDataFrame([(i,) for i in [*wanted, 7, None]], "item long")
    cells = [(t, c) for t in ("t", "u", "v") for c in ("A", "B")]
    got = audit.absent_items(df, "tag", "cand", "item", spark.createDataFrame([*cells, ("t", "A")], "tag string, cand string"), expected).collect()
    have = set(rows)
    assert sorted(map(tuple, got)) == sorted((t, c, i) for t, c in cells for i in wanted if (t, c, i) not in have)
    # 100000 is in no cell and is reported for each; v has no row and lacks all
    assert sum(r["item"] == 100000 for r in got) == 6 and sum(r["tag"] == "v" for r in got) == 16


def test_nothing_expected_or_nothing_there(spark):
    none = spark.createDataFrame([], "tag string, cand string, item long")
    cells = spark.createDataFrame([("t", "A")], "tag string, cand string")
    some = spark.createDataFrame([(1,), (2,)], "item long")
    assert audit.absent_items(none, "tag", "cand", "item", cells, some.limit(0)).count() == 0
    assert sorted(r["item"] for r in audit.absent_items(none, "tag", "cand", "item", cells, some).collect()) == [1, 2]
    assert audit.absent_items(none, "tag", "cand", "item", cells.limit(0), some).count() == 0


def test_many_stretches_in_bounded_pieces(spark):
    """Sixty stretches of which all is missing: more than a task looks at together, whose rows are bounded."""
    expected = spark.range(0, 60 * 32768, 4096).withColumnRenamed("id", "item").coalesce(1)
    none = spark.createDataFrame([], "tag string, cand string, item long")
    got = audit.absent_items(none, "tag", "cand", "item", spark.createDataFrame([("t", "A"), ("u", "A")], "tag string, cand string"), expected)
    assert sorted(r["item"] for r in got.collect()) == sorted([*range(0, 60 * 32768, 4096)] * 2)
    assert audit.STRETCHES * 32768 * 16 < 8e6


def test_rebuilt_text_moves_the_index_once(spark):
    df = spark.createDataFrame([(1, "b a  b c a b"), (2, ""), (3, None), (4, "x")], "doc long, text string")
    index = audit.inverted_index(df, "doc", F.split("text", r"\s+"))
    assert {(r["doc"], r["word"]): r["positions"] for r in index.collect()} == {
        (1, "a"): [1, 4], (1, "b"): [0, 2, 5], (1, "c"): [3], (2, ""): [0], (4, "x"): [0]}
    back = audit.rebuilt_text(index, "doc")
    assert {r["doc"]: (r["n_words"], r["text"]) for r in back.collect()} == {1: (6, "b a b c a b"), 2: (1, ""), 4: (1, "x")}
    assert back._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_hashed_subsets_sort_few_rows(spark):
    """The rows of smallest hash, whether or not enough of them lie below the cut; what is sorted does not grow with the items."""
    ids = {"big": np.arange(3000), "small": np.arange(3), "alike": np.concatenate([np.full(900, next(i for i in range(99999) if hash_array(np.array([i]), np.array([0]), 5)[0] > 2e9)), np.arange(9)])}
    df = spark.createDataFrame([(t, int(i), float(k)) for t, a in ids.items() for k, i in enumerate(a)], "tag string, id long, v double")
    got = {(r["tag"], r["rep"]): (r["n"], r["m"]) for r in resample.hashed_subsets(df, "tag", df["id"], "v", 10, 3, 5).collect()}
    assert {k: n for k, (n, _) in got.items()} == {(t, rep): min(10, len(a)) for t, a in ids.items() for rep in range(3)}
    for rep in range(3):
        h = hash_array(ids["big"], np.full(3000, rep), 5)
        assert abs(got["big", rep][1] - np.lexsort((ids["big"], h))[:10].mean()) < 1e-9
    plan = resample.hashed_subsets(df.where("tag = 'big'"), "tag", df["id"], "v", 10, 3, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
