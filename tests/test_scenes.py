"""Scenes per device against a plain k-means, planted groups and all assignments."""

from itertools import permutations

import numpy as np

from contrapair.functions.hashing import hash_array
from contrapair.operators import scenes


def planted(seed=4, devices=3, k=4, dim=6, each=30):
    rng = np.random.default_rng(seed)
    middle = 5 * np.eye(k, dim)
    rows, truth = [], {}
    for d in range(devices):
        for n in range(each):
            s = int(rng.integers(k))
            item = d * 1000 + n
            rows.append((f"d{d}", item, (middle[s] + rng.normal(size=dim) * 0.3).tolist()))
            truth[item] = s
    return rows, truth


def plain(rows, k, rounds):
    out = {}
    for device in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == device]
        ids, x = np.array([r[1] for r in own]), np.array([r[2] for r in own])
        start = np.lexsort((ids, hash_array(ids, np.zeros(1, dtype=np.int64), 61)))[:k]
        centre = x[start].copy()
        for _ in range(rounds):
            near = ((x[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
            for s in range(len(centre)):
                if (near == s).any():
                    centre[s] = np.floor(np.abs(x[near == s]) * scenes.UNIT + 0.5).__mul__(np.sign(x[near == s])).sum(axis=0) / (near == s).sum() / scenes.UNIT
        out[device] = centre
    return out


def test_centres_equal_a_plain_k_means_whatever_the_partitions(spark):
    rows, _ = planted()
    want = plain(rows, 4, 5)
    seen = []
    for parts in (1, 3, 8):
        df = spark.createDataFrame(rows, "device string, item long, vec array<double>").repartition(parts)
        got = {(r["device"], r["scene"]): r["k"] for r in scenes.device_centres(df, 4, 5).collect()}
        seen.append(got)
        assert len(got) == 12
    assert seen[0] == seen[1] == seen[2]
    for (device, scene), k in seen[0].items():
        assert np.allclose(k, want[device][scene], atol=1e-9)


def test_labels_agree_between_devices(spark):
    # centres of equal scenes in another order on each device
    centre = 5 * np.eye(4, 6)
    rows = [(f"d{d}", s, centre[(s + d) % 4].tolist()) for d in range(3) for s in range(4)] + [("e", 0, centre[2].tolist())]
    got = scenes.matched_labels(spark.createDataFrame(rows, "device string, scene int, k array<double>")).collect()
    assert {(r["device"], r["scene"]): r["label"] for r in got} == {(f"d{d}", s): (s + d) % 4 for d in range(3) for s in range(4)} | {("e", 0): 2}


def test_best_assignment_is_the_best_of_all():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 3), (3, 5), (6, 6)):
        g = rng.normal(size=(n, m))
        best = max(permutations(range(m), n), key=lambda p: sum(g[i, j] for i, j in enumerate(p)))
        assert scenes.best_assignment(g) == list(best)
    assert scenes.best_assignment(np.zeros((3, 3))) == [0, 1, 2]


def test_scenes_of_odd_tables(spark):
    kind = "device string, item long, vec array<float>, scene string"
    rows = [("a", 1, [1.0, 0.0], "x"), ("a", 2, [1.0, 0.0], "x"), ("b", 3, None, "x"), (None, 4, [1.0, 0.0], "x"), ("c", 5, [0.0, 0.0], "x")]
    got = scenes.device_scenes(spark.createDataFrame(rows, kind), "device", "item", "vec", 3, 2).collect()
    assert sorted((r["device"], r["item"]) for r in got) == [("a", 1), ("a", 2), ("c", 5)]
    assert scenes.device_scenes(spark.createDataFrame([], kind), "device", "item", "vec", 3, 1).count() == 0
