"""Operators on hand-worked cases, edge cases and invariances."""

import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from contrapair.operators import audit, ingest, splits
from contrapair.operators import contrasts as cn
from contrapair.operators import models as md
from contrapair.operators import nearcopy as nc
from contrapair.operators import resample as rs
from contrapair.operators import scoring as sc
from contrapair.operators import signatures as sg

# published per-adapter contrasts are far below 1e-4; these are round numbers of that size
A_MEANS = [3e-5, -1e-5, 4e-5, 2e-5]
B_MEANS = [1e-5, -2e-5, 5e-6, -1e-5]


def test_sign_flip_worked(spark):
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate([1.0, -2.0, 3.0, 0.5])] + [("one", 0, 2.0)], "arm string, seed int, theta double")
    got = {r["arm"]: r for r in rs.sign_flip(df, "arm", "seed", "theta").collect()}
    assert got["g"]["p"] == 5 / 16 and got["g"]["floor"] == 1 / 16
    assert got["one"]["p"] == 0.5


def test_sign_flip_all_zero_is_one(spark):
    df = spark.createDataFrame([("g", i, 0.0) for i in range(5)], "arm string, seed int, theta double")
    assert rs.sign_flip(df, "arm", "seed", "theta").first()["p"] == 1.0


def test_label_permutation_brute_force(spark):
    from itertools import combinations

    a, b = [5, 7, 1], [2, 3, 0, 4]
    rows = [("A", i, float(v)) for i, v in enumerate(a)] + [("B", i, float(v)) for i, v in enumerate(b)]
    df = spark.createDataFrame(rows, "arm string, seed int, theta double")
    got = rs.label_permutation(df, "arm", ["arm", "seed"], "theta").first()
    sums = [sum(c) for c in combinations(a + b, 3)]
    assert got["relabellings"] == len(sums) and got["hits"] == sum(s >= sum(a) for s in sums)


def test_two_sample_monte_carlo_takes_exact_group_size(spark):
    """With every value 1 each replicate's sum is nA, so every replicate ties the observed one."""
    df = spark.createDataFrame([(i, i < 37, 1.0) for i in range(101)], "id bigint, a boolean, v double")
    got = rs.monte_carlo_two_sample(df, F.col("a"), F.col("id"), "v", 9, 1, cells=8).first()
    assert got["reps"] == 9 and got["hits"] == 9


def test_seed_numbers_sort_as_numbers(spark):
    df = spark.createDataFrame([("A_raw_s10_r16",), ("A_raw_s2_r16",), ("junk",)], "tag string")
    got = [r["seed"] for r in cn.parse_tag(df).orderBy("seed").collect()]
    assert got == [2, 10]


def test_pairing_is_by_key_and_missing_partner_is_reported(spark):
    rows = [("t", 1, "A", 5.0), ("t", 1, "B", 3.0), ("t", 2, "A", 9.0), ("t", 3, "B", 1.0), ("t", 4, "A", 1.0), ("t", 4, "B", 4.0)]
    df = spark.createDataFrame(rows, "tag string, gen_idx bigint, K string, rho double")
    c = {r["gen_idx"]: r["c"] for r in cn.paired_contrast(df, ["tag", "gen_idx"], "K", "rho", F.lit("A"), F.lit("B")).collect()}
    assert c == {1: 2.0, 4: -3.0}
    assert {r["gen_idx"] for r in cn.unpaired(df, ["tag", "gen_idx"], "K", F.lit("A"), F.lit("B")).collect()} == {2, 3}


def _means(spark, a=A_MEANS, b=B_MEANS):
    rows = [("A", f"A{i}", i, v) for i, v in enumerate(a)] + [("B", f"B{i}", i, v) for i, v in enumerate(b)]
    return spark.createDataFrame(rows, "arm string, tag string, seed int, theta double")


def test_limits_scale_and_swap(spark, near):
    base = cn.welch(cn.max_arm_limit(cn.symmetric_parts(cn.two_arms(_means(spark), "arm", "theta")))).first()
    big = cn.max_arm_limit(cn.symmetric_parts(cn.two_arms(_means(spark, [10 * v for v in A_MEANS], [10 * v for v in B_MEANS]), "arm", "theta"))).first()
    swap = cn.symmetric_parts(cn.two_arms(_means(spark, B_MEANS, A_MEANS), "arm", "theta")).first()
    near(big["u_max"], 10 * base["u_max"])
    near(swap["theta_sym"], base["theta_sym"])
    near(swap["additive"], -base["additive"])
    a, b = np.array(A_MEANS), np.array(B_MEANS)
    va, vb = a.var(ddof=1) / 4, b.var(ddof=1) / 4
    near(base["df"], (va + vb) ** 2 / (va**2 / 3 + vb**2 / 3))


def test_single_adapter_has_no_limit(spark):
    x = cn.max_arm_limit(cn.two_arms(_means(spark, [1e-5], B_MEANS), "arm", "theta")).first()
    assert x["u_A"] is None and x["sA"] is None and x["u_B"] is not None


def test_leave_one_out_matches_numpy(spark, near):
    got = {r["tag"]: r for r in cn.leave_one_out_limits(_means(spark), "arm", "tag", "theta").collect()}
    rest = np.array(A_MEANS[1:])
    near(got["A0"]["theta"], rest.mean())
    near(got["A0"]["sd"], rest.std(ddof=1), 1e-6)


def test_auc_half_ties(spark):
    rows = [("own", 1.0), ("own", 2.0), ("cross", 1.0), ("cross", 0.0)]
    df = spark.createDataFrame(rows, "kind string, s double")
    assert cn.auc(df, [], "s", F.col("kind") == "own").first()["auc"] == 3.5 / 4
    same = spark.createDataFrame([("own", 1.0)] * 3 + [("cross", 1.0)] * 5, "kind string, s double")
    assert cn.auc(same, [], "s", F.col("kind") == "own").first()["auc"] == 0.5


def test_tied_candidates_go_to_the_first(spark):
    df = spark.createDataFrame([(1, "B", 0.5), (1, "A", 0.5), (1, "C", 0.1)], "i int, K string, rho double")
    assert cn.top_candidate(df, ["i"], "K", "rho").first()["picked"] == "A"


def test_zero_variance_item_scores_zero(spark):
    df = spark.createDataFrame([([1.0, 1.0, 1.0], [1.0, 2.0, 3.0])], "w array<double>, z array<double>")
    assert df.select(sc.ncc(F.col("w"), F.col("z"))).first()[0] == 0.0


def test_flat_item_is_an_error(spark):
    df = spark.createDataFrame([([5.0] * 8,)], "y array<double>")
    with pytest.raises(PySparkException):
        sg.standardised_residual(df, "y", "w").collect()


def test_plugged_residual(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0],)], "y array<double>")
    got = sg.plugged_residual(df, "y", "w", lambda v: v - v.mean()).first()["w"]
    v = np.array([1.0, 2.0, 4.0])
    assert np.allclose(got, (v - v.mean()) / v.std())


def test_signature_and_scores_match_numpy(spark, near):
    rng = np.random.default_rng(0)
    y, w = rng.normal(10, 1, (6, 16)), rng.normal(0, 1, (6, 16))
    df = spark.createDataFrame([(i, "d", y[i].tolist(), w[i].tolist()) for i in range(6)], "id int, device string, y array<double>, w array<double>")
    k = sg.to_arrays(sg.multiplicative(df, ["device"]), ["device"]).first()["k"]
    want = (w * y).sum(0) / (y * y).sum(0)
    assert np.allclose(k, want)
    t = spark.createDataFrame([("d", k)], "K string, tk array<double>")
    got = {r["id"]: r for r in sc.score(df, t).collect()}
    near(got[3]["rho_mult"], np.corrcoef(w[3], y[3] * want)[0, 1], 1e-9)
    near(got[3]["rho_add"], np.corrcoef(w[3], want)[0, 1], 1e-9)


def test_grid_centring_and_band_map(spark):
    rng = np.random.default_rng(1)
    k = rng.normal(size=(4, 8))
    df = spark.createDataFrame([("d", k.ravel().tolist())], "device string, k array<double>")
    got = np.array(sg.zero_mean_grid(df, ["device"], 8).first()["k"]).reshape(4, 8)
    want = k - k.mean(1, keepdims=True)
    assert np.allclose(got, want - want.mean(0))
    flat = df.select(sg.band_map(F.array_repeat(F.lit(3.0), 16), 8, 1, 5).alias("b")).first()["b"]
    assert np.allclose(flat, 0)


def test_shared_part_removed(spark):
    rng = np.random.default_rng(2)
    k = rng.normal(size=(3, 12)) + rng.normal(size=12)
    rows = [(str(d), p, float(k[d, p])) for d in range(3) for p in range(12)]
    df = spark.createDataFrame(rows, "device string, pos bigint, k double")
    got = {(r["device"], r["pos"]): r["k"] for r in sg.without_shared_part(df, "device").collect()}
    m = (k[1] + k[2]) / 2
    a = m - m.mean()
    a /= np.linalg.norm(a)
    kc = k[0] - k[0].mean()
    assert np.allclose([got[("0", p)] for p in range(12)], kc - (kc @ a) * a)


def _vectors(n, d, seed):
    v = np.random.default_rng(seed).normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture()
def copies(spark):
    """Many references around few centres, one centre holding most of them, exact copies among them."""
    rng = np.random.default_rng(5)
    centres = _vectors(5, 8, 6)
    which = np.where(rng.random(400) < 0.5, 0, rng.integers(0, 5, 400))
    refs = centres[which] + 0.05 * rng.normal(size=(400, 8))
    refs[100:160] = refs[7]
    items = np.vstack([centres[rng.integers(0, 5, 60)] + 0.05 * rng.normal(size=(60, 8)), _vectors(20, 8, 9), refs[7:8]])
    mk = lambda v: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")
    cos = (items / np.linalg.norm(items, axis=1, keepdims=True)) @ (refs / np.linalg.norm(refs, axis=1, keepdims=True)).T
    return mk(items), mk(refs), cos


def test_nearest_equals_brute_force(spark, copies, monkeypatch):
    items, refs, cos = copies
    monkeypatch.setattr(nc, "PIVOTS", 12)
    monkeypatch.setattr(nc, "BALL_ROWS", 16)
    got = {r["id"]: r for r in nc.nearest(items, refs, "id", "id", "v").collect()}
    assert len(got) == len(cos)
    for i, row in enumerate(cos):
        assert abs(got[i]["sim"] - row.max()) < 1e-9
    assert got[80]["ref_id"] == 7


def test_threshold_join_counts_copies(spark, copies, monkeypatch):
    items, refs, cos = copies
    monkeypatch.setattr(nc, "PIVOTS", 12)
    monkeypatch.setattr(nc, "BALL_ROWS", 16)
    for r in nc.similar_rows(items, refs, "id", "id", "v", [0.5, 0.9, 0.99]).collect():
        hit = cos >= r["threshold"]
        assert (r["pairs"], r["items_hit"], r["refs_hit"]) == (hit.sum(), hit.any(1).sum(), hit.any(0).sum())


def test_pruning_skips_balls(spark, copies):
    """The planned work shrinks: close items meet far fewer references than there are."""
    items, refs, cos = copies
    p = nc.candidate_pairs(items, refs, "id", "id", "v", nc.COSINE, threshold=0.99, best=False)
    assert p.count() == (cos >= 0.99).sum()


def planted(n: int):
    """n references, n / 10 items that are near copies of some of them."""
    rng = np.random.default_rng(11)
    refs = rng.normal(size=(n, 16))
    items = refs[:: 10] + 0.002 * rng.normal(size=(len(refs[::10]), 16))
    return refs, items


@pytest.mark.parametrize("best", [True, False])
def test_tree_of_balls_visits_few_pairs(spark, monkeypatch, best):
    """Best matches and joins stay exact over several levels and visit few pairs; those of joins grow slower than all pairs.

    A few items go down to a leaf beside their copy's and then look everywhere, so a best match keeps a small share.
    """
    monkeypatch.setattr(nc, "PIVOTS", 12)
    monkeypatch.setattr(nc, "BALL_ROWS", 32)
    share = []
    for n in (1000, 4000):
        refs, items = planted(n)
        r, i = (spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "id long, v array<double>") for m in (refs, items))
        a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (items, refs))
        if best:
            got = {x["id"]: x["ref_id"] for x in nc.nearest(i, r, "id", "id", "v").collect()}
            assert got == {k: int(j) for k, j in enumerate((a @ b.T).argmax(axis=1))}
        else:
            pairs = nc.candidate_pairs(i, r, "id", "id", "v", threshold=0.999, best=False, like=nc.COSINE).collect()
            assert {(x["id"], x["ref_id"]) for x in pairs} == set(zip(*(k.tolist() for k in np.nonzero(a @ b.T >= 0.999)), strict=True))
        unit = [spark.createDataFrame([("x", k, v.tolist()) for k, v in enumerate(m)], f"g string, {p}id long, {p}v array<double>")
                for m, p in ((a, "__i"), (b, "__r"))]
        met = nc._meetings(*unit, ["g"], [], nc.UNIT_COSINE, None if best else 0.999, best, False)
        share.append(met.agg(F.sum(F.size("__refs"))).first()[0] / (len(a) * len(b)))
    assert share[1] < 0.02 and (best or share[1] < share[0]), share


def test_diversity_with_copies(spark, copies):
    _, refs, _ = copies
    df = refs.withColumn("g", F.lit("x"))
    got = nc.diversity(df, "g", "id", "v", 0.95).first()
    v = np.array([r["v"] for r in refs.orderBy("id").collect()])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    iu = np.triu_indices(len(v), 1)
    assert got["duplicate_pairs"] == (s[iu] >= 0.95).sum()
    assert abs(got["mean_sim"] - s[iu].mean()) < 1e-9
    assert abs(got["participation"] - np.trace(s) ** 2 / (s * s).sum()) < 1e-6
    assert abs(got["max_sim"] - 1.0) < 1e-9


@pytest.mark.parametrize("few", [True, False])
def test_lots_equal_brute_force(spark, copies, monkeypatch, few):
    """Tallies, pairs and best matches by lots alone, and by the tree for items it spares and lots for the others."""
    items, refs, cos = copies
    for name, value in (("PIVOTS", 12), ("BALL_ROWS", 16), ("LOT_ROWS", 50), ("PRODUCT", 300), ("SPARSE", 3)):
        monkeypatch.setattr(nc, name, value)
    if not few:
        monkeypatch.setattr(nc, "DENSE_REFS", 0)
        at = nc._meeting(items, refs, "id", "id", "v", nc.COSINE, None, 0.5, False, False, [], [])
        assert 0 < at.sparse.count() < len(cos) and at.sparse.count() + at.dense.count() == len(cos)
    pairs = nc.candidate_pairs(items, refs, "id", "id", "v", nc.COSINE, threshold=0.5, best=False).collect()
    assert sorted((r["id"], r["ref_id"]) for r in pairs) == sorted(zip(*(k.tolist() for k in np.nonzero(cos >= 0.5)), strict=True))
    got = {r["id"]: r["sim"] for r in nc.nearest(items, refs, "id", "id", "v").collect()}
    assert all(abs(got[i] - row.max()) < 1e-9 for i, row in enumerate(cos))
    met = nc.tallies(items, refs, "id", "id", "v", [0.5, 0.99], best=True).collect()
    for t in (0.5, 0.99):
        mine = {r["id"]: (r["pairs"], r["m"]) for r in met if r["threshold"] == t and r["id"] is not None and r["pairs"]}
        assert mine == {i: (n, 1) for i, n in enumerate((cos >= t).sum(axis=1).tolist()) if n}
        assert sum(r["m"] for r in met if r["threshold"] == t and r["id"] is None) == (cos >= t).any(axis=0).sum()
    assert {r["id"] for r in met if r["threshold"] == 0.5 and r["id"] is not None} == set(range(len(cos)))


def test_unclustered_vectors_meet_in_few_lots(spark):
    """Vectors that no tree spares are dealt to lots of references, not to each of its leaves."""
    rng = np.random.default_rng(5)
    mk = lambda n: spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(n, 64)))], "id long, v array<double>")
    at = nc._meeting(mk(500), mk(2000), "id", "id", "v", nc.COSINE, None, 0.3, False, False, [], [])
    assert at.sparse is None and nc._lots(at.dense, at.refs, at.group).count().agg(F.sum("count")).first()[0] == 2500


def test_hamming_nearest(spark):
    rng = random.Random(3)
    a, b = [rng.getrandbits(63) for _ in range(40)], [rng.getrandbits(63) for _ in range(90)]
    b[5] = a[0] ^ 0b101
    mk = lambda x: spark.createDataFrame(list(enumerate(x)), "id bigint, v bigint")
    got = {r["id"]: -r["sim"] for r in nc.nearest(mk(a), mk(b), "id", "id", "v", nc.HAMMING).collect()}
    assert got == {i: min(bin(x ^ y).count("1") for y in b) for i, x in enumerate(a)}
    assert got[0] == 2


@pytest.mark.parametrize("few", [True, False])
def test_codes_meet_in_lots(spark, monkeypatch, few):
    """Codes that no tree spares meet in lots as well; with the tree beside them the results are the same."""
    rng = np.random.default_rng(6)
    b = rng.integers(0, 1 << 63, 700).tolist()
    a = [x ^ 1 << k % 63 for k, x in enumerate(b[:100])] + rng.integers(0, 1 << 63, 200).tolist() + [0, -1]
    far = np.bitwise_count(np.array(a)[:, None] ^ np.array(b)).astype(int)
    far[-1] = [bin((x ^ -1) & (1 << 64) - 1).count("1") for x in b]
    mk = lambda x: spark.createDataFrame(list(enumerate(x)), "id bigint, v bigint")
    for name, value in (("PIVOTS", 12), ("BALL_ROWS", 16), ("LOT_ROWS", 50), ("PRODUCT", 300), ("SPARSE", 3)):
        monkeypatch.setattr(nc, name, value)
    if not few:
        monkeypatch.setattr(nc, "DENSE_REFS", 0)
    at = nc._meeting(mk(a), mk(b), "id", "id", "v", nc.HAMMING, None, None, True, False, [], [])
    assert at.dense.count() > 0 and (at.sparse is None) == few
    got = {r["id"]: (-r["sim"], r["ref_id"]) for r in nc.nearest(mk(a), mk(b + [None]), "id", "id", "v", nc.HAMMING).collect()}
    assert got == {i: (row.min(), int(row.argmin())) for i, row in enumerate(far)}
    pairs = nc.candidate_pairs(mk(a), mk(b), "id", "id", "v", nc.HAMMING, threshold=-20.0, best=False).collect()
    assert sorted((r["id"], r["ref_id"]) for r in pairs) == sorted(zip(*(k.tolist() for k in np.nonzero(far <= 20)), strict=True))
    met = nc.tallies(mk(a), mk(b), "id", "id", "v", [-20.0], nc.HAMMING).where("id is not null").collect()
    assert {r["id"]: r["pairs"] for r in met} == {i: n for i, n in enumerate((far <= 20).sum(axis=1).tolist()) if n}


def test_lowrank_inner_equals_full_product(spark, near):
    rng = np.random.default_rng(4)
    rows, dense = [], {}
    for tag in "xy":
        dense[tag] = 0
        for layer in range(3):
            a, b = rng.normal(size=(2, 5)), rng.normal(size=(4, 2))
            rows.append((tag, layer, a.ravel().tolist(), b.ravel().tolist()))
            dense[(tag, layer)] = b @ a
    df = spark.createDataFrame(rows, "tag string, layer int, a array<double>, b array<double>")
    got = {(r["tag_x"], r["tag_y"]): r["cosine"] for r in nc.weight_cosines(nc.weight_inner(df, "tag", "layer", "a", "b", 2)).collect()}
    ip = lambda s, t: sum((dense[(s, i)] * dense[(t, i)]).sum() for i in range(3))
    near(got[("x", "y")], ip("x", "y") / math.sqrt(ip("x", "x") * ip("y", "y")), 1e-9)


def test_weights_of_different_shapes_and_ranks(spark, near):
    rng = np.random.default_rng(9)
    shape = {0: (3, 7), 1: (5, 2)}
    rank = {"x": 2, "y": 3, "z": 1}
    rows, dense = [], {}
    for tag, r in rank.items():
        for layer, (out, across) in shape.items():
            a, b = rng.normal(size=(r, across)), rng.normal(size=(out, r))
            rows.append((tag, layer, a.ravel().tolist(), b.ravel().tolist(), r))
            dense[tag, layer] = b @ a
    df = spark.createDataFrame(rows, "tag string, layer int, a array<double>, b array<double>, r int")
    for got in nc.weight_inner(df, "tag", "layer", "a", "b", "r").collect():
        near(got["inner"], sum((dense[got["tag_x"], i] * dense[got["tag_y"], i]).sum() for i in shape), 1e-9)
    bad = spark.createDataFrame([("x", 0, [1.0, 2.0], [1.0], 1), ("y", 0, [1.0, 2.0, 3.0], [1.0], 1)], df.schema)
    with pytest.raises(PySparkException):
        nc.weight_inner(bad, "tag", "layer", "a", "b", "r").collect()


@pytest.mark.parametrize("n", [5, 64, 70])
def test_arrays_of_any_length_keep_their_tail(spark, n):
    df = spark.createDataFrame([(3, [float(i) for i in range(n)])], "id long, k array<double>")
    shuffled = df.select(sg.shuffle_blocks(F.col("k"), F.col("id"), 8, 31).alias("s")).first()["s"]
    assert sorted(shuffled) == [float(i) for i in range(n)]
    for make in (lambda: sg.zero_mean_grid(df, ["id"], 8), lambda: df.select(sg.band_map(F.col("k"), 8, 1, 5).alias("k"))):
        if n % 8:
            with pytest.raises(PySparkException):
                make().collect()
        else:
            assert len(make().first()["k"]) == n


def test_icc_of_unequal_groups(spark, near):
    groups = {"a": [1.0, 2.0, 4.0], "b": [5.0, 7.0], "c": [9.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = md.one_way_icc(df, "g", "v").first()
    every = [v for vs in groups.values() for v in vs]
    grand, k, n = np.mean(every), 3, len(every)
    msb = sum(len(v) * (np.mean(v) - grand) ** 2 for v in groups.values()) / (k - 1)
    msw = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in groups.values()) / (n - k)
    n0 = (n - sum(len(v) ** 2 for v in groups.values()) / n) / (k - 1)
    near(got["n0"], n0)
    near(got["var_u"], max((msb - msw) / n0, 0))
    near(got["icc"], got["var_u"] / (got["var_u"] + msw))


def test_auc_tie_rules(spark, near):
    rows = [("A", True, 1.0), ("A", False, 1.0), ("A", True, 2.0), ("A", False, 0.0)]
    df = spark.createDataFrame(rows, "arm string, own boolean, v double")
    near(cn.auc(df, ["arm"], "v", F.col("own")).first()["auc"], 3.5 / 4)
    near(cn.auc(df, ["arm"], "v", F.col("own"), ties="ordinal").first()["auc"], 3 / 4)
    with pytest.raises(ValueError):
        cn.auc(df, ["arm"], "v", F.col("own"), ties="none")


def test_rank_among_independent_fields(spark):
    rng = np.random.default_rng(1)
    from contrapair.functions.hashing import hash_array

    k = rng.normal(size=40)
    y, w = rng.normal(10, 1, (8, 40)), rng.normal(size=(8, 40)) + 0.3 * k
    items = spark.createDataFrame([("d", y[i].tolist(), w[i].tolist()) for i in range(8)], "device string, y array<double>, w array<double>")
    t = spark.createDataFrame([("d", k.tolist())], "device string, k array<double>")
    got = sc.field_rank(items, t, 30, 37).first()
    sign = lambda j: ((hash_array(np.arange(40), np.array([j]), 37) >> 16) & 1) * 2 - 1
    mean = lambda f: np.mean([np.corrcoef(w[i], y[i] * f)[0, 1] for i in range(8)])
    decoys = [mean(sign(j)) for j in range(1, 31)]
    assert got["rank"] == 1 + sum(m > mean(k) for m in decoys) and abs(got["best_decoy"] - max(decoys)) < 1e-9


def test_splits_leave_guards(spark):
    df = spark.createDataFrame([("d", i) for i in range(20)], "device string, id bigint")
    got = {r["id"]: r["split"] for r in splits.sized_splits(df, "device", ["id"], [("E1", 4), ("H", 5)], 3).collect()}
    assert [got[i] for i in range(20)] == ["E1"] * 4 + ["guard"] * 3 + ["H"] * 5 + ["guard"] * 8


def test_allocation_uses_every_item(spark):
    cap = spark.createDataFrame([("s", 10), ("t", 7), ("u", 0)], "stratum string, cap bigint")
    got = splits.largest_remainder(cap, "stratum", {"E1": 20, "E2": 32, "T": 16}).groupBy("stratum").agg(F.sum("alloc").alias("n")).collect()
    assert {r["stratum"]: r["n"] for r in got} == {"s": 10, "t": 7, "u": 0}


def test_burst_gap_brute_force(spark):
    rng = random.Random(7)
    rows = [("d", rng.choice("EHT"), rng.randrange(10_000), i) for i in range(120)]
    df = spark.createDataFrame(rows, "device string, split string, ts bigint, id bigint")
    got = {(r["split_a"], r["split_b"]): r["gap"] for r in splits.smallest_gaps(df, "device", "split", "ts", "id", ["E", "H", "T"]).collect()}
    for a, b in (("E", "H"), ("E", "T"), ("H", "T")):
        assert got[(a, b)] == min(abs(x[2] - y[2]) for x in rows for y in rows if x[1] == a and y[1] == b)


def test_duplicates(spark):
    df = spark.createDataFrame([("k", 1.0), ("k", 1.0), ("j", 2.0)], "key string, v double")
    assert {r["key"]: r["v"] for r in ingest.collapse_duplicates(df, ["key"], "v").collect()} == {"k": 1.0, "j": 2.0}
    bad = df.unionByName(spark.createDataFrame([("j", 3.0)], "key string, v double"))
    with pytest.raises(PySparkException):
        ingest.collapse_duplicates(bad, ["key"], "v").collect()


def test_unknown_column_is_an_error(spark):
    df = spark.createDataFrame([(1,)], "surprise int")
    with pytest.raises(ValueError):
        ingest.resolve_aliases(df, {"rho": ["rho", "corr"]})


def test_log_restart_keeps_last_complete_run(spark):
    lines = ["[01:02:03] a 1/3 loss 0.9", "[01:02:04] a 2/3 loss 0.8", "noise", "[01:02:05] a 1/3 loss 0.7", "[01:02:06] a 2/3 loss 0.6",
             "[01:02:07] a 3/3 loss 0.5", "[01:02:08] a 1/3 loss 0.4"]
    df = spark.createDataFrame(list(enumerate(lines)), "seq bigint, line string")
    got = ingest.last_complete_run(ingest.parse_log(df, "line"), "job", "seq", "step", 1, 3).orderBy("step").collect()
    assert [r["loss"] for r in got] == [0.7, 0.6, 0.5]


def test_ledger_statuses(spark):
    led = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 0.5), ("c", 3.0, None), ("d", 1.0, None)], "name string, expected double, tol double")
    got = spark.createDataFrame([("a", 1.005), ("b", 2.9), ("d", 1.2), ("e", 4.0)], "name string, got double")
    s = {r["name"]: r["status"] for r in audit.ledger_check(led, got).collect()}
    assert s == {"a": "OK", "b": "OK", "c": "SKIP", "d": "DISAGREE", "e": "INFO"}


def test_union_length(spark):
    rows = [("j", 0, 10, 0), ("j", 2, 5, 1), ("j", 10, 12, 2), ("j", 20, 21, 3)]
    df = spark.createDataFrame(rows, "j string, s bigint, e bigint, id bigint")
    r = audit.union_length(df, ["j"], "s", "e", "id").first()
    assert (r["covered"], r["islands"]) == (13, 2)


def test_manifest_stamp_tells_nulls_and_marks_apart(spark):
    rows = [("x", None, "y"), ("x", "y", None), ("x", "-", "y"), ("x1", ":y", None), ("x", "1:y", None)]
    stamps = {audit.manifest_stamp(spark.createDataFrame([r], "a string, b string, c string"), ["a", "b", "c"], {}).first()["stamp"] for r in rows}
    assert len(stamps) == len(rows)


def test_log_reads_any_number(spark):
    lines = ["[00:00:01] j1 1/3 loss 1e-05", "[00:00:02] j1 2/3  loss nan", "[00:00:03] j1 3/3 loss 0.25 more", "[00:00:04] j1 x/3 loss 1", "[00:00:05] j1 3/3 loss", "", "note"]
    got = ingest.parse_log(spark.createDataFrame([(x,) for x in lines], "line string"), "line").orderBy("step").collect()
    assert [(r["job"], r["step"], r["total"], str(r["loss"])) for r in got] == [("j1", 1, 3, "1e-05"), ("j1", 2, 3, "nan"), ("j1", 3, 3, "0.25")]


def test_manifest_stamp_ignores_order_but_not_content(spark):
    df = spark.createDataFrame([(i, f"d{i % 3}") for i in range(50)], "id bigint, device string")
    stamp = lambda x, c: audit.manifest_stamp(x, ["id", "device"], c).first()["stamp"]
    a = stamp(df, {"v": 1})
    assert a == stamp(df.orderBy(F.desc("id")).repartition(7), {"v": 1})
    assert a != stamp(df, {"v": 2}) and a != stamp(df.where("id > 0"), {"v": 1})
    assert audit.is_current(a, audit.manifest_stamp(df, ["id", "device"], {"v": 1})) and not audit.is_current(None, audit.manifest_stamp(df, ["id"], {}))


def test_energy_distance_brute_force(spark, near):
    rng = np.random.default_rng(8)
    x, y = np.round(rng.normal(size=40), 1), np.round(rng.normal(0.5, 1, 30), 1)
    df = spark.createDataFrame([("A", float(v)) for v in x] + [("B", float(v)) for v in y], "arm string, v double")
    d = lambda p, q: np.abs(p[:, None] - q[None, :]).mean()
    near(cn.energy_distance(df, "v", F.col("arm") == "A").first()["energy"], 2 * d(x, y) - d(x, x) - d(y, y), 1e-9)


def test_crossed_anova_rejects_unbalanced(spark):
    rows = [("A", s, j, float(s * j)) for s in range(3) for j in range(4)][:-1]
    df = spark.createDataFrame(rows, "arm string, seed int, j int, x double")
    with pytest.raises(PySparkException):
        md.crossed_anova(df, "arm", "seed", "j", "x").collect()


def test_pooling_of_equal_estimates(spark, near):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 1.0), (2.0, 1.0)], "v double, se double")
    r = md.pool_estimates(df, "v", "se").first()
    near(r["fixed"], 2.0)
    near(r["fixed_se"], 1 / math.sqrt(3))
    assert r["tau2"] == 0.0 and r["i2"] == 0.0 and r["quoted"] == "fixed"


def test_incomplete_block_is_dropped(spark):
    rows = [("t", "A", i, k, float(k == "A")) for i in range(7) for k in "AB"]
    df = spark.createDataFrame(rows, "tag string, own string, i bigint, K string, rho double")
    got = rs.attribute(rs.block_means(df, "tag", "own", "K", "rho", "i", 3), "tag", "own", "K").collect()
    assert len(got) == 2 and all(r["picked"] == "A" for r in got)


def test_holm_worked(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "n string, p double")
    got = {r["n"]: r["reject"] for r in rs.holm(df, "n", "p", 0.05).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": True}


def test_tests_tell_null_from_effect(spark):
    """A centred arm must not reject and a shifted one must, or the test shows nothing."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=12)
    base -= base.mean()
    rows = [("null", i, float(v)) for i, v in enumerate(base)] + [("shift", i, float(v + 2.5)) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "arm string, seed int, theta double")
    p = {r["arm"]: r["p"] for r in rs.sign_flip(df, "arm", "seed", "theta").collect()}
    assert 0.3 < p["null"] < 0.7 and p["shift"] < 0.01


@pytest.mark.parametrize("names", [["0", "1", "2", "3", "4", "5", "6", "7", "8"], [str(i) for i in range(12)], ["x1", "cam b", "Ä"], ["alone"]])
def test_ring_of_devices_comes_from_the_data(spark, names):
    rows = spark.createDataFrame([(n,) for n in names + names[:2] + [None]], "device string")
    ring = splits.device_ring(rows)
    order = sorted(names)
    want = {(d, order[(i + 1) % len(order)], i) for i, d in enumerate(order)}
    got = ring.collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    facts = spark.createDataFrame([(n, "k" + n) for n in names], "device string, k string")
    assert {tuple(r) for r in splits.of_next_device(facts, ring).select("device", "k").collect()} == {(d, "k" + n) for d, n, _ in want}
