"""Signature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrapair.operators import poisson
from contrapair.operators import signatures as op
from contrapair.operators.poisson import item_copies_sql
from contrapair.operators.splits import estimate_variants
from contrapair.plans import derived as d
from contrapair.plans.registry import query
from contrapair.plans.sqlkit import oracle, r, rounded, view
from contrapair.session import materialise

K_SQL = "sum(w * y) / greatest(sum(y * y), 1e-6)"
view("v_sig", f"SELECT device, split, pos, {K_SQL} AS k FROM v_planted WHERE split <> 'guard' GROUP BY device, split, pos")
view("v_e2", "SELECT device, pos, k FROM v_sig WHERE split = 'E2'")
view("v_e1", "SELECT device, pos, k FROM v_sig WHERE split = 'E1'")


def signature_rows(spark, sf, split):
    return op.multiplicative(d.planted(spark, sf).where(F.col("split") == split), ["device"])


def signature_arrays(x, split):
    """Device signatures of one split from an already planted table."""
    return op.to_arrays(op.multiplicative(x.where(F.col("split") == split), ["device"]), ["device"])


@query("c1_residual", oracle(f"SELECT vec_id, pos, {r('w', 6)} AS w FROM v_planted"))
def residual(spark, sf):
    return op.positions(d.planted(spark, sf), ["vec_id"], w="w").withColumn("w", rounded("w", 6))


@query("c2_signature", oracle(f"SELECT device, split, pos, {r('k')} AS k FROM v_sig"))
def signature(spark, sf):
    x = d.planted(spark, sf).where("split <> 'guard'")
    return op.multiplicative(x, ["device", "split"]).withColumn("k", rounded("k"))


@query("c3_mean_map", oracle(f"""SELECT device, split, pos, {r('avg(w)')} AS k FROM v_planted WHERE split <> 'guard'
    GROUP BY device, split, pos"""))
def mean_map(spark, sf):
    x = d.planted(spark, sf).where("split <> 'guard'")
    return op.mean_map(x, ["device", "split"], "w").withColumn("k", rounded("k"))


@query("c4_zero_mean_grid", oracle(f"""SELECT device, pos, {r('k1 - avg(k1) OVER (PARTITION BY device, pos % 8)')} AS k FROM
    (SELECT device, pos, k - avg(k) OVER (PARTITION BY device, pos // 8) AS k1 FROM v_e2)"""))
def zero_mean_grid(spark, sf):
    x = op.to_arrays(signature_rows(spark, sf, "E2"), ["device"])
    return op.positions(op.zero_mean_grid(x, ["device"], 8), ["device"], k="k").withColumn("k", rounded("k"))


@query("c5_without_shared_part", oracle(f"""SELECT device, pos, {r('k - mk - b * (o - mo)')} AS k FROM oth JOIN
    (SELECT device, avg(k) AS mk, avg(o) AS mo, (sum(k * o) - count(*) * avg(k) * avg(o)) /
    (sum(o * o) - count(*) * avg(o) * avg(o)) AS b FROM oth GROUP BY device) USING (device)""",
    oth="""SELECT device, pos, k, (sum(k) OVER (PARTITION BY pos) - k) / (count(*) OVER (PARTITION BY pos) - 1) AS o FROM v_e2"""))
def without_shared_part(spark, sf):
    return op.without_shared_part(signature_rows(spark, sf, "E2"), "device").withColumn("k", rounded("k"))


@query("c6_defect_split", oracle(f"""SELECT device, pos, {r('k')} AS k, dev > 3.0 * m / 0.6745 AS defect FROM dv JOIN
    (SELECT device, quantile_cont(dev, 0.5) AS m FROM dv GROUP BY device) USING (device)""",
    dv="""SELECT device, pos, k, abs(k - median(k) OVER (PARTITION BY device ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
    AS dev FROM v_e2"""))
def defect_split(spark, sf):
    x = materialise(op.to_arrays(signature_rows(spark, sf, "E2"), ["device"]))
    return op.defect_split(x, ["device"], factor=3.0).withColumn("k", rounded("k"))


REPS = 6
view("v_bootsig", f"""SELECT rep, device, pos, sum(m * w * y) / greatest(sum(m * y * y), 1e-6) AS k FROM
    (SELECT *, {item_copies_sql('vec_id', 'rep', None, 23)} AS m FROM v_planted, range(0, {REPS}) t(rep) WHERE split = 'E2') GROUP BY rep, device, pos""")


def bootstrap_signatures(x, reps=REPS):
    """Signatures of each bootstrap replicate of the E2 items: one pass for all replicates."""
    return poisson.bootstrap_signatures(x.where("split = 'E2'"), "device", "vec_id", "y", "w", reps, 23)


@query("c7_bootstrap_signatures", oracle(f"SELECT rep, device, pos, {r('k')} AS k FROM v_bootsig"))
def bootstrap(spark, sf):
    out = bootstrap_signatures(materialise(d.planted(spark, sf)))
    return out.select("rep", "device", "pos", rounded("k").alias("k"))


@query("c8_band_map", oracle(f"""SELECT vec_id, (pos // 8) * 8 + o AS pos, {r('sum(coef * w)', 6)} AS w FROM v_planted JOIN basis ON i = pos % 8
    GROUP BY vec_id, pos // 8, o""",
    basis="""SELECT o.v AS o, i.v AS i, sum(0.25 * cos(pi() * (2 * o.v + 1) * k.v / 16) * cos(pi() * (2 * i.v + 1) * k.v / 16)) AS coef
    FROM range(0, 8) o(v), range(0, 8) i(v), range(1, 6) k(v) GROUP BY ALL"""))
def band_map(spark, sf):
    x = d.planted(spark, sf).withColumn("w", op.band_map(F.col("w"), 8, 1, 5))
    return op.positions(x, ["vec_id"], w="w").withColumn("w", rounded("w", 6))


@query("c9_periodic_part", oracle(f"SELECT vec_id, pos, {r('avg(w) OVER (PARTITION BY vec_id, pos % 8)', 6)} AS w FROM v_planted"))
def periodic_part(spark, sf):
    x = op.periodic_part(d.planted(spark, sf), "w", 8, "p")
    return op.positions(x, ["vec_id"], w="p").withColumn("w", rounded("w", 6))


@query("c10_signature_quality", oracle(f"""SELECT device, {r('h', 6)} AS split_half, {r('p', 6)} AS pairwise,
    {r('greatest(h - p, 0)', 6)} AS device_share, {r('greatest(1 - h, 0)', 6)} AS noise_share FROM
    (SELECT a.device, corr(a.k, b.k) AS h FROM v_e1 a JOIN v_e2 b USING (device, pos) GROUP BY a.device) JOIN
    (SELECT device, avg(c) AS p FROM (SELECT a.device, b.device AS other, corr(a.k, b.k) AS c FROM v_e2 a JOIN v_e2 b USING (pos)
    WHERE a.device <> b.device GROUP BY ALL) GROUP BY device) USING (device)"""))
def signature_quality(spark, sf):
    x = materialise(op.multiplicative(d.planted(spark, sf).where("split IN ('E1', 'E2')"), ["device", "split"]))
    one = op.to_arrays(x, ["device", "split"])
    both = one.groupBy("device").agg(
        F.max(F.when(F.col("split") == "E1", F.col("k"))).alias("k1"), F.max(F.when(F.col("split") == "E2", F.col("k"))).alias("k2")
    )
    q = op.quality(both, "device", "k1", "k2")
    return q.select("device", *[rounded(c, 6).alias(c) for c in ("split_half", "pairwise", "device_share", "noise_share")])
