"""Exact-test, bootstrap, attribution and multiplicity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrapair.functions import tails as tl
from contrapair.functions import vectors as V
from contrapair.functions.critical import Z99, t995, t995_sql
from contrapair.functions.hashing import P, hash_sign_sql, portable_hash_sql
from contrapair.functions.ordered import with_rank
from contrapair.operators import contrasts as cn
from contrapair.operators import models as md
from contrapair.operators import poisson
from contrapair.operators import resample as op
from contrapair.operators import scoring as sc
from contrapair.operators import signatures as sg
from contrapair.operators.poisson import item_copies_sql
from contrapair.operators.splits import of_next_device
from contrapair.plans import contrasts as pc
from contrapair.plans import derived as d
from contrapair.plans import models as pm
from contrapair.plans.registry import query
from contrapair.plans.scoring import ncc_sql, scored
from contrapair.plans.signatures import bootstrap_signatures
from contrapair.plans.sqlkit import big, fix, i64, oracle, r, rounded, rs, view
from contrapair.session import materialise

INT = "CAST(round({0} * 1000000000 + 0.001) AS BIGINT)"
MASKED = "list_sum([CASE WHEN (m.mask >> i::INT) & 1 = 1 THEN v[i + 1] ELSE 0 END for i in range(len(v))])"

view("v_flip", f"""SELECT arm, count(*) FILTER (hit) AS hits, count(*) AS assignments, any_value(k) AS k FROM (SELECT arm, len(v) AS k,
    {MASKED} >= list_sum(v) AS hit FROM (SELECT arm, list({INT.format('theta')} ORDER BY seed) AS v FROM v_adapter GROUP BY arm) g, range(0, 4096) m(mask)
    WHERE m.mask < (1::BIGINT << len(v)::INT)) GROUP BY arm""")


@query("f1_sign_flip", oracle(f"SELECT arm, k, hits, assignments, {rs(9, p='hits / assignments', floor='1 / assignments')} FROM v_flip"))
def sign_flip(spark, sf):
    x = op.sign_flip(materialise(d.adapter_means(spark, sf)), "arm", "seed", "theta")
    return fix(x.withColumn("k", big("k")), 9, "p", "floor")


_SUM24 = " + ".join(f"CASE WHEN (mask >> {i}) & 1 = 1 THEN v[{i + 1}] ELSE 0 END" for i in range(24))


@query("f2_label_permutation", oracle(f"""SELECT {i64('any_value(n)')} AS n, {i64('any_value(na)')} AS n_first, count(*) AS relabellings, count(*) FILTER ({_SUM24} >= obs) AS hits,
    {rs(9, p=f'count(*) FILTER ({_SUM24} >= obs) / count(*)', floor='1 / count(*)')} FROM one, range(0, 16777216) t(mask) WHERE bit_count(mask) = na""",
    one=f"""SELECT list({INT.format('theta')} ORDER BY arm, seed) AS v, count(*) AS n, count(*) FILTER (arm = 'A') AS na, sum({INT.format('theta')}) FILTER (arm = 'A') AS obs FROM v_adapter"""))
def label_permutation(spark, sf):
    x = op.label_permutation(materialise(d.adapter_means(spark, sf)), "arm", ["arm", "seed"], "theta")
    return fix(x.withColumns({"n": big("n"), "n_first": big("n_first")}), 9, "p", "floor")


@query("f3_prediction_permutation", oracle(f"""SELECT {r('max(r2) FILTER (ident)', 9)} AS r2, count(*) AS permutations, count(*) FILTER (r2 >= (SELECT max(r2) FROM pm WHERE ident)) AS hits,
    {r('count(*) FILTER (r2 >= (SELECT max(r2) FROM pm WHERE ident)) / count(*)', 9)} AS p FROM pm""",
    po="""SELECT row_number() OVER (ORDER BY o_orderpriority) AS i, avg(o_totalprice) FILTER (o_custkey % 2 = 1) AS p, avg(o_totalprice) FILTER (o_custkey % 2 = 0) AS q FROM orders GROUP BY o_orderpriority""",
    perms="""SELECT a.i AS a, b.i AS b, c.i AS c, e.i AS e, f.i AS f FROM po a, po b, po c, po e, po f WHERE a.i NOT IN (b.i, c.i, e.i, f.i) AND b.i NOT IN (c.i, e.i, f.i) AND c.i NOT IN (e.i, f.i) AND e.i <> f.i""",
    pm="""SELECT a = 1 AND b = 2 AND c = 3 AND e = 4 AND f = 5 AS ident, round(1 - (pow((SELECT q FROM po WHERE i = 1) - (SELECT p FROM po WHERE i = a), 2) + pow((SELECT q FROM po WHERE i = 2) - (SELECT p FROM po WHERE i = b), 2)
    + pow((SELECT q FROM po WHERE i = 3) - (SELECT p FROM po WHERE i = c), 2) + pow((SELECT q FROM po WHERE i = 4) - (SELECT p FROM po WHERE i = e), 2) + pow((SELECT q FROM po WHERE i = 5) - (SELECT p FROM po WHERE i = f), 2))
    / (SELECT var_pop(q) * count(*) FROM po), 9) AS r2 FROM perms"""))
def prediction_permutation(spark, sf):
    """Order priorities as devices: the mean over one half of the customers predicts the other half's."""
    o = d.table(spark, sf, "orders")
    half = F.col("o_custkey") % 2
    x = materialise(o.groupBy("o_orderpriority").agg(
        F.avg(F.when(half == 1, F.col("o_totalprice"))).alias("p"), F.avg(F.when(half == 0, F.col("o_totalprice"))).alias("q")))
    return fix(op.prediction_permutation(x, "o_orderpriority", "p", "q"), 9, "r2", "p")


REPS = 49
UID = "(gen_idx * 12 + seed)"


def uid():
    return F.col("gen_idx") * 12 + F.col("seed")


@query("f4_monte_carlo_flip", oracle(f"""SELECT arm, count(*) FILTER (rep > 0) AS reps, count(*) FILTER (rep > 0 AND s >= obs) AS hits,
    {r('(count(*) FILTER (rep > 0 AND s >= obs) + 1) / (count(*) FILTER (rep > 0) + 1)', 9)} AS p FROM (SELECT *, max(s) FILTER (rep = 0) OVER (PARTITION BY arm) AS obs FROM
    (SELECT arm, rep, sum(CASE WHEN rep = 0 THEN 1 ELSE {hash_sign_sql(UID, 'rep', 41)} END * {INT.format('c')}) AS s FROM v_con, range(0, {REPS + 1}) t(rep) GROUP BY arm, rep)) GROUP BY arm"""))
def monte_carlo_flip(spark, sf):
    return fix(op.monte_carlo_sign_flip(d.contrasts(spark, sf), "arm", uid(), "c", REPS, 41), 9, "p")


@query("f4_monte_carlo_two_sample", oracle(f"""SELECT count(*) AS reps, count(*) FILTER (s >= obs) AS hits, {r('(count(*) FILTER (s >= obs) + 1) / (count(*) + 1)', 9)} AS p FROM
    (SELECT rep, sum(v) AS s FROM (SELECT rep, v, row_number() OVER (PARTITION BY rep ORDER BY {portable_hash_sql('u', 'rep', 43)}, u) AS rn FROM
    (SELECT {UID} * 2 + (arm = 'B')::INT AS u, {INT.format('c')} AS v FROM v_con), range(1, {REPS + 1}) t(rep)) WHERE rn <= (SELECT count(*) FROM v_con WHERE arm = 'A') GROUP BY rep),
    (SELECT sum({INT.format('c')}) AS obs FROM v_con WHERE arm = 'A')"""))
def monte_carlo_two_sample(spark, sf):
    u = uid() * 2 + (F.col("arm") == "B").cast("int")
    return fix(op.monte_carlo_two_sample(materialise(d.contrasts(spark, sf)), F.col("arm") == "A", u, "c", REPS, 43), 9, "p")


@query("f5_seed_pair_relabelling", oracle(f"""SELECT {r('max(s) FILTER (mask = 0) / any_value(n) / 1e9', 8)} AS d, count(*) AS relabellings,
    count(*) FILTER (s >= (SELECT s FROM st WHERE mask = 0)) AS hits, {r('count(*) FILTER (s >= (SELECT s FROM st WHERE mask = 0)) / count(*)', 9)} AS p FROM st, (SELECT count(*) FILTER (same) AS n FROM pr)""",
    z="SELECT arm, seed, j, x - avg(x) OVER (PARTITION BY arm, seed) AS z FROM v_crossed",
    pr=f"""SELECT a.seed AS sx, b.seed AS sy, a.arm = b.arm AS same, {INT.format('sum(a.z * b.z) / sqrt(sum(a.z * a.z) * sum(b.z * b.z))')} AS v FROM z a JOIN z b USING (j)
    WHERE (a.arm, a.seed) < (b.arm, b.seed) AND a.seed <> b.seed GROUP BY a.arm, a.seed, b.arm, b.seed""",
    g="SELECT sx, sy, sum(CASE WHEN same THEN v ELSE -v END) AS d FROM pr GROUP BY sx, sy",
    st="""SELECT mask, sum(d * (1 - 2 * (xor(mask >> sx::INT, mask >> sy::INT) & 1))) AS s FROM g, range(0, 4096) t(mask) GROUP BY mask"""))
def seed_pair_relabelling(spark, sf):
    pairs = materialise(op.pair_cosines(d.crossed(spark, sf), ["arm", "seed"], "j", "x"))
    return fix(fix(op.seed_pair_relabelling(pairs, "arm", "seed", "cos", 12), 8, "d"), 9, "p")


BOOT = 20
STREAM = "CASE WHEN arm = 'A' THEN 0 ELSE 1 END"
view("v_ranked", """SELECT arm, tag, seed, c, gen_idx, row_number() OVER (PARTITION BY tag ORDER BY gen_idx) AS rn, count(*) OVER (PARTITION BY tag) AS n FROM v_con""")
view("v_clusters", "SELECT arm, tag, seed, theta, row_number() OVER (PARTITION BY arm ORDER BY seed) AS place, count(*) OVER (PARTITION BY arm) AS k FROM v_adapter")
view("v_draws", f"SELECT arm, rep, place AS slot, {portable_hash_sql('place', f'(rep * 2 + {STREAM})', 51)} % k + 1 AS drawn FROM v_clusters, range(0, {BOOT}) t(rep)")
view("v_slots", f"""SELECT arm, rep, slot, sum(m * c) / nullif(sum(m), 0) AS theta FROM (SELECT d.arm, d.rep, d.slot, q.c,
    {item_copies_sql('q.gen_idx', 'd.rep', '(d.slot * 2 + ' + STREAM.replace('arm', 'd.arm') + ')', 53)} AS m FROM v_draws d JOIN v_clusters k ON k.arm = d.arm AND k.place = d.drawn
    JOIN v_con q ON q.tag = k.tag) GROUP BY arm, rep, slot""")
view("v_two_rep", pc.two_sql("v_slots").replace("SELECT ", "SELECT rep, ", 1) + " GROUP BY rep")
view("v_real_boot", f"""SELECT rep, (avg(m) FILTER (role = 'A') + avg(m) FILTER (role = 'B')) / 2 AS r FROM (SELECT role, rep, sum(m * c) / sum(m) AS m FROM
    (SELECT role, c, rep, {item_copies_sql('vec_id', 'rep', None, 57)} AS m FROM v_real, range(0, {BOOT}) t(rep)) GROUP BY role, rep) GROUP BY rep""")


def ranked_items(spark, sf, values=None):
    """Items of arms A and B with their place in the adapter and the adapter's place in the arm."""
    if values is None:
        x = d.contrasts(spark, sf)
    else:
        x = d.wide(spark, sf).where(F.col("arm").isin(d.ARMS)).withColumn("rho_E", (F.col("rho_A") + F.col("rho_B")) / 2)
    x = materialise(x)
    n = x.groupBy("arm", "tag").agg(F.count(F.lit(1)).alias("n"), F.min("seed").alias("s"))
    from pyspark.sql import Window

    w = Window.partitionBy("arm")
    n = materialise(n.select("arm", "tag", "n", F.row_number().over(w.orderBy("s")).alias("place"), F.count(F.lit(1)).over(w).alias("k")))
    return materialise(with_rank(x, ["tag"], ["gen_idx"]).join(n.drop("arm"), "tag")), n


def clusters(spark, sf):
    """arm, tag, place of the adapters of arms A and B, in order of their seeds."""
    from pyspark.sql import Window

    n = d.lines(spark, sf).where(F.col("arm").isin(d.ARMS)).groupBy("arm", "tag").agg(F.min("seed").alias("s"))
    return materialise(n.select("arm", "tag", F.row_number().over(Window.partitionBy("arm").orderBy("s")).alias("place")))


def real_bootstrap(spark, sf):
    """Denominator of each replicate from resampled held-out items."""
    real = materialise(pc.real_contrasts(spark, sf).select("role", "vec_id", "c"))
    m = poisson.poisson_means(real, ["role"], "vec_id", ["c"], BOOT, 57)
    boot = m.groupBy("rep").agg(((F.avg(F.when(F.col("role") == "A", F.col("c"))) + F.avg(F.when(F.col("role") == "B", F.col("c")))) / 2).alias("r"))
    return boot, cn.denominator(real, "role", "c")


def hierarchical(spark, sf):
    """rep, theta_sym, u_max, r, lambda_hat, lambda_u."""
    places = clusters(spark, sf)
    items = d.contrasts(spark, sf).join(places.select("tag", "place"), "tag")
    slots = poisson.hierarchical_means(items, places, "arm", "tag", "place", "gen_idx", ["c"], BOOT, 51, 53)
    boot, den = real_bootstrap(spark, sf)
    x = op.limits_by_replicate(slots, "arm", "c").join(boot, "rep")
    return materialise(x.withColumns({"lambda_hat": F.col("theta_sym") / F.col("r"), "lambda_u": F.col("u_max") / F.col("r")})), den


@query("f6_hierarchical_bootstrap", oracle(f"""SELECT count(*) AS reps, {rs(7, u_p99='quantile_cont(u / r, 0.99)', hat_p2_5='quantile_cont(th / r, 0.025)', hat_p97_5='quantile_cont(th / r, 0.975)', mean_u='avg(u)')} FROM
    (SELECT rep, {pc.SYM} AS th, {pc.U_MAX} AS u FROM v_two_rep) JOIN v_real_boot USING (rep)"""))
def hierarchical_bootstrap(spark, sf):
    x, _ = hierarchical(spark, sf)
    out = x.agg(F.count(F.lit(1)).alias("reps"), F.percentile("lambda_u", F.lit(0.99)).alias("u_p99"), F.percentile("lambda_hat", F.lit(0.025)).alias("hat_p2_5"),
                F.percentile("lambda_hat", F.lit(0.975)).alias("hat_p97_5"), F.avg("u_max").alias("mean_u"))
    return fix(out, 7, "u_p99", "hat_p2_5", "hat_p97_5", "mean_u")


@query("f7_bca_limit", oracle(f"""SELECT {rs(7, theta='theta', below='below', a='a', alpha='alpha', limit='s[floor(spot)::BIGINT + 1] + (s[ceil(spot)::BIGINT + 1] - s[floor(spot)::BIGINT + 1]) * (spot - floor(spot))')} FROM
    (SELECT *, greatest(least(alpha, 1 - 1e-6), 1e-6) * (len(s) - 1) AS spot FROM (SELECT *, {tl.normal_cdf_sql('(z0 + (z0 + z) / (1 - a * (z0 + z)))')} AS alpha FROM
    (SELECT *, {tl.normal_quantile_sql('below')} AS z0, {tl.normal_quantile_sql('0.995::DOUBLE')} AS z FROM bt, acc, v_nodes)))""",
    est=f"SELECT {pc.U_MAX} / r AS theta, {pc.U_A} AS ua, {pc.U_B} AS ub, r FROM v_two, v_den",
    bt=f"""SELECT any_value(theta) AS theta, avg((b < theta)::INT) AS below, list(b ORDER BY b) AS s FROM
        (SELECT u / r AS b FROM (SELECT rep, {pc.U_MAX} AS u FROM v_two_rep) JOIN v_real_boot USING (rep)), est""",
    loo=f"""SELECT arm, m + {t995_sql('n - 1')} * sd / sqrt(n) AS u FROM (SELECT a.arm, a.tag, count(*) AS n, avg(b.theta) AS m, stddev_samp(b.theta) AS sd
        FROM v_adapter a JOIN v_adapter b ON a.arm = b.arm AND a.tag <> b.tag GROUP BY a.arm, a.tag)""",
    jack="SELECT greatest(u, CASE WHEN arm = 'A' THEN ub ELSE ua END) / r AS j FROM loo, est",
    acc="SELECT coalesce(sum(dv ** 3) / nullif(6 * pow(sum(dv * dv), 1.5), 0), 0) AS a FROM (SELECT (SELECT avg(j) FROM jack) - j AS dv FROM jack)"))
def bca_limit(spark, sf):
    x, den = hierarchical(spark, sf)
    means = materialise(d.adapter_means(spark, sf))
    full = cn.max_arm_limit(cn.symmetric_parts(cn.two_arms(means, "arm", "theta")))
    r0 = den.select("r").scalar()
    loo = cn.leave_one_out_limits(means, "arm", "tag", "theta")
    loo = loo.select("arm", "u", full.select("u_A").scalar().alias("ua"), full.select("u_B").scalar().alias("ub"), r0.alias("r"))
    jack = loo.select((F.greatest(F.col("u"), F.when(F.col("arm") == "A", F.col("ub")).otherwise(F.col("ua"))) / F.col("r")).alias("j"))
    out = op.bca_limit(x, "lambda_u", full.select(F.col("u_max") / r0).scalar(), jack, "j")
    return fix(out, 7, "theta", "below", "a", "alpha", "limit")


@query("f8_cluster_bootstrap", oracle(f"""SELECT count(*) AS reps, {rs(8, low='quantile_cont(m, 0.005)', high='quantile_cont(m, 0.995)', mean='avg(m)')} FROM (SELECT rep, avg(y.residual) AS m FROM
    (SELECT rep, {portable_hash_sql('place', 'rep', 61)} % n + 1 AS place FROM res, range(0, 500) t(rep)) x JOIN res y USING (place) GROUP BY rep)""",
    res="SELECT observed - predicted AS residual, row_number() OVER (ORDER BY tag) AS place, count(*) OVER () AS n FROM v_offdiag"))
def cluster_bootstrap(spark, sf):
    from pyspark.sql import Window

    x = materialise(md.off_diagonal_residuals(pm.cells(spark, sf), "tag", "arm", "K", "v"))
    x = materialise(x.withColumn("place", F.row_number().over(Window.orderBy("tag"))))
    m = op.mean_bootstrap(x, "place", "residual", 500, 61)
    out = m.agg(F.count(F.lit(1)).alias("reps"), F.percentile("m", F.lit(0.005)).alias("low"), F.percentile("m", F.lit(0.995)).alias("high"), F.avg("m").alias("mean"))
    return fix(out, 8, "low", "high", "mean")


SHARED = 200
view("v_crossed_o", """SELECT arm, seed, l_orderkey % 10 AS j, CASE arm WHEN 'A' THEN 1 ELSE -1 END * (avg(l_discount) - 1.25 * avg(l_tax)) AS x FROM v_lines
    WHERE arm IN ('A', 'B') AND l_linestatus = 'O' GROUP BY arm, seed, l_orderkey % 10""")
view("v_shared_m", f"SELECT rep, {portable_hash_sql('slot', 'rep', 67)} % 10 AS j, count(*) AS m FROM range(0, {SHARED}) t(rep), range(0, 10) s(slot) GROUP BY ALL")


def _shared(cells: str) -> str:
    inner = f"(SELECT arm, seed, rep, sum(m * x) / sum(m) AS theta FROM {cells} JOIN v_shared_m USING (j) GROUP BY arm, seed, rep)"
    return pc.two_sql(inner).replace("SELECT ", "SELECT rep, ", 1) + " GROUP BY rep"


view("v_shared", _shared("v_crossed"))
view("v_shared_o", _shared("v_crossed_o"))


def shared_limits(cells):
    m = op.shared_index_means(cells, ["arm", "seed"], "j", "x", 10, SHARED, 67)
    return op.limits_by_replicate(m, "arm", "x")


@query("f9_shared_index_bootstrap", oracle(f"""SELECT measure, count(rel) AS reps, {rs(5, mean='avg(rel)', sd='stddev_samp(rel)', p2_5='quantile_cont(rel, 0.025)', p97_5='quantile_cont(rel, 0.975)', beyond='avg((abs(rel) > 0.1)::INT)')} FROM
    (SELECT 'u_max' AS measure, b.u / a.u - 1 AS rel FROM a JOIN b USING (rep) UNION ALL SELECT 'u_A', b.ua / a.ua - 1 FROM a JOIN b USING (rep)) GROUP BY measure""",
    a=f"SELECT rep, {pc.U_MAX} AS u, {pc.U_A} AS ua FROM v_shared", b=f"SELECT rep, {pc.U_MAX} AS u, {pc.U_A} AS ua FROM v_shared_o"))
def shared_index_bootstrap(spark, sf):
    """Limits of two estimates under the same resampled indices."""
    li = d.lines(spark, sf).where(F.col("arm").isin(d.ARMS) & (F.col("l_linestatus") == "O"))
    dlt = F.avg("l_discount") - F.avg("l_tax") * 1.25
    other = li.groupBy("arm", "seed", (F.col("l_orderkey") % 10).alias("j")).agg(F.when(F.col("arm") == "A", dlt).otherwise(-dlt).alias("x"))
    a, b = shared_limits(materialise(d.crossed(spark, sf))), shared_limits(materialise(other))
    return fix(op.relative_changes(a, b, ["u_max", "u_A"]), 5, "mean", "sd", "p2_5", "p97_5", "beyond")


CANDS = [f"rho_{k}" for k in d.CANDIDATES]


SHIFT_GRID = [-0.01, -0.002, 0.0, 0.002, 0.01, 0.02, 0.05]
view("v_wide_e", "SELECT *, (rho_A + rho_B) / 2 AS rho_E FROM v_wide WHERE arm IN ('A', 'B')")
view("v_draws10", f"SELECT arm, rep, place AS slot, {portable_hash_sql('place', f'(rep * 2 + {STREAM})', 71)} % k + 1 AS drawn FROM v_clusters, range(0, {BOOT}) t(rep)")


def _attributed(scheme: str, stream: str) -> dict[str, str]:
    means = ", ".join(f"sum(m * {c}) / sum(m) AS {c}" for c in CANDS)
    return {
        f"mean_{scheme}": f"""SELECT arm, rep, slot, {means} FROM (SELECT x.arm, x.rep, x.slot, q.* EXCLUDE (arm), {item_copies_sql('q.gen_idx', 'x.rep', stream, 73)} AS m
            FROM v_draws10 x JOIN v_clusters k ON k.arm = x.arm AND k.place = x.drawn JOIN v_wide_e q ON q.tag = k.tag) GROUP BY arm, rep, slot""",
        f"long_{scheme}": " UNION ALL ".join(f"SELECT arm, rep, slot, '{k}' AS K, rho_{k} AS v FROM mean_{scheme}" for k in d.CANDIDATES),
        f"margin_{scheme}": f"""SELECT rep, arm, slot, max(v - b) FILTER (K <> arm) - max(v - b) FILTER (K = arm) AS margin FROM long_{scheme} JOIN
            (SELECT rep, K, avg(v) AS b FROM long_{scheme} WHERE K <> arm GROUP BY rep, K) USING (rep, K) GROUP BY rep, arm, slot""",
    }


_F10 = {**_attributed("independent", "(x.slot * 2 + " + STREAM.replace("arm", "x.arm") + ")"), **_attributed("shared", "0")}


@query("f10_attribution_bootstrap", oracle(f"""SELECT scheme, shift, count(*) AS reps, {rs(8, accuracy='avg(a)', low='quantile_cont(a, 0.025)', high='quantile_cont(a, 0.975)')} FROM
    (SELECT scheme, shift, rep, avg((margin < shift)::INT) AS a FROM (SELECT 'independent' AS scheme, * FROM margin_independent UNION ALL SELECT 'shared', * FROM margin_shared),
    (VALUES {', '.join(f'({x}::DOUBLE)' for x in SHIFT_GRID)}) t(shift) GROUP BY scheme, shift, rep) GROUP BY scheme, shift""", **_F10))
def attribution_bootstrap(spark, sf):
    """Two-stage bootstrap of corrected attribution at every shift of a grid, with independent and with shared item draws."""
    places = clusters(spark, sf)
    wide = d.wide(spark, sf).where(F.col("arm").isin(d.ARMS)).withColumn("rho_E", (F.col("rho_A") + F.col("rho_B")) / 2)
    items = materialise(wide.join(places.select("tag", "place"), "tag"))
    parts = []
    for scheme, shared in (("independent", False), ("shared", True)):
        m = poisson.hierarchical_means(items, places, "arm", "tag", "place", "gen_idx", CANDS, BOOT, 71, 73, shared)
        pairs = F.array(*[F.struct(F.lit(k).alias("K"), F.col(f"rho_{k}").alias("v")) for k in d.CANDIDATES])
        parts.append(m.select(F.lit(scheme).alias("scheme"), "rep", F.col("arm").alias("own"), F.concat_ws("#", "tag", "slot").alias("unit"), F.inline(pairs)))
    x = materialise(sg.union_all(parts))
    b = op.main_effects(x, "K", "own", "v", F.lit(1.0), ["scheme", "rep"])
    y = x.join(b, ["scheme", "rep", "K"]).withColumn("c", F.col("v") - F.col("b"))
    mine = F.col("K") == F.col("own")
    z = y.groupBy("scheme", "rep", "own", "unit").agg((F.max(F.when(~mine, F.col("c"))) - F.max(F.when(mine, F.col("c")))).alias("margin"))
    out = op.accuracy_at_shifts(z, ["scheme"], "rep", "margin", SHIFT_GRID)
    return fix(out, 8, "accuracy", "low", "high")


BLOCK = 50
view("v_main", "SELECT K, avg(rho) AS b FROM v_long WHERE arm IN ('A', 'B') AND K <> arm GROUP BY K")
view("v_blocks", f"""SELECT tag, arm, block, K, avg(rho) AS m FROM (SELECT l.*, (r.rn - 1) // {BLOCK} AS block FROM v_long l JOIN v_ranked r USING (tag, gen_idx)
    WHERE (r.rn - 1) // {BLOCK} < r.n // {BLOCK}) GROUP BY tag, arm, block, K""")


@query("f11_closed_set_attribution", oracle("""SELECT score, arm, picked, count(*) AS n FROM (SELECT 'raw' AS score, tag, arm, block, arg_min(K, (-round(m, 12), K)) AS picked FROM v_blocks GROUP BY tag, arm, block
    UNION ALL SELECT 'corrected', tag, arm, block, arg_min(K, (-round(m - b, 12), K)) FROM v_blocks JOIN v_main USING (K) GROUP BY tag, arm, block) GROUP BY score, arm, picked"""))
def closed_set_attribution(spark, sf):
    """Confusion counts of block-mean attribution with raw and main-effect-corrected scores."""
    x = materialise(pc.arms_long(spark, sf).select("tag", "arm", "gen_idx", "K", "rho"))
    b = op.main_effects(x, "K", "arm", "rho", F.lit(1.0))
    blocks = materialise(op.block_means(x, "tag", "arm", "K", "rho", "gen_idx", BLOCK))
    parts = [op.attribute(blocks, "tag", "arm", "K", m).withColumn("score", F.lit(s)) for s, m in (("raw", None), ("corrected", b))]
    return sg.union_all(parts).groupBy("score", "arm", "picked").agg(F.count(F.lit(1)).alias("n"))


@query("f12_real_ceiling", oracle("""SELECT g, count(*) AS n_blocks, count(*) FILTER (picked = device) AS hits FROM (SELECT g, device, block, arg_min(K, (-round(m, 12), K)) AS picked FROM
    (SELECT g, device, block, K, avg(rho_mult) AS m FROM (SELECT s.*, g, (rn - 1) // g AS block FROM v_score s JOIN hr USING (vec_id), (VALUES (1), (4)) t(g) WHERE (rn - 1) // g < n // g)
    GROUP BY ALL) GROUP BY g, device, block) GROUP BY g""",
    hr="SELECT vec_id, row_number() OVER (PARTITION BY device ORDER BY vec_id) AS rn, count(*) OVER (PARTITION BY device) AS n FROM v_vec WHERE split = 'H'"))
def real_ceiling(spark, sf):
    s = materialise(scored(spark, sf).select("vec_id", "device", F.col("device").alias("own"), "K", "rho_mult"))
    parts = [op.attribute(op.block_means(s, "device", "own", "K", "rho_mult", "vec_id", g), "device", "own", "K").withColumn("g", F.lit(g)) for g in (1, 4)]
    return sg.union_all(parts).groupBy("g").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if(F.col("picked") == F.col("own")).alias("hits"))


@query("f13_attribution_margin", oracle(f"""SELECT tag, arm, {rs(8, margin='margin')}, margin < 0.02 AS correct_at_shift FROM (SELECT tag, arm, max(v - b) FILTER (K <> arm) - max(v - b) FILTER (K = arm) AS margin
    FROM v_cells JOIN v_main USING (K) GROUP BY tag, arm)"""))
def attribution_margin(spark, sf):
    x = materialise(pc.arms_long(spark, sf).select("tag", "arm", "K", "rho"))
    b = op.main_effects(x, "K", "arm", "rho", F.lit(1.0))
    cells = x.groupBy("tag", "arm", "K").agg(F.avg("rho").alias("v"))
    m = op.attribution_margins(cells, b, "tag", "arm", "K", "v")
    return fix(m.withColumn("correct_at_shift", F.col("margin") < 0.02), 8, "margin")


SUBSET, SUBREPS, PLANTED = 50, 20, 0.01
view("v_subset", f"""SELECT arm, tag, rep, avg(c) AS m FROM (SELECT arm, tag, rep, c, row_number() OVER (PARTITION BY tag, rep ORDER BY {portable_hash_sql('gen_idx', 'rep', 79)}, gen_idx) AS rn
    FROM v_con, range(0, {SUBREPS}) t(rep)) WHERE rn <= {SUBSET} GROUP BY arm, tag, rep""")
view("v_trials", """SELECT s.arm, s.tag, s.rep, s.m - o.m AS th FROM v_subset s JOIN (SELECT a.tag, avg(b.theta) AS m FROM v_adapter a JOIN v_adapter b ON a.arm = b.arm AND a.tag <> b.tag GROUP BY a.tag) o USING (tag)""")


@query("f14_operating_point", oracle(f"""SELECT arm, count(*) AS n, {rs(7, threshold='any_value(q)', false_positive='avg((th > q)::INT)', true_positive=f'avg((th + {PLANTED} > q)::INT)')} FROM v_trials,
    (SELECT quantile_cont(th, 0.99) AS q FROM v_trials) GROUP BY arm"""))
def operating_point(spark, sf):
    """Threshold at the 99 % point of null subset means less the leave-one-out main effect; power against a planted shift."""
    c = materialise(d.contrasts(spark, sf))
    means = materialise(c.groupBy("arm", "tag").agg(F.avg("c").alias("theta")))
    tot = means.groupBy("arm").agg(F.sum("theta").alias("s"), F.count(F.lit(1)).alias("k"))
    loo = means.join(tot, "arm").select("arm", "tag", ((F.col("s") - F.col("theta")) / (F.col("k") - 1)).alias("o"))
    x = op.hashed_subsets(c, "tag", F.col("gen_idx"), "c", SUBSET, SUBREPS, 79).join(loo, "tag").withColumn("th", F.col("m") - F.col("o"))
    x = materialise(x.select("arm", "tag", "rep", "th"))
    q = x.agg(F.percentile("th", F.lit(0.99)))
    y = x.select("arm", "th", q.scalar().alias("q")).groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.max("q").alias("threshold"), F.avg((F.col("th") > F.col("q")).cast("double")).alias("false_positive"),
        F.avg((F.col("th") + PLANTED > F.col("q")).cast("double")).alias("true_positive"))
    return fix(y, 7, "threshold", "false_positive", "true_positive")


view("v_cell_p", f"""SELECT tag, count(*) FILTER (hit) / count(*) AS p FROM (SELECT tag, {MASKED} >= list_sum(v) AS hit FROM
    (SELECT arm || seed::VARCHAR AS tag, list({INT.format('x')} ORDER BY j) AS v FROM v_crossed GROUP BY arm, seed) g, range(0, 1024) m(mask)) GROUP BY tag""")


def adapter_p_values(spark, sf):
    c = materialise(d.crossed(spark, sf).withColumn("tag", F.concat("arm", F.col("seed").cast("string"))))
    return op.sign_flip(c, "tag", "j", "x")


@query("f15_holm", oracle(f"""SELECT tag, {rs(9, p='p', threshold='thr')}, min((p <= thr)::INT) OVER (ORDER BY p, tag ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS reject FROM
    (SELECT tag, p, 0.2::DOUBLE / (count(*) OVER () - row_number() OVER (ORDER BY p, tag) + 1) AS thr FROM v_cell_p)"""))
def holm(spark, sf):
    x = op.holm(adapter_p_values(spark, sf), "tag", "p", 0.2)
    return fix(x.select("tag", "p", "threshold", "reject"), 9, "p", "threshold")


def _half(a: str) -> str:
    return f"{t995_sql(f'k{a} - 1')} * s{a} / sqrt(k{a})"


@query("f16_calibrated_multiplier", oracle(f"""SELECT {rs(4, multiplier='min(c) FILTER (worst >= 0.99)', worst_at_1='max(worst) FILTER (c100 = 100)', best_worst='max(worst)')} FROM (SELECT c100, c100 / 100 AS c, min(cov) AS worst FROM
    (SELECT cell, c100, avg((greatest(mA + c100 / 100 * hA, mB + c100 / 100 * hB) >= truth)::INT) AS cov FROM cells, range(100, 301) t(c100), (SELECT {pc.SYM} AS truth FROM v_two) GROUP BY cell, c100) GROUP BY c100)""",
    cl=f"SELECT arm, rep, {portable_hash_sql('place', f'(rep * 2 + {STREAM})', 83)} % k + 1 AS drawn FROM v_clusters, range(0, {SHARED}) t(rep)",
    clm="SELECT c.arm, c.rep, k.theta FROM cl c JOIN v_clusters k ON k.arm = c.arm AND k.place = c.drawn",
    clt=pc.two_sql("clm").replace("SELECT ", "SELECT rep, ", 1) + " GROUP BY rep",
    cells=f"SELECT 'shared' AS cell, mA, {_half('A')} AS hA, mB, {_half('B')} AS hB FROM v_shared UNION ALL SELECT 'cluster', mA, {_half('A')}, mB, {_half('B')} FROM clt"))
def calibrated_multiplier(spark, sf):
    means = materialise(d.adapter_means(spark, sf))
    from pyspark.sql import Window

    w = Window.partitionBy("arm")
    cl = materialise(means.select("arm", "theta", F.row_number().over(w.orderBy("seed")).alias("place"), F.count(F.lit(1)).over(w).alias("k")))
    drawn = op.cluster_draws(cl, "arm", "place", "k", SHARED, 83).join(cl.select("arm", "place", "theta"), ["arm", "place"])
    sh = op.shared_index_means(materialise(d.crossed(spark, sf)), ["arm", "seed"], "j", "x", 10, SHARED, 67)
    truth = cn.symmetric_parts(cn.two_arms(means, "arm", "theta")).select("theta_sym")

    def cell(name, x, v):
        t = cn.two_arms(x, "arm", v, ["rep"])
        h = [(t995(F.col(f"k{a}") - 1) * F.col(f"s{a}") / F.sqrt(f"k{a}")).alias(f"h{a}") for a in ("A", "B")]
        return t.select(F.lit(name).alias("cell"), "rep", "mA", "mB", *h, truth.scalar().alias("truth"))

    x = materialise(cell("shared", sh, "x").unionByName(cell("cluster", drawn, "theta")))
    return fix(op.calibrate_multiplier(x, "cell", "truth", 100, 300, 0.99), 4, "multiplier", "worst_at_1", "best_worst")


@query("f17_estimation_inflated", oracle(f"""SELECT count(*) AS reps, {rs(8, mean_theta='avg(th)', v_adapter='avg(se * se)', v_estimate='var_samp(th)')}, {rs(6, estimate_share='var_samp(th) / (var_samp(th) + avg(se * se))',
    limit_z=f'avg(th) + {Z99!r} * sqrt(avg(se * se) + var_samp(th))')} FROM (SELECT rep, {pc.SYM} AS th, {pc.SE} AS se FROM two)""",
    sc=f"""SELECT t.rep, h.vec_id, h.device, {ncc_sql('h.w', 'h.y * t.k')} - {ncc_sql('h.w', 'h.y * o.k')} AS c FROM v_h h JOIN v_bootsig t USING (device, pos)
    JOIN v_bootsig o ON o.rep = t.rep AND o.pos = h.pos AND o.device = h.next_device GROUP BY t.rep, h.vec_id, h.device""",
    dm=f"SELECT rep, device, {pc.RING_ARM_SQL} AS arm, avg(c) AS theta FROM sc JOIN v_ring USING (device) GROUP BY rep, device, ring_place",
    two=pc.two_sql("dm").replace("SELECT ", "SELECT rep, ", 1) + " GROUP BY rep"))
def estimation_inflated(spark, sf):
    """Spread between bootstrap signatures added to the spread between devices."""
    x = materialise(d.planted(spark, sf))
    t = materialise(sg.to_arrays(bootstrap_signatures(x), ["rep", "device"]))
    ring = d.ring(spark, sf)
    other = of_next_device(t.select("rep", "device", F.col("k").alias("ko")), ring)
    h = x.where("split = 'H'").select("device", "vec_id", "y", "w").join(t.join(other, ["rep", "device"]), "device")
    c = pc.op_scores(h).withColumn("c", F.col("own") - F.col("oth"))
    m = c.join(ring, "device").groupBy("rep", "device", d.ring_arm().alias("arm")).agg(F.avg("c").alias("theta"))
    s = cn.welch(cn.symmetric_parts(cn.two_arms(m, "arm", "theta", ["rep"])))
    return fix(fix(inflated(s), 8, "mean_theta", "v_adapter", "v_estimate"), 6, "estimate_share", "limit_z")


def inflated(s):
    va, ve = F.avg(F.col("se") * F.col("se")), F.var_samp("theta_sym")
    return s.agg(F.count(F.lit(1)).alias("reps"), F.avg("theta_sym").alias("mean_theta"), va.alias("v_adapter"), ve.alias("v_estimate"),
                 V.safe_div(ve, ve + va).alias("estimate_share"), (F.avg("theta_sym") + Z99 * F.sqrt(va + ve)).alias("limit_z"))


PERM = 5
view("v_cov", "SELECT arm, tag, seed, gen_idx, rn, c, rho_D AS m FROM v_ranked JOIN v_wide USING (arm, tag, seed, gen_idx)")


@query("f18_within_permutation", oracle(f"""SELECT arm, count(*) FILTER (rep > 0) AS reps, {rs(7, slope='max(slope) FILTER (rep = 0)')}, {r('count(*) FILTER (rep > 0 AND slope >= obs) / count(*) FILTER (rep > 0)')} AS p,
    {r('stddev_pop(slope) FILTER (rep > 0)', 7)} AS null_sd FROM (SELECT *, max(slope) FILTER (rep = 0) OVER (PARTITION BY arm) AS obs FROM
    (SELECT arm, rep, sum(n * cxy) / sum(n * vx) AS slope FROM (SELECT arm, tag, rep, count(*) AS n, covar_pop(c, m) AS cxy, var_pop(m) AS vx FROM alls GROUP BY arm, tag, rep) GROUP BY arm, rep)) GROUP BY arm""",
    alls=f"""SELECT arm, tag, 0 AS rep, c, m FROM v_cov UNION ALL SELECT x.arm, x.tag, x.rep, x.c, y.m FROM (SELECT arm, tag, rep, c, row_number() OVER (PARTITION BY tag, rep ORDER BY
    {portable_hash_sql('gen_idx', 'rep', 89)}, gen_idx) AS rn FROM v_cov, range(1, {PERM + 1}) t(rep)) x JOIN v_cov y ON y.tag = x.tag AND y.rn = x.rn"""))
def within_permutation(spark, sf):
    items, _ = ranked_items(spark, sf, CANDS)
    dlt = F.col("rho_A") - F.col("rho_B")
    x = items.select("arm", "tag", "gen_idx", "rn", F.when(F.col("arm") == "A", dlt).otherwise(-dlt).alias("c"), F.col("rho_D").alias("m"))
    arms = x.select("arm", "tag").distinct()
    perm = op.permuted_within(x.drop("arm"), "tag", "rn", F.col("gen_idx"), "m", PERM, 89).join(arms, "tag").select("arm", "tag", "rep", "c", "m")
    both = x.select("arm", "tag", F.lit(0).alias("rep"), "c", "m").unionByName(perm)
    mom = both.groupBy("arm", "tag", "rep").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("c", "m").alias("cxy"), F.var_pop("m").alias("vx"))
    s = materialise(mom.groupBy("arm", "rep").agg((F.sum(F.col("n") * F.col("cxy")) / F.sum(F.col("n") * F.col("vx"))).alias("slope")))
    obs = s.where("rep = 0").select("arm", F.col("slope").alias("obs"))
    out = s.where("rep > 0").join(obs, "arm").groupBy("arm").agg(
        F.count(F.lit(1)).alias("reps"), F.max("obs").alias("slope"), F.avg((F.col("slope") >= F.col("obs")).cast("double")).alias("p"), F.stddev_pop("slope").alias("null_sd"))
    return fix(fix(out, 7, "slope", "null_sd"), 8, "p")
