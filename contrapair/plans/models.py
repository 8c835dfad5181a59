"""Regression, variance-component and pooling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrapair.functions import critical as cr
from contrapair.functions import tails as tl
from contrapair.functions import vectors as V
from contrapair.functions.ordered import exact_quantiles
from contrapair.operators import contrasts as cn
from contrapair.operators import models as op
from contrapair.operators import signatures as sg
from contrapair.plans import contrasts as pc
from contrapair.plans import derived as d
from contrapair.plans.registry import query
from contrapair.plans.signatures import signature_arrays
from contrapair.plans.sqlkit import big, fix, i64, oracle, r, rounded, rs, view
from contrapair.session import materialise


@query("e16_item_slopes", oracle(f"""SELECT count(b) AS n, {rs(7, slope='avg(b)', se='stddev_samp(b) / sqrt(count(b))',
    lower99=f'avg(b) - {cr.Z99!r} * stddev_samp(b) / sqrt(count(b))')} FROM (SELECT vec_id, regr_slope(c, alpha) AS b FROM v_levels GROUP BY vec_id)"""))
def item_slopes(spark, sf):
    return fix(op.item_slopes(pc.levels(spark, sf), ["vec_id"], "alpha", "c"), 7, "slope", "se", "lower99")


view("v_points", "SELECT alpha, avg(c) AS m, stddev_samp(c) / sqrt(count(*)) AS se FROM v_levels GROUP BY alpha")
view("v_line0", """SELECT sum(1 / se ** 2) AS w, sum(alpha / se ** 2) AS wx, sum(m / se ** 2) AS wy, sum(alpha * alpha / se ** 2) AS wxx,
    sum(alpha * m / se ** 2) AS wxy FROM v_points""")
view("v_line", f"""SELECT (wy - (w * wxy - wx * wy) / (w * wxx - wx * wx) * wx) / w AS b0, (w * wxy - wx * wy) / (w * wxx - wx * wx) AS b1,
    sqrt(w / (w * wxx - wx * wx)) AS se1, (w * wxy - wx * wy) / (w * wxx - wx * wx) - {cr.Z99!r} * sqrt(w / (w * wxx - wx * wx)) AS b1_low FROM v_line0""")


def line(spark, sf):
    return op.weighted_line(cn.mean_se(pc.levels(spark, sf), ["alpha"], "c"), "alpha", "m", "se")


@query("e17_weighted_line", oracle(f"SELECT {rs(7, b0='b0', b1='b1', se1='se1', b1_low='b1_low')} FROM v_line"))
def weighted_line(spark, sf):
    return fix(line(spark, sf), 7, "b0", "b1", "se1", "b1_low")


@query("e18_equivalent_dose", oracle(f"SELECT {rs(6, u='u', equivalent='(u - b0) / b1_low', margin='1 / ((u - b0) / b1_low)')} FROM v_line, (SELECT {pc.U_MAX} AS u FROM v_two)"))
def equivalent_dose(spark, sf):
    """The level whose response the upper limit would equal, against the slope's lower limit."""
    u = cn.max_arm_limit(cn.two_arms(d.adapter_means(spark, sf), "arm", "theta")).select("u_max")
    x = line(spark, sf).select(u.scalar().alias("u"), "b0", "b1_low")
    x = x.select("u", V.safe_div(F.col("u") - F.col("b0"), F.col("b1_low")).alias("equivalent"))
    return fix(x.withColumn("margin", V.safe_div(F.lit(1.0), F.col("equivalent"))), 6, "u", "equivalent", "margin")


view("v_strength", """SELECT w.arm, w.tag, any_value(a.theta) AS theta, avg(w.rho_C) AS strength, (w.arm = 'A')::INT::DOUBLE AS body
    FROM v_wide w JOIN v_adapter a USING (tag) GROUP BY w.arm, w.tag""")


def strengths(spark, sf):
    w = d.wide(spark, sf).where(F.col("arm").isin(d.ARMS))
    dlt = F.col("rho_A") - F.col("rho_B")
    return materialise(w.groupBy("arm", "tag").agg(
        F.avg(F.when(F.col("arm") == "A", dlt).otherwise(-dlt)).alias("theta"), F.avg("rho_C").alias("strength")
    ).withColumn("body", (F.col("arm") == "A").cast("double")))


@query("e19_ols_one", oracle(f"""SELECT n, {rs(6, b0='my - b * mx', b1='b', se1='sqrt(n * (vy - b * cxy) / (n - 2) / (n * vx))',
    t1='b / sqrt(n * (vy - b * cxy) / (n - 2) / (n * vx))', r2='b * cxy / vy')} FROM (SELECT count(*) AS n, avg(strength) AS mx, avg(theta) AS my,
    var_pop(strength) AS vx, var_pop(theta) AS vy, covar_pop(theta, strength) AS cxy, regr_slope(theta, strength) AS b FROM v_strength)"""))
def ols_one(spark, sf):
    return fix(op.ols_one(strengths(spark, sf), "theta", "strength"), 6, "b0", "b1", "se1", "t1", "r2")


@query("e19_ols_two", oracle(f"""SELECT n, {rs(6, b0='my - bx * mx - bz * mz', bx='bx', se_x='sqrt(s2 * zz / det)', t_x='bx / sqrt(s2 * zz / det)', bz='bz',
    se_z='sqrt(s2 * xx / det)', t_z='bz / sqrt(s2 * xx / det)', r2='1 - s2 * (n - 3) / yy')} FROM
    (SELECT *, (yy - bx * xy - bz * zy) / (n - 3) AS s2 FROM (SELECT *, (xy * zz - zy * xz) / det AS bx, (zy * xx - xy * xz) / det AS bz FROM
    (SELECT *, xx * zz - xz * xz AS det FROM (SELECT count(*) AS n, avg(body) AS mx, avg(strength) AS mz, avg(theta) AS my, regr_sxx(theta, body) AS xx,
    regr_sxx(theta, strength) AS zz, regr_sxy(body, strength) AS xz, regr_sxy(theta, body) AS xy, regr_sxy(theta, strength) AS zy, regr_syy(theta, body) AS yy FROM v_strength))))"""))
def ols_two(spark, sf):
    x = op.ols_two(strengths(spark, sf), "theta", "body", "strength")
    return fix(x, 6, *[c for c in x.columns if c != "n"])


@query("e20_adjusted_contrast", oracle(f"SELECT kA, kB, {rs(8, theta_sym=pc.SYM, se=pc.SE)}, {rs(6, df=pc.DF, t=f'{pc.SYM} / {pc.SE}')} FROM two",
    adj="""SELECT arm, theta - (SELECT regr_slope(theta, strength) FROM v_strength) * (strength - (SELECT avg(strength) FROM v_strength)) AS theta FROM v_strength""",
    two=pc.two_sql("adj")))
def adjusted_contrast(spark, sf):
    x = op.detrended(strengths(spark, sf), "theta", "strength", "adj")
    x = cn.welch(cn.symmetric_parts(cn.two_arms(x, "arm", "adj")))
    return fix(fix(x.select("kA", "kB", "theta_sym", "se", "df", "t"), 8, "theta_sym", "se"), 6, "df", "t")


def _rank(v: str) -> str:
    return f"rank() OVER (PARTITION BY scope ORDER BY {v}) + (count(*) OVER (PARTITION BY scope, {v}) - 1) / 2"


@query("e21_correlations", oracle(f"""SELECT scope, count(*) AS n, {rs(7, pearson='corr(x, y)', spearman='corr(rx, ry)')} FROM
    (SELECT *, {_rank('x')} AS rx, {_rank('y')} AS ry FROM scoped) GROUP BY scope""",
    pts="SELECT arm, round(rho_A, 9) AS x, round(rho_D, 9) AS y FROM v_wide WHERE arm <> 'base'",
    scoped="""SELECT 'all' AS scope, x, y FROM pts UNION ALL SELECT arm, x, y FROM pts UNION ALL
    SELECT 'demeaned', round(x - avg(x) OVER (PARTITION BY arm), 9), round(y - avg(y) OVER (PARTITION BY arm), 9) FROM pts"""))
def correlations(spark, sf):
    w = materialise(d.wide(spark, sf).where("arm <> 'base'").select("arm", F.round("rho_A", 9).alias("x"), F.round("rho_D", 9).alias("y")))
    dm = op.without_group_means(w, "arm", ["x", "y"]).withColumns({"x": F.round("x", 9), "y": F.round("y", 9)})
    scoped = materialise(sg.union_all([
        w.select(F.lit("all").alias("scope"), "x", "y"), w.select(F.col("arm").alias("scope"), "x", "y"), dm.select(F.lit("demeaned").alias("scope"), "x", "y")]))
    return fix(op.correlations(scoped, "x", "y", ["scope"]), 7, "pearson", "spearman")


view("v_cells", "SELECT tag, arm, seed, K, avg(rho) AS v FROM v_long WHERE arm IN ('A', 'B') GROUP BY tag, arm, seed, K")


def cells(spark, sf):
    x = d.long(spark, sf).where(F.col("arm").isin(d.ARMS))
    return materialise(x.groupBy("tag", "arm", "seed", "K").agg(F.avg("rho").alias("v")))


view("v_xval", """SELECT o.tag, o.arm, b.fit_seed, o.obs, b.pred FROM (SELECT tag, arm, seed, max(v) FILTER (K = arm) - avg(v) FILTER (K <> arm) AS obs FROM v_cells GROUP BY ALL) o
    JOIN (SELECT fit_seed, own, max(m) FILTER (K = own) - avg(m) FILTER (K <> own) AS pred FROM (SELECT seed AS fit_seed, K, avg(v) AS m FROM v_cells GROUP BY seed, K),
    (VALUES ('A'), ('B')) a(own) GROUP BY ALL) b ON b.own = o.arm AND b.fit_seed <> o.seed""")


@query("e24_cross_seed_additive", oracle(f"""SELECT count(*) AS n, {rs(6, r2='1 - sum((obs - pred) ** 2) / (var_pop(obs) * count(*))', r='corr(pred, obs)', rmse='sqrt(sum((obs - pred) ** 2) / count(*))')} FROM v_xval"""))
def cross_seed_additive(spark, sf):
    x = op.cross_seed_additive(cells(spark, sf), "tag", "arm", "seed", "K", "v")
    return fix(op.fit_quality(x, "predicted", "observed"), 6, "r2", "r", "rmse")


view("v_offdiag", """SELECT c.tag, c.arm, a.m + b.m - (SELECT avg(v) FROM v_cells WHERE K <> arm) AS predicted, c.v AS observed FROM v_cells c
    JOIN (SELECT tag, avg(v) AS m FROM v_cells WHERE K <> arm GROUP BY tag) a USING (tag) JOIN (SELECT K, avg(v) AS m FROM v_cells WHERE K <> arm GROUP BY K) b USING (K) WHERE c.K = c.arm""")


@query("e25_off_diagonal", oracle(f"""SELECT tag, arm, {rs(8, predicted='predicted', observed='observed', residual='observed - predicted',
    mean_residual='avg(observed - predicted) OVER ()')}, {r('avg(observed - predicted) OVER () / (stddev_samp(observed - predicted) OVER () / sqrt(count(*) OVER ()))', 6)} AS t FROM v_offdiag"""))
def off_diagonal(spark, sf):
    x = materialise(op.off_diagonal_residuals(cells(spark, sf), "tag", "arm", "K", "v"))
    s = cn.mean_se(x, [], "residual")
    x = x.select("*", s.select("m").scalar().alias("mean_residual"), s.select("t").scalar().alias("t"))
    return fix(fix(x, 8, "predicted", "observed", "residual", "mean_residual"), 6, "t")


@query("e26_icc", oracle(f"""SELECT k, n, {rs(9, n0='n0', grand='grand', ms_between='msb', within='w', var_u='greatest((msb - w) / n0, 0)')},
    {r('coalesce(greatest((msb - w) / n0, 0) / nullif(greatest((msb - w) / n0, 0) + w, 0), 0)', 6)} AS icc FROM
    (SELECT count(*) AS k, max(n) AS n, (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) AS n0, any_value(grand) AS grand, sum(n * (m - grand) ** 2) / (count(*) - 1) AS msb,
    sum(n * v) / (sum(n) - count(*)) AS w FROM g, (SELECT avg(theta) AS grand FROM v_adapter))""",
    g="SELECT arm, avg(theta) AS m, var_pop(theta) AS v, count(*) AS n FROM v_adapter GROUP BY arm"))
def icc(spark, sf):
    return fix(fix(op.one_way_icc(d.adapter_means(spark, sf), "arm", "theta"), 9, "n0", "grand", "ms_between", "within", "var_u"), 6, "icc")


view("v_anova0", """SELECT arm, sum((rm - m) ** 2) AS ss_a, sum((cm - m) ** 2) AS ss_s, sum((x - rm - cm + m) ** 2) AS ss_e, count(DISTINCT seed) AS i, count(DISTINCT j) AS j FROM
    (SELECT *, avg(x) OVER (PARTITION BY arm, seed) AS rm, avg(x) OVER (PARTITION BY arm, j) AS cm, avg(x) OVER (PARTITION BY arm) AS m FROM v_crossed) GROUP BY arm""")
view("v_anova1", """SELECT arm, ss_a, ss_s, ss_e, i, j, i - 1 AS df_a, j - 1 AS df_s, (i - 1) * (j - 1) AS df_e FROM v_anova0 UNION ALL
    SELECT 'pooled', sum(ss_a), sum(ss_s), sum(ss_e), max(i), max(j), sum(i - 1), sum(j - 1), sum((i - 1) * (j - 1)) FROM v_anova0""")


@query("e27_crossed_anova", oracle(f"""SELECT arm, {i64('df_a')} AS df_a, {i64('df_s')} AS df_s, {i64('df_e')} AS df_e, {rs(10, ms_a='ss_a / df_a', ms_s='ss_s / df_s', ms_e='ss_e / df_e',
    var_a='CASE WHEN ss_a / df_a >= ss_e / df_e THEN (ss_a / df_a - ss_e / df_e) / j ELSE 0 END',
    var_e='CASE WHEN ss_a / df_a >= ss_e / df_e THEN ss_e / df_e ELSE (ss_a + ss_e) / (df_a + df_e) END', var_s='(ss_s / df_s - ss_e / df_e) / i')},
    {r('(ss_a / df_a) / (ss_e / df_e)', 6)} AS f FROM v_anova1"""))
def crossed_anova(spark, sf):
    s = op.crossed_anova(materialise(d.crossed(spark, sf)), "arm", "seed", "j", "x")
    both = s.unionByName(op.pooled_anova(s, "arm"))
    x = op.anova_components(both).select("arm", *[big(c).alias(c) for c in ("df_a", "df_s", "df_e")], "ms_a", "ms_s", "ms_e", "var_a", "var_e", "var_s", "f")
    return fix(fix(x, 10, "ms_a", "ms_s", "ms_e", "var_a", "var_e", "var_s"), 6, "f")


@query("e27_anova_tail", oracle(f"""SELECT arm, {r('f', 6)} AS f, {r(tl.f_sf_sql('f', 'df_a', 'df_e'))} AS p FROM
    (SELECT arm, (ss_a / df_a) / (ss_e / df_e) AS f, df_a, df_e FROM v_anova1 WHERE arm <> 'pooled'), v_nodes"""))
def anova_tail(spark, sf):
    """Upper tail of the adapter F ratio."""
    x = op.anova_components(op.crossed_anova(d.crossed(spark, sf), "arm", "seed", "j", "x"))
    return fix(fix(x.select("arm", "f", tl.f_sf(F.col("f"), F.col("df_a"), F.col("df_e")).alias("p")), 6, "f"), 8, "p")


@query("e28_seed_covariance", oracle(f"""SELECT n, {rs(10, cov='cov', vs='vs', noise='noise', vs_corrected='vs - noise')}, {r('rr', 6)} AS r FROM
    (SELECT count(*) AS n, covar_samp(a, b) AS cov, corr(a, b) AS rr, var_samp((a + b) / 2) AS vs FROM (SELECT j, avg(x) FILTER (arm = 'A') AS a, avg(x) FILTER (arm = 'B') AS b
    FROM v_crossed GROUP BY j)), (SELECT sum(ss_e / ((i - 1) * (j - 1))) / (4 * max(i)) AS noise FROM v_anova0)"""))
def seed_covariance(spark, sf):
    """Shared-index covariance between arms; adapter noise in the symmetric mean is (eA + eB) / (4 I)."""
    c = materialise(d.crossed(spark, sf))
    s = op.anova_components(op.crossed_anova(c, "arm", "seed", "j", "x"))
    noise = s.agg((F.sum("ms_e") / (4 * F.max("i"))).alias("noise"))
    x = op.seed_effect_covariance(c, "arm", "j", "x").select("n", "cov", "vs", "r", noise.scalar().alias("noise"))
    return fix(fix(x.withColumn("vs_corrected", F.col("vs") - F.col("noise")), 10, "cov", "vs", "noise", "vs_corrected"), 6, "r")


@query("e29_pooled_estimates", oracle(f"""SELECT k, {rs(8, fixed='f', fixed_se='fse', fixed_upper=f'f + {cr.Z99!r} * fse', random='re', random_se='rse', random_upper=f're + {cr.Z99!r} * rse')},
    {rs(6, q='q', i2='i2')}, {r('tau2', 10)} AS tau2, CASE WHEN i2 > 0.5 THEN 'random' ELSE 'fixed' END AS quoted FROM t JOIN
    (SELECT sum(theta / (v / n + tau2)) / sum(1 / (v / n + tau2)) AS re, 1 / sqrt(sum(1 / (v / n + tau2))) AS rse FROM v_adapter, t) ON true""",
    s="SELECT count(*) AS k, sum(n / v) AS w, sum(theta * n / v) / sum(n / v) AS f, 1 / sqrt(sum(n / v)) AS fse, sum((n / v) ** 2) AS ww FROM v_adapter",
    qq="SELECT any_value(s.k) AS k, any_value(f) AS f, any_value(fse) AS fse, any_value(w) AS w, any_value(ww) AS ww, sum(n / v * (theta - f) ** 2) AS q FROM v_adapter, s",
    t="SELECT *, greatest(0, (q - (k - 1)) / (w - ww / w)) AS tau2, greatest(0, (q - (k - 1)) / q) AS i2 FROM qq"))
def pooled_estimates(spark, sf):
    m = materialise(d.adapter_means(spark, sf).withColumn("se", F.sqrt(F.col("v") / F.col("n"))))
    x = op.pool_estimates(m, "theta", "se")
    return fix(fix(fix(x, 8, "fixed", "fixed_se", "fixed_upper", "random", "random_se", "random_upper"), 6, "q", "i2"), 10, "tau2")


ARM_OF_SOURCE = "CASE WHEN regexp_extract(source, '(\\d+)$', 1)::INT % 2 = 0 THEN 'A' ELSE 'B' END"


@query("e30_stratified_contrast", oracle(f"""SELECT quality, {i64('sum(n) FILTER (arm = $$A$$)')} AS n_a, {i64('sum(n) FILTER (arm = $$B$$)')} AS n_b,
    {rs(7, theta_sym='(avg(m) FILTER (arm = $$A$$) - avg(m) FILTER (arm = $$B$$)) / 2', frac_a='sum(n * f) FILTER (arm = $$A$$) / sum(n) FILTER (arm = $$A$$)')} FROM
    (SELECT {ARM_OF_SOURCE} AS arm, source, quality, count(*) AS n, avg(ln(1 + n_chars)) AS m, avg(toxic) AS f FROM v_labelled GROUP BY ALL) GROUP BY quality""".replace("$$", "'")))
def stratified_contrast(spark, sf):
    """Contrast between source arms inside each label stratum; sources are the unit."""
    arm = F.when(F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 2 == 0, "A").otherwise("B")
    per = d.labelled(spark, sf).groupBy(arm.alias("arm"), "source", "quality").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.log(1 + F.col("n_chars"))).alias("m"), F.avg("toxic").alias("f"))
    x = per.groupBy("quality").agg(
        F.sum(F.when(F.col("arm") == "A", F.col("n"))).alias("n_a"), F.sum(F.when(F.col("arm") == "B", F.col("n"))).alias("n_b"),
        ((F.avg(F.when(F.col("arm") == "A", F.col("m"))) - F.avg(F.when(F.col("arm") == "B", F.col("m")))) / 2).alias("theta_sym"),
        (F.sum(F.when(F.col("arm") == "A", F.col("n") * F.col("f"))) / F.sum(F.when(F.col("arm") == "A", F.col("n")))).alias("frac_a"))
    return fix(x, 7, "theta_sym", "frac_a")


@query("e31_label_agreement", oracle(f"""SELECT source, n, tp, tn, fp, fn, {rs(7, agreement='po', kappa='CASE WHEN pe < 1 THEN (po - pe) / nullif(1 - pe, 0) END',
    wilson_low='greatest(0, ((po + z2 / (2 * n)) - sqrt(z2) * sqrt(po * (1 - po) / n + z2 / (4 * n * n))) / (1 + z2 / n))',
    wilson_high='least(1, ((po + z2 / (2 * n)) + sqrt(z2) * sqrt(po * (1 - po) / n + z2 / (4 * n * n))) / (1 + z2 / n))')} FROM
    (SELECT *, (tp + tn) / n AS po, (tp + fn) / n * ((tp + fp) / n) + (1 - (tp + fn) / n) * (1 - (tp + fp) / n) AS pe, (1.959963984540054::DOUBLE) ** 2 AS z2 FROM
    (SELECT source, count(*) AS n, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND NOT p) AS tn, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn
    FROM (SELECT l.source, quality = 1 AS t, n_chars > med AS p FROM v_labelled l JOIN (SELECT source, quantile_cont(n_chars, 0.5) AS med FROM v_labelled GROUP BY source) USING (source))
    GROUP BY ROLLUP (source)))"""))
def label_agreement(spark, sf):
    x = materialise(d.labelled(spark, sf).select("source", "quality", "n_chars"))
    med = exact_quantiles(x, ["source"], "n_chars", {"med": 0.5})
    y = x.join(med, "source")
    a = op.agreement(y, "source", F.col("quality") == 1, F.col("n_chars") > F.col("med"))
    return fix(a, 7, "agreement", "kappa", "wilson_low", "wilson_high")


@query("e32_within_slope", oracle(f"""SELECT arm, k, {rs(7, slope='slope', top_minus_rest='tm')} FROM (SELECT arm, count(*) AS k, sum(n * cxy) / sum(n * vx) AS slope FROM
    (SELECT arm, tag, count(*) AS n, covar_pop(c, m) AS cxy, var_pop(m) AS vx FROM mc GROUP BY arm, tag) GROUP BY arm) JOIN
    (SELECT arm, avg(x) AS tm FROM (SELECT arm, tag, avg(c) FILTER (m >= q) - avg(c) FILTER (m < q) AS x FROM mc JOIN (SELECT tag, quantile_cont(m, 0.9) AS q FROM mc GROUP BY tag) USING (tag)
    GROUP BY arm, tag) GROUP BY arm) USING (arm)""", mc="SELECT arm, tag, round(rho_D, 9) AS m, c FROM v_con JOIN v_wide USING (tag, gen_idx, arm)"))
def within_slope(spark, sf):
    w = d.wide(spark, sf).where(F.col("arm").isin(d.ARMS))
    dlt = F.col("rho_A") - F.col("rho_B")
    x = materialise(w.select("arm", "tag", F.round("rho_D", 9).alias("m"), F.when(F.col("arm") == "A", dlt).otherwise(-dlt).alias("c")))
    q = exact_quantiles(x, ["tag"], "m", {"q": 0.9})
    top = x.join(q, "tag").groupBy("arm", "tag").agg(
        (F.avg(F.when(F.col("m") >= F.col("q"), F.col("c"))) - F.avg(F.when(F.col("m") < F.col("q"), F.col("c")))).alias("x"))
    s = op.within_slope(x, "arm", "tag", "m", "c").join(top.groupBy("arm").agg(F.avg("x").alias("top_minus_rest")), "arm")
    return fix(s, 7, "slope", "top_minus_rest")


@query("e33_shape", oracle(f"""SELECT arm, count(*) AS n, {rs(6, skew='avg((c - m) ** 3) / pow(avg((c - m) ** 2), 1.5)', kurtosis='avg((c - m) ** 4) / avg((c - m) ** 2) ** 2 - 3')} FROM
    (SELECT arm, c, avg(c) OVER (PARTITION BY arm) AS m FROM v_con) GROUP BY arm"""))
def shape(spark, sf):
    return fix(op.shape(d.contrasts(spark, sf), ["arm"], "c"), 6, "skew", "kurtosis")


DECILES = ", ".join(f"{r(f'quantile_cont(u, {i / 10})', 6)} AS d{i}" for i in range(1, 10))


@query("e34_fraction_uniformity", oracle(f"""SELECT count(*) AS n, {rs(7, mean='avg(u)', var='var_pop(u)', clipped_low='avg((y <= 0)::INT)', clipped_high='avg((y >= 128)::INT)',
    ks='max(greatest(rn / n - u, u - (rn - 1) / n))')}, {DECILES} FROM (SELECT y, u, row_number() OVER (ORDER BY u) AS rn, count(*) OVER () AS n FROM (SELECT y, y - floor(y) AS u FROM v_host))"""))
def fraction_uniformity(spark, sf):
    x = materialise(sg.positions(d.planted(spark, sf), ["vec_id"], y="y").select("y"))
    u = cn.uniformity(x, "y", 0.0, 128.0)
    return fix(fix(u, 7, "mean", "var", "clipped_low", "clipped_high", "ks"), 6, *[f"d{i}" for i in range(1, 10)])


@query("e37_predicted_response", oracle(f"""SELECT device, {rs(6, predicted='p', predicted_se='pse', observed='o', ratio='p / o', z='(p - o) / sqrt(pse ** 2 + ose ** 2)')} FROM
    (SELECT device, sum(e * t) AS p, sqrt(sum((e * se) ** 2)) AS pse FROM en JOIN tb USING (band) GROUP BY device) JOIN
    (SELECT device, avg(o) AS o, stddev_samp(o) / sqrt(count(*)) AS ose FROM (SELECT device, vec_id, sum(w * y * k) / sum(k * k) AS o FROM hk GROUP BY device, vec_id) GROUP BY device) USING (device)""",
    hk="SELECT h.device, h.vec_id, h.pos, h.w, h.y, t.k FROM v_h h JOIN v_e2 t USING (device, pos)",
    en="SELECT device, pos // 8 AS band, sum(k * k) / any_value(tot) AS e FROM v_e2 JOIN (SELECT device, sum(k * k) AS tot FROM v_e2 GROUP BY device) USING (device) GROUP BY device, pos // 8",
    tb="""SELECT band, avg(t) AS t, stddev_samp(t) / sqrt(count(*)) AS se FROM (SELECT vec_id, pos // 8 AS band, sum(w * y * k) / sum(k * k) AS t FROM hk GROUP BY ALL) GROUP BY band"""))
def predicted_response(spark, sf):
    """Response predicted from the template's energy per band and the bands' pooled responses."""
    x = materialise(d.planted(spark, sf))
    t = materialise(signature_arrays(x, "E2"))
    h = x.where("split = 'H'").select("device", "vec_id", "y", "w").join(t, "device")
    hk = materialise(sg.positions(h, ["device", "vec_id"], w="w", y="y", k="k"))
    band = F.floor(F.col("pos") / 8).alias("band")
    resp = F.sum(F.col("w") * F.col("y") * F.col("k")) / F.sum(F.col("k") * F.col("k"))
    tb = cn.mean_se(hk.groupBy("vec_id", band).agg(resp.alias("t_")), ["band"], "t_").select("band", F.col("m").alias("t"), "se")
    energy = sg.positions(t, ["device"], k="k").groupBy("device", band).agg(F.sum(F.col("k") * F.col("k")).alias("e"))
    total = energy.groupBy("device").agg(F.sum("e").alias("tot"))
    en = energy.join(total, "device").withColumn("e", F.col("e") / F.col("tot"))
    p = op.predicted_response(en.join(tb, "band"), "e", "t", "se", ["device"])
    o = cn.mean_se(hk.groupBy("device", "vec_id").agg(resp.alias("o")), ["device"], "o").select("device", F.col("m").alias("observed"), F.col("se").alias("ose"))
    y = p.join(o, "device").withColumns({
        "ratio": V.safe_div(F.col("predicted"), F.col("observed")),
        "z": (F.col("predicted") - F.col("observed")) / F.sqrt(F.col("predicted_se") * F.col("predicted_se") + F.col("ose") * F.col("ose")),
    }).drop("ose")
    return fix(y, 6, "predicted", "predicted_se", "observed", "ratio", "z")
