"""Closed-form fits on moment sums: regressions, variance components, pooling, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrapair.functions.critical import Z99
from contrapair.functions.ordered import average_ranks
from contrapair.functions.vectors import safe_div


def item_slopes(df: DataFrame, item: list[str], level: str, value: str) -> DataFrame:
    """Mean of the per-item slopes over levels, its SE and lower 99 % limit."""
    s = df.groupBy(*item).agg(F.regr_slope(value, level).alias("b"))
    x = s.agg(F.count("b").alias("n"), F.avg("b").alias("slope"), (F.stddev_samp("b") / F.sqrt(F.count("b"))).alias("se"))
    return x.withColumn("lower99", F.col("slope") - Z99 * F.col("se"))


def weighted_line(points: DataFrame, x: str, y: str, se: str) -> DataFrame:
    """b0 + b1 x with weights 1 / se^2, from five weighted sums."""
    w = 1 / (F.col(se) * F.col(se))
    s = points.agg(
        F.sum(w).alias("w"), F.sum(w * F.col(x)).alias("wx"), F.sum(w * F.col(y)).alias("wy"),
        F.sum(w * F.col(x) * F.col(x)).alias("wxx"), F.sum(w * F.col(x) * F.col(y)).alias("wxy"))
    det = F.nullif(F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx"), F.lit(0.0))
    b1 = (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / det
    out = s.withColumn("b1", b1).withColumn("b0", (F.col("wy") - F.col("b1") * F.col("wx")) / F.col("w"))
    out = out.withColumn("se1", F.sqrt(F.col("w") / det)).withColumn("b1_low", F.col("b1") - Z99 * F.col("se1"))
    return out.select("b0", "b1", "se1", "b1_low")


def ols_one(df: DataFrame, y: str, x: str, keys: list[str] | None = None) -> DataFrame:
    """Intercept, slope, SE, t and R^2."""
    s = df.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"),
        F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cxy"))
    b = safe_div(F.col("cxy"), F.col("vx"))
    out = s.withColumn("b1", b)
    out = out.withColumn("b0", F.col("my") - F.col("b1") * F.col("mx"))
    rss = F.col("n") * (F.col("vy") - F.col("b1") * F.col("cxy"))
    out = out.withColumn("se1", F.sqrt(rss / (F.col("n") - 2) / (F.col("n") * F.col("vx"))))
    return out.withColumns({
        "t1": safe_div(F.col("b1"), F.col("se1")), "r2": safe_div(F.col("b1") * F.col("cxy"), F.col("vy")),
    }).select(*(keys or []), "n", "b0", "b1", "se1", "t1", "r2")


def ols_two(df: DataFrame, y: str, x: str, z: str) -> DataFrame:
    """Two covariates: centred moments give a 2 x 2 system."""
    n = F.count(F.lit(1))
    s = df.agg(
        n.alias("n"), F.avg(x).alias("mx"), F.avg(z).alias("mz"), F.avg(y).alias("my"),
        (F.var_pop(x) * n).alias("xx"), (F.var_pop(z) * n).alias("zz"), (F.covar_pop(x, z) * n).alias("xz"),
        (F.covar_pop(x, y) * n).alias("xy"), (F.covar_pop(z, y) * n).alias("zy"), (F.var_pop(y) * n).alias("yy"))
    s = s.withColumn("det", F.nullif(F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz"), F.lit(0.0)))
    s = s.withColumns({
        "bx": (F.col("xy") * F.col("zz") - F.col("zy") * F.col("xz")) / F.col("det"),
        "bz": (F.col("zy") * F.col("xx") - F.col("xy") * F.col("xz")) / F.col("det"),
    })
    s = s.withColumn("rss", F.col("yy") - F.col("bx") * F.col("xy") - F.col("bz") * F.col("zy"))
    s2 = F.col("rss") / (F.col("n") - 3)
    s = s.withColumns({"se_x": F.sqrt(s2 * F.col("zz") / F.col("det")), "se_z": F.sqrt(s2 * F.col("xx") / F.col("det"))})
    return s.select(
        "n", (F.col("my") - F.col("bx") * F.col("mx") - F.col("bz") * F.col("mz")).alias("b0"), "bx", "se_x",
        safe_div(F.col("bx"), F.col("se_x")).alias("t_x"), "bz", "se_z", safe_div(F.col("bz"), F.col("se_z")).alias("t_z"),
        (1 - safe_div(F.col("rss"), F.col("yy"))).alias("r2"))


def detrended(df: DataFrame, y: str, x: str, out: str) -> DataFrame:
    """y without its fitted trend on x, the mean of y kept."""
    fit = df.agg(F.regr_slope(y, x).alias("b"), F.avg(x).alias("m"))
    return df.withColumn(out, F.col(y) - fit.select("b").scalar() * (F.col(x) - fit.select("m").scalar()))


def correlations(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Pearson and Spearman by keys; Spearman is the correlation of average ranks."""
    r = average_ranks(average_ranks(df, keys, x, "__rx"), keys, y, "__ry")
    return r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("pearson"), F.corr("__rx", "__ry").alias("spearman"))


def without_group_means(df: DataFrame, group: str, values: list[str]) -> DataFrame:
    m = df.groupBy(group).agg(*[F.avg(v).alias(f"__m_{v}") for v in values])
    x = df.join(m, group)
    return x.withColumns({v: F.col(v) - F.col(f"__m_{v}") for v in values}).drop(*[f"__m_{v}" for v in values])


def crossed_anova(cells: DataFrame, group: str, row: str, col: str, value: str) -> DataFrame:
    """Balanced two-way analysis without replication per group: mean squares and moment components.

    Row, column and grand means come from three small aggregations of the grid.
    """
    rows = cells.groupBy(group, row).agg(F.avg(value).alias("__r"), F.count(F.lit(1)).alias("__nc"))
    cols = cells.groupBy(group, col).agg(F.avg(value).alias("__c"), F.count(F.lit(1)).alias("__nr"))
    grand = cells.groupBy(group).agg(F.avg(value).alias("__m"))
    x = cells.join(rows, [group, row]).join(cols, [group, col]).join(grand, group)
    res = F.col(value) - F.col("__r") - F.col("__c") + F.col("__m")
    s = x.groupBy(group).agg(
        F.sum((F.col("__r") - F.col("__m")) * (F.col("__r") - F.col("__m"))).alias("ss_a"),
        F.sum((F.col("__c") - F.col("__m")) * (F.col("__c") - F.col("__m"))).alias("ss_s"),
        F.sum(res * res).alias("ss_e"), F.max("__nr").alias("i"), F.max("__nc").alias("j"), F.count(F.lit(1)).alias("n"))
    bad = F.raise_error(F.lit("grid is not balanced")).cast("bigint")
    s = s.withColumn("n", F.when(F.col("n") == F.col("i") * F.col("j"), F.col("n")).otherwise(bad))
    return s.withColumns({"df_a": F.col("i") - 1, "df_s": F.col("j") - 1, "df_e": (F.col("i") - 1) * (F.col("j") - 1)})


def anova_components(s: DataFrame) -> DataFrame:
    """Mean squares, F and variance components with the boundary at zero."""
    s = s.withColumns({
        "ms_a": F.col("ss_a") / F.col("df_a"), "ms_s": F.col("ss_s") / F.col("df_s"), "ms_e": F.col("ss_e") / F.col("df_e"),
    })
    inside = F.col("ms_a") >= F.col("ms_e")
    return s.withColumns({
        "f": F.col("ms_a") / F.col("ms_e"),
        "var_a": F.when(inside, (F.col("ms_a") - F.col("ms_e")) / F.col("j")).otherwise(0.0),
        "var_e": F.when(inside, F.col("ms_e")).otherwise((F.col("ss_a") + F.col("ss_e")) / (F.col("df_a") + F.col("df_e"))),
        "var_s": (F.col("ms_s") - F.col("ms_e")) / F.col("i"),
    })


def pooled_anova(s: DataFrame, label: str, name: str = "pooled") -> DataFrame:
    """Sums over groups: common components, group-specific means and column effects."""
    return s.agg(
        F.sum("ss_a").alias("ss_a"), F.sum("ss_s").alias("ss_s"), F.sum("ss_e").alias("ss_e"), F.max("i").alias("i"), F.max("j").alias("j"),
        F.sum("n").alias("n"), F.sum("df_a").alias("df_a"), F.sum("df_s").alias("df_s"), F.sum("df_e").alias("df_e"),
    ).select(F.lit(name).alias(label), "*")


def one_way_icc(df: DataFrame, group: str, value: str) -> DataFrame:
    """ICC(1,1), clamped at zero; groups may differ in size.

    n0 = (N - sum n^2 / N) / (k - 1) takes the place of the common size and equals it where sizes are equal; the grand mean
    weighs values alike.
    """
    g = df.groupBy(group).agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"), F.count(value).alias("n")).where("n > 0")
    s = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.max("n").alias("n"),
              (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum(F.col("v") * F.col("n")).alias("ssw"),
              F.collect_list(F.struct("n", "m")).alias("groups"))
    between = F.aggregate("groups", F.lit(0.0), lambda a, x: a + x["n"] * (x["m"] - F.col("grand")) * (x["m"] - F.col("grand")))
    s = s.withColumns({"n0": safe_div(F.col("total") - F.col("nn") / F.col("total"), (F.col("k") - 1).cast("double")),
                       "ms_between": safe_div(between, (F.col("k") - 1).cast("double")), "within": safe_div(F.col("ssw"), (F.col("total") - F.col("k")).cast("double"))})
    s = s.withColumn("var_u", F.greatest(safe_div(F.col("ms_between") - F.col("within"), F.col("n0")), F.lit(0.0)))
    return s.select("k", "n", "n0", "grand", "ms_between", "within", "var_u",
                    F.coalesce(safe_div(F.col("var_u"), F.col("var_u") + F.col("within")), F.lit(0.0)).alias("icc"))


def pool_estimates(df: DataFrame, value: str, se: str) -> DataFrame:
    """Fixed and DerSimonian-Laird random effects, Q, I^2 and the one to quote."""
    w = 1 / (F.col(se) * F.col(se))
    s = df.agg(F.count(F.lit(1)).alias("k"), F.sum(w).alias("w"), F.sum(w * F.col(value)).alias("wx"),
               F.sum(w * F.col(value) * F.col(value)).alias("wxx"), F.sum(w * w).alias("ww"))
    s = s.withColumns({"fixed": F.col("wx") / F.col("w"), "fixed_se": 1 / F.sqrt("w")})
    s = s.withColumns({"q": F.col("wxx") - F.col("wx") * F.col("fixed"), "c": F.col("w") - F.col("ww") / F.col("w")})
    excess = F.col("q") - (F.col("k") - 1)
    s = s.withColumns({
        "tau2": F.when(F.col("c") > 0, F.greatest(F.lit(0.0), excess / F.nullif("c", F.lit(0.0)))).otherwise(0.0),
        "i2": F.when(F.col("q") > 0, F.greatest(F.lit(0.0), excess / F.nullif("q", F.lit(0.0)))).otherwise(0.0),
    })
    w2 = 1 / (F.col(se) * F.col(se) + s.select("tau2").scalar())
    r = df.agg((F.sum(w2 * F.col(value)) / F.sum(w2)).alias("random"), (1 / F.sqrt(F.sum(w2))).alias("random_se"))
    return s.select(
        "k", "fixed", "fixed_se", "q", "tau2", "i2", r.select("random").scalar().alias("random"), r.select("random_se").scalar().alias("random_se"),
        F.when(F.col("i2") > 0.5, "random").otherwise("fixed").alias("quoted"),
        (F.col("fixed") + Z99 * F.col("fixed_se")).alias("fixed_upper"),
    ).withColumn("random_upper", F.col("random") + Z99 * F.col("random_se"))


def agreement(df: DataFrame, stratum: str, truth: Column, guess: Column) -> DataFrame:
    """Confusion counts by stratum and in total (null stratum), Cohen's kappa, Wilson interval of agreement."""
    z = 1.959963984540054
    x = df.select(stratum, truth.alias("__t"), guess.alias("__p"))
    c = x.rollup(stratum).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("__t") & F.col("__p")).alias("tp"), F.count_if(~F.col("__t") & ~F.col("__p")).alias("tn"),
        F.count_if(~F.col("__t") & F.col("__p")).alias("fp"), F.count_if(F.col("__t") & ~F.col("__p")).alias("fn"))
    n = F.col("n")
    c = c.withColumns({"po": (F.col("tp") + F.col("tn")) / n, "a": (F.col("tp") + F.col("fn")) / n, "b": (F.col("tp") + F.col("fp")) / n})
    c = c.withColumn("pe", F.col("a") * F.col("b") + (1 - F.col("a")) * (1 - F.col("b")))
    d = 1 + z * z / n
    mid = (F.col("po") + z * z / (2 * n)) / d
    half = z * F.sqrt(F.col("po") * (1 - F.col("po")) / n + z * z / (4 * n * n)) / d
    return c.select(
        stratum, "n", "tp", "tn", "fp", "fn", F.col("po").alias("agreement"),
        F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / F.nullif(1 - F.col("pe"), F.lit(0.0))).alias("kappa"),
        F.greatest(F.lit(0.0), mid - half).alias("wilson_low"), F.least(F.lit(1.0), mid + half).alias("wilson_high"))


def within_slope(df: DataFrame, group: str, cluster: str, x: str, y: str) -> DataFrame:
    """Slope of y on x after removing cluster means, pooled by group, from cluster moments only."""
    m = df.groupBy(group, cluster).agg(F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("cxy"), F.var_pop(x).alias("vx"))
    return m.groupBy(group).agg(
        F.count(F.lit(1)).alias("k"), safe_div(F.sum(F.col("n") * F.col("cxy")), F.sum(F.col("n") * F.col("vx"))).alias("slope"))


def shape(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Population skewness and excess kurtosis."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurtosis"))


def candidate_effects(cells: DataFrame, keys: list[str], cand: str, value: str) -> DataFrame:
    """Candidate main effects b_K = mean over the fitted rows minus their grand mean."""
    g = cells.groupBy(*keys).agg(F.avg(value).alias("__g"))
    b = cells.groupBy(*keys, cand).agg(F.avg(value).alias("__k"))
    x = b.join(g, keys) if keys else b.select("*", g.scalar().alias("__g"))
    return x.select(*keys, cand, (F.col("__k") - F.col("__g")).alias("b"))


def own_minus_mean(df: DataFrame, keys: list[str], cand: str, own: str, value: str, out: str) -> DataFrame:
    """value of the own candidate minus the mean of the others, by keys (which fix `own`)."""
    mine = F.col(cand) == F.col(own)
    return df.groupBy(*keys).agg((F.max(F.when(mine, F.col(value))) - F.avg(F.when(~mine, F.col(value)))).alias(out))


def cross_seed_additive(cells: DataFrame, tag: str, own: str, seed: str, cand: str, value: str) -> DataFrame:
    """Held-out check of the additive model: fit candidate effects on one seed, predict the others.

    cells: one row per (tag, candidate). Rows: (fitted seed, held-out tag, own, predicted, observed).
    """
    b = candidate_effects(cells.withColumnRenamed(seed, "fit_seed"), ["fit_seed"], cand, value)
    tot = b.groupBy("fit_seed").agg(F.sum("b").alias("__t"), F.count(F.lit(1)).alias("__n"))
    rest = (F.col("__t") - F.col("b")) / (F.col("__n") - 1)
    pred = b.join(tot, "fit_seed").select("fit_seed", F.col(cand).alias(own), (F.col("b") - rest).alias("predicted"))
    obs = own_minus_mean(cells, [tag, own, seed], cand, own, value, "observed")
    return obs.join(pred, own).where(F.col("fit_seed") != F.col(seed))


def fit_quality(df: DataFrame, predicted: str, observed: str) -> DataFrame:
    d = F.col(observed) - F.col(predicted)
    x = df.agg(F.count(F.lit(1)).alias("n"), F.sum(d * d).alias("rss"), (F.var_pop(observed) * F.count(F.lit(1))).alias("tss"), F.corr(predicted, observed).alias("r"))
    return x.select("n", (1 - safe_div(F.col("rss"), F.col("tss"))).alias("r2"), "r", F.sqrt(F.col("rss") / F.col("n")).alias("rmse"))


def off_diagonal_residuals(cells: DataFrame, tag: str, own: str, cand: str, value: str) -> DataFrame:
    """Own-cell residual of the additive fit made without the own cells."""
    off = cells.where(F.col(cand) != F.col(own))
    g = off.agg(F.avg(value))
    a = off.groupBy(tag).agg(F.avg(value).alias("__a"))
    b = off.groupBy(cand).agg(F.avg(value).alias("__b"))
    x = cells.where(F.col(cand) == F.col(own)).join(a, tag).join(b, cand)
    x = x.withColumn("predicted", F.col("__a") + F.col("__b") - g.scalar())
    return x.select(tag, own, "predicted", F.col(value).alias("observed"), (F.col(value) - F.col("predicted")).alias("residual"))


def seed_effect_covariance(cells: DataFrame, arm: str, j: str, value: str) -> DataFrame:
    """Covariance of the arms' shared-index means and the symmetric variance without adapter noise."""
    m = cells.groupBy(j).agg(
        F.avg(F.when(F.col(arm) == "A", F.col(value))).alias("a"), F.avg(F.when(F.col(arm) == "B", F.col(value))).alias("b"))
    return m.agg(F.count(F.lit(1)).alias("n"), F.covar_samp("a", "b").alias("cov"), F.corr("a", "b").alias("r"), F.var_samp((F.col("a") + F.col("b")) / 2).alias("vs"))


def predicted_response(bands: DataFrame, energy: str, response: str, se: str, keys: list[str]) -> DataFrame:
    """sum e_b T_b and its propagated SE."""
    e = F.col(energy)
    return bands.groupBy(*keys).agg(
        F.sum(e * F.col(response)).alias("predicted"), F.sqrt(F.sum(e * F.col(se) * e * F.col(se))).alias("predicted_se"))


