"""Paired contrasts and the group statistics built on them.

Item rows are aggregated to one row per adapter as early as possible; everything after that
works on as many rows as there are adapters, which the design of an experiment bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrapair.functions.critical import Z99, Z995, t995, t_crit
from contrapair.functions.ordered import exact_quantiles, value_counts_below, with_running
from contrapair.functions.vectors import safe_div
from contrapair.session import materialise

TAG = r"^([A-Za-z0-9]+)_raw_s(\d+)_r(\d+)$"


def parse_tag(df: DataFrame, tag: str = "tag") -> DataFrame:
    """arm, seed (a number, so that 2 sorts before 10) and rank; tags of another form are dropped."""
    x = df.where(F.col(tag).rlike(TAG))
    return x.withColumns({
        "arm": F.regexp_extract(tag, TAG, 1), "seed": F.regexp_extract(tag, TAG, 2).cast("int"),
        "rank": F.regexp_extract(tag, TAG, 3).cast("int"),
    })


def paired_contrast(df: DataFrame, keys: list[str], cand: str, value: str, own: Column, other: Column, out: str = "c") -> DataFrame:
    """own minus other of the same item by one conditional aggregation; items lacking either are left out."""
    a = F.max(F.when(F.col(cand) == own, F.col(value)))
    b = F.max(F.when(F.col(cand) == other, F.col(value)))
    x = df.groupBy(*keys).agg(a.alias("__a"), b.alias("__b"))
    return x.where(F.col("__a").isNotNull() & F.col("__b").isNotNull()).select(*keys, (F.col("__a") - F.col("__b")).alias(out))


def unpaired(df: DataFrame, keys: list[str], cand: str, own: Column, other: Column) -> DataFrame:
    """Items that lack exactly one side."""
    x = df.groupBy(*keys).agg(F.count_if(F.col(cand) == own).alias("a"), F.count_if(F.col(cand) == other).alias("b"))
    return x.where((F.col("a") == 0) != (F.col("b") == 0)).select(*keys)


def own_minus_rest(df: DataFrame, keys: list[str], cand: str, value: str, own: Column, out: str = "c") -> DataFrame:
    mine = F.col(cand) == own
    x = df.groupBy(*keys).agg(F.max(F.when(mine, F.col(value))).alias("__a"), F.avg(F.when(~mine, F.col(value))).alias("__b"))
    return x.where(F.col("__a").isNotNull() & F.col("__b").isNotNull()).select(*keys, (F.col("__a") - F.col("__b")).alias(out))


def wide_scores(df: DataFrame, keys: list[str], cand: str, value: str, candidates: list[str]) -> DataFrame:
    """One column per listed candidate, by one hash aggregation."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(cand) == c, F.col(value))).alias(c) for c in candidates])


def mean_se(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """m, sd, n, se, t by keys."""
    x = df.groupBy(*keys).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    x = x.withColumn("se", F.col("sd") / F.sqrt("n"))
    return x.withColumn("t", safe_div(F.col("m"), F.col("se")))


def upper_limit(m: Column, sd: Column, k: Column) -> Column:
    """Simultaneous 99 % limit over two arms: each at 99.5 %."""
    return m + t995(k - 1) * sd / F.sqrt(k)


def item_and_cluster_limits(contrasts: DataFrame, arm: str, tag: str, value: str) -> DataFrame:
    """Upper limits that treat items, respectively adapters, as the unit."""
    per = contrasts.groupBy(arm, tag).agg(F.avg(value).alias("m"), F.count(value).alias("n"), F.sum(value).alias("s"),
                                          F.sum(F.col(value) * F.col(value)).alias("ss"))
    x = per.groupBy(arm).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"),
        F.avg("m").alias("theta_cluster"), F.stddev_samp("m").alias("sd"), F.count(F.lit(1)).alias("k"),
    )
    theta = F.col("s") / F.col("n")
    se = F.sqrt((F.col("ss") - F.col("n") * theta * theta) / (F.col("n") - 1) / F.col("n"))
    return x.select(
        arm, "n", "k", theta.alias("theta_item"), se.alias("se_item"), (theta + Z995 * se).alias("u_item"), "theta_cluster",
        (F.col("sd") / F.sqrt("k")).alias("se_cluster"), upper_limit(F.col("theta_cluster"), F.col("sd"), F.col("k")).alias("u_cluster"),
    )


def two_arms(means: DataFrame, arm: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """kA, mA, sA, kB, mB, sB in one row (per key)."""
    aggs = []
    for a in ("A", "B"):
        v = F.when(F.col(arm) == a, F.col(value))
        aggs += [F.count(v).alias(f"k{a}"), F.avg(v).alias(f"m{a}"), F.stddev_samp(v).alias(f"s{a}")]
    return means.groupBy(*(keys or [])).agg(*aggs)


def symmetric_parts(x: DataFrame) -> DataFrame:
    return x.withColumns({
        "theta_sym": (F.col("mA") + F.col("mB")) / 2, "additive": (F.col("mA") - F.col("mB")) / 2,
    })


def max_arm_limit(x: DataFrame, factor: float = 1.0) -> DataFrame:
    """The larger arm's limit; an additive effect shifts it, unlike the symmetric limit."""
    def u(a: str) -> Column:
        return F.col(f"m{a}") + factor * t995(F.col(f"k{a}") - 1) * F.col(f"s{a}") / F.sqrt(f"k{a}")

    return x.withColumns({"u_A": u("A"), "u_B": u("B"), "u_max": F.greatest(u("A"), u("B"))})


def welch(x: DataFrame) -> DataFrame:
    """Standard error, degrees of freedom and t of the symmetric part."""
    va, vb = F.col("sA") * F.col("sA") / F.col("kA"), F.col("sB") * F.col("sB") / F.col("kB")
    den = va * va / F.nullif(F.col("kA") - 1, F.lit(0)) + vb * vb / F.nullif(F.col("kB") - 1, F.lit(0))
    y = x.withColumns({"se": F.sqrt(va + vb) / 2, "df": safe_div((va + vb) * (va + vb), den)})
    return y.withColumn("t", safe_div(F.col("theta_sym"), F.col("se")))


def denominator(real: DataFrame, role: str, value: str) -> DataFrame:
    """R, its standard error and its lower 99 % limit from held-out real items of two roles."""
    x = two_arms(real, role, value)
    r = (F.col("mA") + F.col("mB")) / 2
    se = F.sqrt((F.col("sA") * F.col("sA") / F.col("kA") + F.col("sB") * F.col("sB") / F.col("kB")) / 4)
    return x.select(r.alias("r"), se.alias("r_se"), (r - Z99 * se).alias("r_low"), F.col("kA").alias("nA"), F.col("kB").alias("nB"))


def retention(x: DataFrame, device: str, stage: str, value: str) -> DataFrame:
    """post / pre mean contrast per device, overall in the row without device, with spread max/min."""
    def at(s: str) -> Column:
        return F.avg(F.when(F.col(stage) == s, F.col(value)))

    per = x.groupBy(device).agg(at("pre").alias("pre"), at("post").alias("post"))
    per = per.withColumn("eta", safe_div(F.col("post"), F.col("pre")))
    spread = per.agg((F.max("eta") / F.nullif(F.min("eta"), F.lit(0.0))).alias("spread"))
    allrow = x.agg(at("pre").alias("pre"), at("post").alias("post")).withColumn("eta", safe_div(F.col("post"), F.col("pre")))
    allrow = allrow.select(F.lit("all").alias(device), "pre", "post", "eta", spread.scalar().alias("spread"))
    return per.select(device, "pre", "post", "eta", F.lit(None).cast("double").alias("spread")).unionByName(allrow)


def auc(df: DataFrame, keys: list[str], value: str, positive: Column, ties: str = "half") -> DataFrame:
    """Mann-Whitney AUC; only distinct scores are ordered.

    ties: "half" counts a tie as one half; "ordinal" takes places in one list, own scores before equal cross ones, so a tie
    counts nothing.
    """
    if ties not in ("half", "ordinal"):
        raise ValueError(f"unknown rule for ties: {ties}")
    vc = materialise(df.groupBy(*keys, value).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q")))
    x = with_running(vc, keys, [value], {"below": ("sum", "q")}, inclusive=False)
    wins = F.sum(F.col("p") * (F.col("below") + (F.col("q") / 2 if ties == "half" else F.lit(0))))
    return x.groupBy(*keys).agg(F.sum("p").alias("n_own"), F.sum("q").alias("n_cross"),
                                safe_div(wins, F.sum("p").cast("double") * F.sum("q")).alias("auc"))


def top_candidate(df: DataFrame, keys: list[str], cand: str, value: str) -> DataFrame:
    """Best candidate per item; equal scores go to the alphabetically first."""
    top = df.groupBy(*keys).agg(F.min(F.struct((-F.col(value)).alias("s"), F.col(cand).alias("c"))).alias("m"))
    return top.select(*keys, F.col("m.c").alias("picked"), (-F.col("m.s")).alias("best"))


def transmission(per_adapter: DataFrame, arm: str, never: str, r: Column) -> DataFrame:
    """Adapters' (C - offset) / R in percent; the offset is the mean of the never-injected adapters.

    per_adapter: arm, tag, C, C_se.
    """
    base = per_adapter.where(F.col(arm) == never).agg(
        F.avg("C").alias("off"), (F.stddev_samp("C") / F.sqrt(F.count(F.lit(1)))).alias("off_se"))
    x = per_adapter.where(F.col(arm) != never)
    x = x.select("*", base.select("off").scalar().alias("off"), base.select("off_se").scalar().alias("off_se"), r.alias("r"))
    return x.withColumns({
        "T_pct": 100 * (F.col("C") - F.col("off")) / F.col("r"),
        "T_se_pct": 100 * F.sqrt(F.col("C_se") * F.col("C_se") + F.col("off_se") * F.col("off_se")) / F.col("r"),
    })


def transmission_by_arm(t: DataFrame, arm: str) -> DataFrame:
    x = t.groupBy(arm).agg(F.count(F.lit(1)).alias("k"), F.avg("T_pct").alias("T_mean"), F.stddev_samp("T_pct").alias("sd"),
                           F.max("off_se").alias("off_se"), F.max("r").alias("r"))
    se = F.sqrt(F.col("sd") * F.col("sd") / F.col("k") + F.pow(100 * F.col("off_se") / F.col("r"), F.lit(2.0)))
    return x.select(arm, "k", "T_mean", se.alias("T_se"), (F.col("T_mean") + t_crit(F.col("k") - 1, 0.99) * se).alias("T_upper99"))


def increments(df: DataFrame, item: list[str], level: str, value: str, cluster: Column) -> DataFrame:
    """Per level: mean, and the increment over level 0 of the same items with plain and clustered t."""
    base = df.where(F.col(level) == 0).select(*item, F.col(value).alias("__base"))
    x = df.join(base, item).withColumns({"__d": F.col(value) - F.col("__base"), "__c": cluster})
    per = x.groupBy(level, "__c").agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum("__d").alias("d"), F.sum(F.col("__d") * F.col("__d")).alias("dd"))
    per = per.withColumn("cm", F.col("d") / F.col("n"))
    y = per.groupBy(level).agg(
        F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"), (F.sum("d") / F.sum("n")).alias("increment"),
        F.sum("dd").alias("dd"), F.count(F.lit(1)).alias("n_clusters"), F.avg("cm").alias("cm"), F.stddev_samp("cm").alias("csd"))
    var = (F.col("dd") - F.col("n") * F.col("increment") * F.col("increment")) / (F.col("n") - 1)
    y = y.withColumn("se", F.sqrt(F.greatest(var, F.lit(0.0)) / F.col("n")))
    return y.select(
        level, "n", "mean", "increment", "se",
        F.when(F.col(level) > 0, safe_div(F.col("increment"), F.col("se"))).alias("t"), "n_clusters",
        F.when(F.col(level) > 0, safe_div(F.col("cm"), F.col("csd") / F.sqrt("n_clusters"))).alias("t_clustered"))


def smallest_detected(inc: DataFrame, level: str, t: str = "t", cut: float = 3.0) -> Column:
    return inc.agg(F.min(F.when((F.col(level) > 0) & (F.col(t) > cut), F.col(level)))).scalar()


def leave_one_out_limits(means: DataFrame, arm: str, tag: str, value: str) -> DataFrame:
    """Limits with one adapter removed, by taking it out of (k, sum, sum of squares)."""
    tot = means.groupBy(arm).agg(F.count(F.lit(1)).alias("k"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    x = means.select(arm, tag, F.col(value).alias("__v")).join(tot, arm)
    n = F.col("k") - 1
    m = safe_div(F.col("s") - F.col("__v"), n.cast("double"))
    x = x.withColumns({"n": n, "theta": m})
    var = (F.col("ss") - F.col("__v") * F.col("__v") - F.col("n") * F.col("theta") * F.col("theta")) / F.nullif(F.col("n") - 1, F.lit(0))
    x = x.withColumn("sd", F.sqrt(F.greatest(var, F.lit(0.0))))
    return x.select(arm, tag, "n", "theta", "sd", upper_limit(F.col("theta"), F.col("sd"), F.col("n")).alias("u"))


def paired_banks(x: DataFrame, y: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adapter-wise difference of two banks."""
    b = y.select(*keys, F.col(value).alias("__b"))
    return x.join(b, keys).withColumn("d", F.col(value) - F.col("__b")).drop("__b")


def absolute_difference_to_base(df: DataFrame, keys: list[str], arm: str, value: str | list[str], base: str) -> DataFrame:
    """Mean |arm - base| over shared keys, one row per arm. Several value columns count as one key each and stay in one row until they are compared."""
    values = [value] if isinstance(value, str) else value
    b = df.where(F.col(arm) == base).groupBy(*keys).agg(*[F.avg(v).alias(f"__b{i}") for i, v in enumerate(values)])
    a = df.where(F.col(arm) != base).groupBy(arm, *keys).agg(*[F.avg(v).alias(f"__a{i}") for i, v in enumerate(values)])
    gaps = F.array(*[F.abs(F.col(f"__a{i}") - F.col(f"__b{i}")) for i in range(len(values))])
    x = a.join(b, keys).select(arm, F.explode(gaps).alias("__d"))
    return x.groupBy(arm).agg(F.count(F.lit(1)).alias("n"), F.avg("__d").alias("mad"))


def z_against_others(means: DataFrame, group: str, value: str) -> DataFrame:
    """Each value against the mean and SD of the other members of its group."""
    w = Window.partitionBy(group)
    n, s = F.count(F.lit(1)).over(w) - 1, F.sum(value).over(w) - F.col(value)
    ss = F.sum(F.col(value) * F.col(value)).over(w) - F.col(value) * F.col(value)
    x = means.withColumns({"__n": n, "__m": safe_div(s, n.cast("double")), "__ss": ss})
    sd = F.sqrt((F.col("__ss") - F.col("__n") * F.col("__m") * F.col("__m")) / F.nullif(F.col("__n") - 1, F.lit(0)))
    return x.withColumn("z", safe_div(F.col(value) - F.col("__m"), sd)).drop("__n", "__m", "__ss")


def group_medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median and population SD."""
    q = exact_quantiles(df, keys, value, {"med": 0.5})
    return q.join(df.groupBy(*keys).agg(F.stddev_pop(value).alias("sd"), F.count(value).alias("n")), keys)


def energy_distance(df: DataFrame, value: str, first: Column) -> DataFrame:
    """2 E|X-Y| - E|X-X'| - E|Y-Y'| from running counts and sums over the distinct values."""
    vc = df.groupBy(value).agg(F.count_if(first).alias("a"), F.count_if(~first).alias("b"))
    vc = materialise(vc.withColumns({"sa": F.col("a") * F.col(value), "sb": F.col("b") * F.col(value)}))
    x = with_running(vc, [], [value], {"na": ("sum", "a"), "nb": ("sum", "b"), "ta": ("sum", "sa"), "tb": ("sum", "sb")}, inclusive=False)
    v = F.col(value)

    def pairs(c: str, n: str, t: str) -> Column:
        return F.sum(F.col(c) * (v * F.col(n) - F.col(t)))

    y = x.agg(
        F.sum("a").cast("double").alias("n"), F.sum("b").cast("double").alias("m"),
        (pairs("a", "nb", "tb") + pairs("b", "na", "ta")).alias("xy"), pairs("a", "na", "ta").alias("xx"), pairs("b", "nb", "tb").alias("yy"))
    d = 2 * F.col("xy") / (F.col("n") * F.col("m")) - 2 * F.col("xx") / (F.col("n") * F.col("n")) - 2 * F.col("yy") / (F.col("m") * F.col("m"))
    return y.select(F.col("n").cast("long").alias("n"), F.col("m").cast("long").alias("m"), d.alias("energy"))


def uniformity(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Fractional parts against the uniform law: mean, variance, deciles, KS distance, saturated shares."""
    x = df.select(F.col(value).alias("v"), (F.col(value) - F.floor(value)).alias("u"))
    vb = value_counts_below(x, [], "u")
    a = x.agg(
        F.count("u").alias("n"), F.avg("u").alias("mean"), F.var_pop("u").alias("var"),
        F.avg((F.col("v") <= low).cast("double")).alias("clipped_low"), F.avg((F.col("v") >= high).cast("double")).alias("clipped_high"))
    n = a.select("n").scalar()
    ks = vb.select("*", n.alias("n")).agg(F.max(F.greatest(
        (F.col("below") + F.col("c")) / F.col("n") - F.col("u"), F.col("u") - F.col("below") / F.col("n"))).alias("ks"))
    dec = exact_quantiles(x, [], "u", {f"d{i}": i / 10 for i in range(1, 10)})
    return a.select("*", ks.scalar().alias("ks"), *[dec.select(f"d{i}").scalar().alias(f"d{i}") for i in range(1, 10)])
