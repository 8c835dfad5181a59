"""Exact tests, permutations, bootstraps, attribution and multiplicity.

Randomness is the portable hash, so a draw is a function of (unit, replicate). Units are
aggregated to the resampling level before any replicate is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrapair.functions import tails
from contrapair.functions.hashing import P, hash_sign, portable_hash
from contrapair.functions.ordered import MAX_CUTS, with_rank
from contrapair.functions.vectors import safe_div
from contrapair.operators.contrasts import max_arm_limit, symmetric_parts, two_arms
from contrapair.operators.exact import SCALE, label_permutation, scaled, sign_flip, swap_counts  # noqa: F401
from contrapair.session import materialise


def prediction_permutation(pairs: DataFrame, key: str, predicted: str, observed: str) -> DataFrame:
    """Exact p of R^2 over all assignments of predictions to devices; k <= 8."""
    spark = pairs.sparkSession
    one = pairs.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("o"), F.col(predicted).alias("p"), F.col(observed).alias("q")))).alias("a"))
    k = pairs.count()
    if k > 8:
        raise ValueError("too many devices to enumerate")
    # base-k digits that are all different are exactly the permutations
    digits = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.floor(F.col("id") / F.pow(F.lit(float(k)), i)) % k).cast("int"))
    x = spark.range(0, k**k, 1, max(1, k**k >> 16)).select(digits.alias("d"), one.scalar().alias("a"))
    x = x.where(F.size(F.array_distinct("d")) == k)
    mean = F.aggregate(F.transform("a", lambda e: e["q"]), F.lit(0.0), lambda s, e: s + e) / k
    x = x.withColumn("m", mean)
    tss = F.aggregate(F.transform("a", lambda e: (e["q"] - F.col("m")) * (e["q"] - F.col("m"))), F.lit(0.0), lambda s, e: s + e)
    res = F.transform("d", lambda j, i: F.element_at("a", i + 1)["q"] - F.element_at("a", j + 1)["p"])
    rss = F.aggregate(F.transform(res, lambda e: e * e), F.lit(0.0), lambda s, e: s + e)
    x = x.select(F.round(1 - rss / F.nullif(tss, F.lit(0.0)), 9).alias("r2"), (F.col("d") == F.sequence(F.lit(0), F.lit(k - 1))).alias("is_identity"))
    obs = x.where("is_identity").agg(F.max("r2"))
    y = x.select("r2", obs.scalar().alias("obs"))
    return y.agg(F.max("obs").alias("r2"), F.count(F.lit(1)).alias("permutations"), F.count_if(F.col("r2") >= F.col("obs")).alias("hits")).withColumn(
        "p", F.col("hits") / F.col("permutations"))


def monte_carlo_sign_flip(df: DataFrame, group: str, uid: Column, value: str, reps: int, salt: int) -> DataFrame:
    """Sign-flip p of item-level contrasts over hashed sign vectors, (c + 1) / (N + 1)."""
    x = df.select(group, uid.alias("__u"), scaled(F.col(value)).alias("__v"), F.explode(F.sequence(F.lit(0), F.lit(reps))).alias("rep"))
    # replicate 0 is the observed assignment
    signed = F.when(F.col("rep") == 0, F.col("__v")).otherwise(F.col("__v") * hash_sign(F.col("__u"), F.col("rep"), salt))
    s = x.groupBy(group, "rep").agg(F.sum(signed).alias("s"))
    obs = s.where("rep = 0").select(group, F.col("s").alias("obs"))
    y = s.where("rep > 0").join(obs, group)
    return y.groupBy(group).agg(F.count(F.lit(1)).alias("reps"), F.count_if(F.col("s") >= F.col("obs")).alias("hits")).withColumn(
        "p", (F.col("hits") + 1) / (F.col("reps") + 1))


def monte_carlo_two_sample(df: DataFrame, first: Column, uid: Column, value: str, reps: int, salt: int, cells: int | None = None) -> DataFrame:
    """Two-sample permutation p: in each replicate the nA units of smallest hash form group A.

    The cut is found from counts per hash cell; only the cell that holds it is ordered row by row.
    """
    # cells grow with the cluster, so that one cell stays a small task
    cells = cells or min(1 << 20, max(1024, 16 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    x = df.select(first.alias("__a"), uid.alias("__u"), scaled(F.col(value)).alias("__v"))
    tot = x.agg(F.count_if("__a").alias("na"), F.sum(F.when(F.col("__a"), F.col("__v"))).alias("obs"))
    y = x.select("__u", "__v", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    y = y.withColumn("__h", portable_hash(F.col("__u"), F.col("rep"), salt))
    y = y.withColumn("__c", F.floor(F.col("__h") * cells / P).cast("int"))
    per = y.groupBy("rep", "__c").agg(F.count(F.lit(1)).alias("n"), F.sum("__v").alias("s"))
    w = Window.partitionBy("rep").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("rep", "__c", "n", "s", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"), F.coalesce(F.sum("s").over(w), F.lit(0)).alias("sum_before"),
                     tot.select("na").scalar().alias("na"), tot.select("obs").scalar().alias("obs"))
    cut = per.where((F.col("before") < F.col("na")) & (F.col("before") + F.col("n") >= F.col("na")))
    # one row per replicate, so it may travel to the rows
    edge = y.join(F.broadcast(cut.select("rep", "__c", "before", "sum_before", "na", "obs")), ["rep", "__c"])
    rn = F.row_number().over(Window.partitionBy("rep", "__c").orderBy("__h", "__u"))
    edge = edge.withColumn("rn", rn).where(F.col("rn") + F.col("before") <= F.col("na"))
    s = edge.groupBy("rep").agg((F.max("sum_before") + F.sum("__v")).alias("s"), F.max("obs").alias("obs"))
    return s.agg(F.count(F.lit(1)).alias("reps"), F.count_if(F.col("s") >= F.col("obs")).alias("hits")).withColumn(
        "p", (F.col("hits") + 1) / (F.col("reps") + 1))


def pair_cosines(df: DataFrame, unit: list[str], pos: str, value: str) -> DataFrame:
    """Cosine of every pair of adapters from their centred position vectors; adapters are few by design."""
    m = df.groupBy(*unit).agg(F.avg(value).alias("__m"))
    z = df.join(m, unit).withColumn("z", F.col(value) - F.col("__m"))
    a = z.select(*[F.col(u).alias(f"{u}_x") for u in unit], pos, F.col("z").alias("zx"))
    b = z.select(*[F.col(u).alias(f"{u}_y") for u in unit], pos, F.col("z").alias("zy"))
    keys = [f"{u}_{s}" for s in "xy" for u in unit]
    left, right = F.struct(*[F.col(f"{u}_x") for u in unit]), F.struct(*[F.col(f"{u}_y") for u in unit])
    p = a.join(b, pos).where(left < right)
    return p.groupBy(*keys).agg(safe_div(
        F.sum(F.col("zx") * F.col("zy")), F.sqrt(F.sum(F.col("zx") * F.col("zx")) * F.sum(F.col("zy") * F.col("zy")))).alias("cos"))


def seed_pair_relabelling(pairs: DataFrame, cond: str, seed: str, value: str, n_seeds: int) -> DataFrame:
    """Swap the two conditions inside each seed pair, all 2^n ways: mean same-label minus mean cross-label cosine.

    Pairs sharing a seed are left out; under every swap the two kinds keep their counts.
    """
    x = pairs.where(F.col(f"{seed}_x") != F.col(f"{seed}_y")).select(
        F.col(f"{seed}_x").cast("int").alias("sx"), F.col(f"{seed}_y").cast("int").alias("sy"),
        (F.col(f"{cond}_x") == F.col(f"{cond}_y")).alias("same"), scaled(F.col(value)).alias("v"))
    # swapping exactly one of the two seeds turns same-label into cross-label
    signed = F.when(F.col("same"), F.col("v")).otherwise(-F.col("v"))
    g = materialise(x.groupBy("sx", "sy").agg(F.sum(signed).alias("d"), F.count_if("same").alias("same")))
    facts = g.agg((F.sum("d") / F.sum("same") / SCALE).alias("d"))
    return swap_counts(g.select("sx", "sy", "d"), n_seeds).select(facts.scalar().alias("d"), "relabellings", "hits").withColumn(
        "p", F.col("hits") / F.col("relabellings"))


def cluster_draws(clusters: DataFrame, arm: str, place: str, k: str, reps: int, salt: int) -> DataFrame:
    """(arm, rep, slot, place): slot `place` of a replicate draws a cluster of the same arm."""
    stream = F.when(F.col(arm) == "A", 0).otherwise(1)
    x = clusters.select(arm, F.col(place).alias("slot"), k, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    drawn = portable_hash(F.col("slot"), F.col("rep") * 2 + stream, salt) % F.col(k) + 1
    return x.select(arm, "rep", "slot", drawn.alias(place))


def limits_by_replicate(slots: DataFrame, arm: str, value: str) -> DataFrame:
    """rep, theta_sym, additive, u_max."""
    return max_arm_limit(symmetric_parts(two_arms(slots, arm, value, ["rep"])))


def percentiles(df: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """Percentiles over replicates; there are as many rows as replicates."""
    return df.agg(*[F.percentile(value, F.lit(q)).alias(n) for n, q in probs.items()])


def bca_limit(boots: DataFrame, value: str, theta: Column, jack: DataFrame, jvalue: str, level: float = 0.995) -> DataFrame:
    """Bias-corrected accelerated upper limit; jack holds the leave-one-cluster-out values.

    Where no replicate or every one lies below the estimate the correction is infinite, and the limit is null.
    """
    jm = jack.agg(F.avg(jvalue)).scalar()
    j = jack.select((jm - F.col(jvalue)).alias("d"))
    acc = j.agg(F.sum(F.pow("d", F.lit(3.0))).alias("num"), (6 * F.pow(F.sum(F.col("d") * F.col("d")), F.lit(1.5))).alias("den"))
    b = boots.select(F.col(value).alias("b"), theta.alias("theta")).agg(
        F.avg((F.col("b") < F.col("theta")).cast("double")).alias("below"), F.max("theta").alias("theta"), F.sort_array(F.collect_list("b")).alias("s"))
    x = b.select("*", acc.select(F.coalesce(safe_div(F.col("num"), F.col("den")), F.lit(0.0))).scalar().alias("a"))
    x = x.withColumns({"z0": tails.normal_quantile(F.col("below")), "z": tails.normal_quantile(F.lit(level))})
    t = F.col("z0") + F.col("z")
    x = x.withColumn("alpha", tails.normal_cdf(F.col("z0") + t / (1 - F.col("a") * t)))
    pos = F.greatest(F.least(F.col("alpha"), F.lit(1 - 1e-6)), F.lit(1e-6)) * (F.size("s") - 1)
    lo = F.element_at("s", F.floor(pos).cast("int") + 1)
    hi = F.element_at("s", F.ceil(pos).cast("int") + 1)
    return x.select("theta", "below", "a", "alpha", (lo + (hi - lo) * (pos - F.floor(pos))).alias("limit"))


def mean_bootstrap(df: DataFrame, place: str, value: str, reps: int, salt: int) -> DataFrame:
    """Bootstrap means of one row per cluster: rep, m."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    slots = df.select(F.col(place).alias("slot"), n.scalar().alias("n"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    drawn = slots.select("rep", (portable_hash(F.col("slot"), F.col("rep"), salt) % F.col("n") + 1).alias(place))
    return drawn.join(df.select(place, value), place).groupBy("rep").agg(F.avg(value).alias("m"))


def shared_index_means(cells: DataFrame, keys: list[str], j: str, value: str, n: int, reps: int, salt: int) -> DataFrame:
    """Adapter means when the same resampled indices serve every adapter: keys, rep, value.

    cells: one row per adapter and index 0..n-1, already averaged.
    """
    spark = cells.sparkSession
    slots = spark.range(0, reps * n).select(F.floor(F.col("id") / n).alias("rep"), (F.col("id") % n).alias("slot"))
    m = slots.groupBy("rep", (portable_hash(F.col("slot"), F.col("rep"), salt) % n).alias(j)).agg(F.count(F.lit(1)).alias("m"))
    x = cells.join(m, j)
    return x.groupBy(*keys, "rep").agg((F.sum(F.col("m") * F.col(value)) / F.sum("m")).alias(value))


def relative_changes(a: DataFrame, b: DataFrame, measures: list[str], cut: float = 0.10) -> DataFrame:
    """Replicate-wise b / a - 1 of each measure: mean, SD, 95 % range, share beyond the cut."""
    y = a.select("rep", *measures).join(b.select("rep", *[F.col(c).alias(f"{c}_b") for c in measures]), "rep")
    pairs = F.array(*[F.struct(F.lit(c).alias("measure"), (safe_div(F.col(f"{c}_b"), F.col(c)) - 1).alias("rel")) for c in measures])
    x = y.select("rep", F.inline(pairs))
    return x.groupBy("measure").agg(
        F.count("rel").alias("reps"), F.avg("rel").alias("mean"), F.stddev_samp("rel").alias("sd"), F.percentile("rel", F.lit(0.025)).alias("p2_5"),
        F.percentile("rel", F.lit(0.975)).alias("p97_5"), F.avg((F.abs("rel") > cut).cast("double")).alias("beyond"))


def main_effects(x: DataFrame, cand: str, own: str, value: str, weight: Column, keys: list[str] | None = None) -> DataFrame:
    """b_K: mean score of candidate K over items of adapters that do not own K."""
    keys = keys or []
    other = x.where(F.col(cand) != F.col(own))
    return other.groupBy(*keys, cand).agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias("b"))


def block_means(scores: DataFrame, tag: str, own: str, cand: str, value: str, order: str, block: int) -> DataFrame:
    """Mean score per complete block of consecutive items and candidate: tag, own, block, candidate, m.

    scores: long rows; the incomplete last block of an adapter is dropped.
    """
    ids = with_rank(scores.select(tag, order).distinct(), [tag], [order], "__rn", "__n")
    ids = ids.withColumn("block", F.floor((F.col("__rn") - 1) / block)).where((F.col("block") + 1) * block <= F.col("__n"))
    x = scores.join(ids.select(tag, order, "block"), [tag, order])
    return x.groupBy(tag, own, "block", cand).agg(F.avg(value).alias("m"))


def attribute(blocks: DataFrame, tag: str, own: str, cand: str, main: DataFrame | None = None) -> DataFrame:
    """One row per block: its own device and the candidate of highest mean, raw or less the main effects."""
    m = blocks
    if main is not None:
        m = m.join(main, cand).withColumn("m", F.col("m") - F.col("b"))
    top = m.groupBy(tag, own, "block").agg(F.min(F.struct((-F.round("m", 12)).alias("s"), F.col(cand).alias("c"))).alias("t"))
    return top.select(tag, own, "block", F.col("t.c").alias("picked"))


def attribution_margins(cells: DataFrame, main: DataFrame, tag: str, own: str, cand: str, value: str) -> DataFrame:
    """Best other minus own corrected score; an adapter is attributed to its own at shift d iff margin < d."""
    x = cells.join(main, cand).withColumn("__c", F.col(value) - F.col("b"))
    mine = F.col(cand) == F.col(own)
    return x.groupBy(tag, own).agg((F.max(F.when(~mine, F.col("__c"))) - F.max(F.when(mine, F.col("__c")))).alias("margin"))


def accuracy_at_shifts(margins: DataFrame, keys: list[str], rep: str, margin: str, shifts: list[float]) -> DataFrame:
    """keys, shift, reps, accuracy, low, high: share of units whose margin lies below each shift, with its 95 % range over replicates.

    All shifts are conditional means of one aggregation; units are not repeated for them.
    """
    per = margins.groupBy(*keys, rep).agg(F.array(*[
        F.struct(F.lit(float(s)).alias("shift"), F.avg((F.col(margin) < s).cast("double")).alias("a")) for s in shifts]).alias("s"))
    x = per.select(*keys, rep, F.inline("s"))
    return x.groupBy(*keys, "shift").agg(F.count(F.lit(1)).alias("reps"), F.avg("a").alias("accuracy"),
                                         F.percentile("a", F.lit(0.025)).alias("low"), F.percentile("a", F.lit(0.975)).alias("high"))


def hashed_subsets(items: DataFrame, tag: str, uid: Column, value: str, size: int, reps: int, salt: int) -> DataFrame:
    """Mean of `size` items per adapter and replicate, the ones of smallest hash.

    Rows above a hash below which about four times as many lie are left out before anything is sorted. Where `size` rows
    (all, if there are fewer) are not left, the adapter's replicate goes through all its rows, so the choice is exact.
    """
    n = materialise(items.groupBy(tag).agg(F.count(F.lit(1)).alias("__n")))
    most = F.floor((4 * size + 64) * F.lit(float(P)) / F.col("__n"))
    x = items.join(n, items[tag].eqNullSafe(n[tag])).drop(n[tag])
    x = x.select(tag, uid.alias("__u"), value, "__n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    x = x.withColumn("__h", portable_hash(F.col("__u"), F.col("rep"), salt))
    rn = F.row_number().over(Window.partitionBy(tag, "rep").orderBy("__h", "__u"))

    def chosen(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__rn", rn).where(F.col("__rn") <= size).groupBy(tag, "rep").agg(
            F.avg(value).alias("m"), F.count(F.lit(1)).alias("n"), F.max("__n").alias("__n"))

    first = materialise(chosen(x.where(F.col("__h") <= most)))
    enough = F.col("n") >= F.least(F.lit(size), F.col("__n"))
    keys = n.select(tag, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    out, same = first.where(enough), lambda a, b: a[tag].eqNullSafe(b[tag]) & (a["rep"] == b["rep"])
    short = materialise(keys.join(out, same(keys, out), "left_anti"))
    if not short.isEmpty():
        out = out.unionByName(chosen(x.join(short, same(x, short), "left_semi")))
    return out.drop("__n")


def holm(ps: DataFrame, name: str, p: str, alpha: float) -> DataFrame:
    """Step-down: reject while p <= alpha / (m - i) holds for every smaller p."""
    w = Window.orderBy(p, name)
    x = ps.withColumns({"i": F.row_number().over(w) - 1, "m": F.count(F.lit(1)).over(Window.partitionBy())})
    x = x.withColumn("threshold", F.lit(alpha) / (F.col("m") - F.col("i")))
    ok = F.min((F.col(p) <= F.col("threshold")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("reject", ok == 1)


def calibrate_multiplier(reps: DataFrame, cell: str, truth: str, low: int, high: int, level: float) -> DataFrame:
    """Smallest multiplier (in hundredths low..high) whose worst-cell coverage reaches the level.

    reps: cell, rep, truth, mA, hA, mB, hB, with half-widths at multiplier 1.
    """
    x = reps.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("c100"))
    c = F.col("c100") / 100
    u = F.greatest(F.col("mA") + c * F.col("hA"), F.col("mB") + c * F.col("hB"))
    cov = x.groupBy(cell, "c100").agg(F.avg((u >= F.col(truth)).cast("double")).alias("coverage"))
    worst = cov.groupBy("c100").agg(F.min("coverage").alias("worst"))
    return worst.agg(
        F.min(F.when(F.col("worst") >= level, F.col("c100") / 100)).alias("multiplier"),
        F.max(F.when(F.col("c100") == 100, F.col("worst"))).alias("worst_at_1"), F.max("worst").alias("best_worst"))


def permuted_within(df: DataFrame, cluster: str, rn: str, uid: Column, covariate: str, reps: int, salt: int) -> DataFrame:
    """Covariate reassigned inside each cluster: the item of hash rank r receives the covariate of place r."""
    x = df.withColumn("__u", uid).select("*", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    x = x.withColumn("__h", portable_hash(F.col("__u"), F.col("rep"), salt))
    # hashes spread evenly over 0 to P
    cells = max(8, min(MAX_CUTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    x = with_rank(x.drop(rn, covariate), [cluster, "rep"], ["__h", "__u"], "__to", cuts=[P * i / cells for i in range(1, cells)])
    y = df.select(cluster, F.col(rn).alias("__to"), covariate)
    return x.join(y, [cluster, "__to"]).drop("__to", "__h", "__u")
