"""Exact tests over all assignments without listing them.

A sum over a subset of k numbers is a sum over a subset of the first half plus one over the second, so 2^k assignments are
counted from two tables of 2^(k/2) half sums: equal sums are merged into one row with its count, both tables are put in one
order, and a running count says for each right-hand sum how many left-hand ones reach what it still needs. Sums are whole
numbers, so ties are exact. Half sums of each group are made by doubling: one pass over the numbers, one table row a sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrapair.functions.ordered import with_running
from contrapair.session import materialise

#: Whole-number form of means: nine decimals unless the caller's values are smaller.
SCALE = 10**9
#: Counts are 64-bit, and half of the numbers must be listed: 2^30 half sums at most.
MOST = 60
#: Numbers whose subset sums one task makes at once.
AT_ONCE = 16


def scaled(c: Column, scale: int = SCALE) -> Column:
    """Whole-number form of a mean, so that equal sums compare equal in any order of addition.

    The thousandth keeps exact halves on one side whatever their last bit.
    """
    return F.round(c * scale + 0.001).cast("long")


def packed(means: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """keys, v: each group's numbers in order, k of them. A group is one row of at most MOST numbers."""
    a = F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], value.alias("v"))))
    x = means.groupBy(*keys).agg(F.transform(a, lambda s: s["v"]).alias("v"))
    k = F.size("v")
    too_many = F.raise_error(F.format_string("2^%d assignments can't be counted in 64 bits; use the Monte-Carlo test", k)).cast("array<bigint>")
    return x.withColumn("v", F.when(k <= MOST, F.col("v")).otherwise(too_many))


def half_sums(groups: DataFrame, keys: list[str], numbers: Column, most: int, sized: bool, out: str) -> DataFrame:
    """keys, (chosen,) out, c: the sums of all subsets of an array column, each with the number of subsets that have it.

    ``most`` is the length of the longest array. Sixteen numbers at most are summed in one go (65,536 sums, merged by value); further ones double the table as a
    distributed step each, so that no task holds all sums of a large half.
    """
    head = F.slice(numbers, 1, AT_ONCE)
    key_types = {f.name: f.dataType.simpleString() for f in groups.schema.fields}
    names = [*keys, "chosen", out, "c"]
    schema = ", ".join([f"`{k}` {key_types[k]}" for k in keys] + ["chosen int", f"`{out}` long", "c long"])

    def subsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                sums, chosen = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int32)
                for x in row[-1]:
                    sums, chosen = np.concatenate([sums, sums + np.int64(x)]), np.concatenate([chosen, chosen + 1])
                if not sized:
                    chosen[:] = 0
                pairs, counts = np.unique(np.stack([chosen.astype(np.int64), sums], axis=1), axis=0, return_counts=True)
                made = pd.DataFrame({k: [row[i]] * len(counts) for i, k in enumerate(keys)}, index=range(len(counts)))
                made["chosen"], made[out], made["c"] = pairs[:, 0].astype(np.int32), pairs[:, 1], counts
                yield made[names]

    sums = groups.select(*keys, head.alias("__v")).mapInPandas(subsets, schema)
    for i in range(AT_ONCE, most):
        x = F.get(numbers, F.lit(i))
        more = groups.select(*keys, x.alias("__x"))
        both = F.array(F.struct(F.col("chosen"), F.col(out)), F.struct((F.col("chosen") + (1 if sized else 0)).alias("chosen"), (F.col(out) + F.col("__x")).alias(out)))
        grown = sums.join(more, keys) if keys else sums.select("*", more.select("__x").scalar().alias("__x"))
        grown = grown.select(*keys, "c", F.inline(F.when(F.col("__x").isNull(), F.slice(both, 1, 1)).otherwise(both)))
        sums = grown.groupBy(*keys, "chosen", out).agg(F.sum("c").alias("c"))
    return sums


def reaching(left: DataFrame, right: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """keys, hits: pairs of a left row and a right row of one key with left.at >= right.at, counted by multiplicity.

    few: a key has no more than 2^(AT_ONCE + 1) rows, so that a window may hold them.
    """
    rows = left.select(*keys, "at", F.col("c").alias("l"), F.lit(0).cast("long").alias("r")).unionByName(
        right.select(*keys, "at", F.lit(0).cast("long").alias("l"), F.col("c").alias("r")))
    # a left sum that just reaches what is needed counts, so both kinds are merged per value first
    per = rows.groupBy(*keys, "at").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    if few:
        up = F.sum("l").over(Window.partitionBy(*keys).orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0))
        return per.withColumn("up", up).groupBy(*keys).agg(F.sum(F.col("r") * F.col("up")).alias("hits"))
    per = materialise(per)
    run = with_running(per, keys, ["at"], {"below": ("sum", "l")}, inclusive=False)
    total = per.groupBy(*keys).agg(F.sum("l").alias("all"))
    return run.where("r > 0").join(total, keys).groupBy(*keys).agg(F.sum(F.col("r") * (F.col("all") - F.col("below"))).alias("hits"))


def _halves(groups: DataFrame) -> tuple[Column, Column]:
    half = F.ceil(F.size("v") / 2).cast("int")
    return F.slice("v", F.lit(1), half), F.slice("v", half + 1, F.size("v") - half)


def sign_flip(means: DataFrame, group: str, order: str, value: str, scale: int = SCALE) -> DataFrame:
    """Exact one-sided sign-flip p of each group's mean over all 2^k sign assignments: k, hits, assignments, p, floor.

    A flipped sum is at least the observed one iff the numbers that keep their sign sum to the total at least.
    """
    g = materialise(packed(means, [group], [order], scaled(F.col(value), scale)))
    first, second = _halves(g)
    half = (1 + (g.agg(F.max(F.size("v"))).first()[0] or 0)) // 2
    total = F.aggregate("v", F.lit(0).cast("long"), lambda a, b: a + b)
    left = half_sums(g, [group], first, half, False, "at")
    right = half_sums(g, [group], second, half, False, "s").join(g.select(group, total.alias("__t")), group).withColumn("at", F.col("__t") - F.col("s"))
    hits = reaching(left, right, [group], half <= AT_ONCE)
    x = g.select(group, F.size("v").cast("long").alias("k"), F.call_function("shiftleft", F.lit(1).cast("long"), F.size("v")).alias("assignments")).join(hits, group)
    return x.select(group, "k", "hits", "assignments").withColumns({"p": F.col("hits") / F.col("assignments"), "floor": 1 / F.col("assignments")})


def _choose(n: Column, k: Column) -> Column:
    """Binomial coefficient in 64 bits: each partial product is a binomial coefficient itself."""
    small = F.least(k, n - k)
    steps = F.when(small > 0, F.sequence(F.lit(1), F.greatest(small, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(1).cast("long"), lambda acc, i: F.call_function("div", acc * (n - small + i), i))


def label_permutation(means: DataFrame, arm: str, order: list[str], value: str, first: str = "A", scale: int = SCALE) -> DataFrame:
    """Exact one-sided p of the difference of arm means over all relabellings with the same arm sizes.

    With fixed sizes the difference grows with the sum over the first arm, so only that sum is compared: a left half sum of
    j numbers meets right ones of nA - j.
    """
    v = scaled(F.col(value), scale)
    g = packed(means, [], order, v)
    facts = means.agg(F.count_if(F.col(arm) == first).cast("int").alias("na"), F.sum(F.when(F.col(arm) == first, v)).alias("obs"), F.count(F.lit(1)).alias("n"))
    g = materialise(g.select("v", *[facts.select(c).scalar().alias(c) for c in ("na", "obs", "n")]))
    one, two = _halves(g)
    half = (1 + g.first()["n"]) // 2
    left = half_sums(g, [], one, half, True, "at")
    right = half_sums(g, [], two, half, True, "s").select("*", *[g.select(c).scalar().alias(c) for c in ("na", "obs")])
    right = right.select((F.col("na") - F.col("chosen")).alias("chosen"), (F.col("obs") - F.col("s")).alias("at"), "c").where("chosen >= 0")
    hits = reaching(left.select("chosen", "at", "c"), right, ["chosen"], half <= AT_ONCE).agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
    x = g.select("n", F.col("na").cast("long").alias("n_first"), _choose(F.col("n").cast("int"), F.col("na")).alias("relabellings"), hits.scalar().alias("hits"))
    return x.withColumns({"p": F.col("hits") / F.col("relabellings"), "floor": 1 / F.col("relabellings")})


def swap_counts(weights: DataFrame, n: int) -> DataFrame:
    """hits, relabellings of the sums  sum d_xy * s_x * s_y  over all sign vectors s of n places that reach the one of all plus.

    weights: sx, sy (of n places, in any numbering), d. The sum is quadratic, so halves don't separate; but for each left half of signs the
    right half's sums are one vector made by doubling. A vector and its negative have equal sums, so one sign is held fixed:
    2^(n-1) sums, of which a task holds 2^(n/2) at a time and none becomes a row. n * n weights reach the tasks.
    """
    if n > MOST // 2 + 5:
        raise ValueError(f"2^{n - 1} relabellings are too many to go through; use a Monte-Carlo test")
    rows = weights.groupBy("sx", "sy").agg(F.sum("d").alias("d")).limit(n * n + 1).collect()
    place = {s: i for i, s in enumerate(sorted({x for r in rows for x in (r["sx"], r["sy"])}))}
    if len(place) > n:
        raise ValueError(f"{len(place)} places where {n} were expected")
    w = np.zeros((n, n), dtype=np.int64)
    for r in rows:
        i, j = sorted((place[r["sx"]], place[r["sy"]]))
        w[i, j] += r["d"]
    observed = int(w.sum())
    left = max(n // 2, 1)
    inner = w[left:, left:]

    def grown(linear: np.ndarray) -> np.ndarray:
        """Sums of linear and inner terms over all right-hand signs, a place at a time."""
        sums, signs = np.zeros(1, dtype=np.int64), np.zeros((0, 1), dtype=np.int64)
        for j in range(n - left):
            pull = linear[j] + (inner[:j, j] @ signs if j else 0)
            sums = np.concatenate([sums + pull, sums - pull])
            if j + 1 < n - left:
                signs = np.concatenate([np.concatenate([signs, signs], axis=1), np.repeat([[1, -1]], signs.shape[1], axis=1).reshape(1, -1)], axis=0)
        return sums

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = grown(np.zeros(n - left, dtype=np.int64)) if n > left else np.zeros(1, dtype=np.int64)
        for batch in batches:
            hits = 0
            for mask in batch["id"]:
                s = np.array([1, *[1 - 2 * ((int(mask) >> i) & 1) for i in range(left - 1)]], dtype=np.int64)
                linear = s @ w[:left, left:]
                sums = np.zeros(1, dtype=np.int64)
                for x in linear:
                    sums = np.concatenate([sums + x, sums - x])
                hits += int(np.count_nonzero(sums + none + s @ w[:left, :left] @ s >= observed))
            yield pd.DataFrame({"hits": [hits]})

    found = weights.sparkSession.range(0, 1 << (left - 1), 1, max(1, min(1024, (1 << (left - 1)) >> 4))).mapInPandas(run, "hits long")
    return found.agg((F.sum("hits") * 2).alias("hits")).select("hits", F.lit(1 << n).cast("long").alias("relabellings"))
