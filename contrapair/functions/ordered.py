"""Ranks, running sums and exact quantiles that never sort one group in one task.

A window partitioned only by a hot key would put a third of all rows in one task.
Here the order column is cut at sampled quantiles (at most MAX_CUTS numbers reach the
driver); rows are counted per (key, cell); the running totals of those few counts give
each cell its offset; and the exact window runs inside (key, cell). The cut points steer
only the balance of the work, never the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrapair.session import materialise, spread

MAX_CUTS = 4096


def _cuts(df: DataFrame, order: str, at_least: int = 8) -> list:
    n = min(MAX_CUTS, max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    probs = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(F.col(order).cast("double"), probs, 10 * n).alias("c")).first()
    return sorted(set(row["c"] or []))


def _cell(order: str, cuts: list) -> Column:
    """Index of the cell holding a value, by a two-level search over the cut points."""
    v = F.col(order).cast("double")
    if not cuts:
        return F.lit(0)
    m = max(1, math.isqrt(len(cuts)))
    arr = F.lit(cuts)
    coarse = F.lit(cuts[m - 1 :: m])
    c = F.size(F.filter(coarse, lambda x: x <= v))
    fine = F.size(F.filter(F.slice(arr, c * m + 1, F.lit(m)), lambda x: x <= v))
    return F.coalesce(c * m + fine, F.lit(-1))


def with_rank(df: DataFrame, keys: list[str], order: list[str], out: str = "rn", total: str | None = None, cuts: list | None = None) -> DataFrame:
    """row_number over (partition by keys order by order), and the key's row count as `total`.

    ``cuts`` spares the pass that looks for cut points, where the order column's spread is known.

    The first order column is numeric. Joining the offsets and ranking inside a cell use the
    same partitioning, so rows are shuffled once.
    """
    celled = df.withColumn("__cell", _cell(order[0], _cuts(df, order[0]) if cuts is None else cuts))
    per = celled.groupBy(*keys, "__cell").agg(F.count(F.lit(1)).alias("__m"))
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    off = per.select(*keys, "__cell", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__off"),
                     *([F.sum("__m").over(Window.partitionBy(*keys)).alias(total)] if total else []))
    w = Window.partitionBy(*keys, "__cell").orderBy(*order)
    joined = celled.join(off, keys + ["__cell"])
    return joined.withColumn(out, F.row_number().over(w) + F.col("__off")).drop("__cell", "__off")


_FOLD = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def with_running(df: DataFrame, keys: list[str], order: list[str], specs: dict[str, tuple[str, str]], inclusive: bool = True) -> DataFrame:
    """Running sum, max or min of several columns: {output: (fold, column)}; order is unique within keys."""
    celled = df.withColumn("__cell", _cell(order[0], _cuts(df, order[0])))
    wk = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    per = celled.groupBy(*keys, "__cell").agg(*[_FOLD[f][0](c).alias(f"__s_{o}") for o, (f, c) in specs.items()])
    off = per.select(*keys, "__cell", *[_FOLD[f][0](f"__s_{o}").over(wk).alias(f"__o_{o}") for o, (f, _) in specs.items()])
    w = Window.partitionBy(*keys, "__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = celled.join(off, keys + ["__cell"])
    out = out.withColumns({o: _FOLD[f][1](_FOLD[f][0](c).over(w), F.col(f"__o_{o}")) for o, (f, c) in specs.items()})
    return out.drop("__cell", *[f"__o_{o}" for o in specs])


def value_counts_below(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values with their count `c` and the number of smaller rows `below`."""
    # dealt out by whole rows, so that rare and frequent values alike are counted in tables of a bounded size first
    x = spread(df.where(F.col(value).isNotNull()), df.count(), *df.columns)
    vc = materialise(x.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c")))
    return with_running(vc, keys, [value], {"below": ("sum", "c")}, inclusive=False)


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Each row with its rank, ties sharing the mean rank."""
    below = value_counts_below(df, keys, value)
    # written, so that the ranks of few values go beside the rows and their many copies are not sorted in one task
    ranks = materialise(below.select(*keys, value, (F.col("below") + (F.col("c") + 1) / 2).alias(out)))
    return df.join(ranks, keys + [value])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles, one row per key.

    Two passes: rows are counted per cell, which tells the cell each wanted rank falls in;
    then only the rows of those cells are ordered. The full column is never sorted or shuffled.
    """
    x = df.select(*keys, value).where(F.col(value).isNotNull())
    celled = x.withColumn("__cell", _cell(value, _cuts(x, value, 64)))
    per = celled.groupBy(*keys, "__cell").agg(F.count(F.lit(1)).alias("__m"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "__cell", "__m", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__off"), F.sum("__m").over(whole).alias("__n"))
    wanted = [F.floor((F.col("__n") - 1) * F.lit(q)) for q in probs.values()] + [F.ceil((F.col("__n") - 1) * F.lit(q)) for q in probs.values()]
    inside = F.exists(F.array(*wanted), lambda i: (i >= F.col("__off")) & (i < F.col("__off") + F.col("__m")))
    cells = materialise(per.where(inside).drop("__m"))
    hit = celled.join(cells, keys + ["__cell"]).groupBy(*keys, "__cell", value).agg(
        F.count(F.lit(1)).alias("c"), F.max("__off").alias("__off"), F.max("__n").alias("__n"))
    w = Window.partitionBy(*keys, "__cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    at = hit.withColumn("below", F.col("__off") + F.coalesce(F.sum("c").over(w), F.lit(0)))
    aggs = []
    for name, q in probs.items():
        pos = (F.col("__n") - 1) * F.lit(q)
        for tag, i in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            here = (F.col("below") <= i) & (i < F.col("below") + F.col("c"))
            aggs.append(F.max(F.when(here, F.col(value))).alias(f"__{tag}_{name}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"__f_{name}"))
    got = at.groupBy(*keys).agg(*aggs)
    return got.select(
        *keys,
        *[
            (F.col(f"__lo_{k}") + (F.col(f"__hi_{k}") - F.col(f"__lo_{k}")) * F.col(f"__f_{k}")).alias(k)
            for k in probs
        ],
    )
