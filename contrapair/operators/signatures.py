"""Signatures: arrays aggregated across items.

Only sums that cross items explode to (item, position) rows, and those are combined
map-side, so the shuffle carries groups x positions rows however many items there are.
Everything inside one item stays an array expression and needs no shuffle at all.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from contrapair.functions import vectors as V
from contrapair.functions.hashing import portable_hash
from contrapair.functions.ordered import exact_quantiles

MIN_ENERGY = 1e-6


def standardised_residual(df: DataFrame, y: str, out: str, half: int = 2) -> DataFrame:
    """High-pass each item and scale it to mean 0, population SD 1; a flat item is an error."""
    def scaled(r: Column) -> Column:
        def at(ms: Column) -> Column:
            sd = F.when(ms["v"] > 0, F.sqrt(ms["v"])).otherwise(F.raise_error(F.lit("degenerate residual")).cast("double"))
            return V.let(sd, lambda s: F.transform(r, lambda x: (x - ms["m"]) / s))

        m = V.mean(r)
        return V.let(F.struct(m.alias("m"), (V.dot(r, r) / F.size(r) - m * m).alias("v")), at)

    def residual(v: Column) -> Column:
        return V.let(F.zip_with(v, V.moving_average(v, half), lambda a, b: a - b), scaled)

    return df.withColumn(out, V.let(F.col(y), residual))


def plugged_residual(df: DataFrame, y: str, out: str, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The caller's own residual of one item, run inside Arrow batches and standardised afterwards."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(batch: pd.Series) -> pd.Series:
        def one(v: np.ndarray) -> np.ndarray:
            r = np.asarray(fn(np.asarray(v, float)), float)
            sd = r.std()
            if not np.isfinite(sd) or sd == 0:
                raise ValueError("degenerate residual")
            return (r - r.mean()) / sd

        return batch.map(one)

    return df.withColumn(out, run(y))


def positions(df: DataFrame, keep: list[str], **arrays: str) -> DataFrame:
    """Rows (keep..., pos, one column per array)."""
    zipped = F.arrays_zip(*[F.col(a).alias(o) for o, a in arrays.items()])
    x = df.select(*keep, F.posexplode(zipped).alias("pos", "__z"))
    return x.select(*keep, F.col("pos").cast("long").alias("pos"), *[F.col(f"__z.{o}").alias(o) for o in arrays])


def multiplicative(df: DataFrame, keys: list[str], y: str = "y", w: str = "w", out: str = "k", weight: str | None = None) -> DataFrame:
    """K[p] = sum(w y) / max(sum(y y), 1e-6) by keys and position; `weight` gives item multiplicities."""
    keep = keys + ([weight] if weight else [])
    x = positions(df, keep, __y=y, __w=w)
    m = F.col(weight) if weight else F.lit(1.0)
    num = F.sum(m * F.col("__w") * F.col("__y"))
    den = F.greatest(F.sum(m * F.col("__y") * F.col("__y")), F.lit(MIN_ENERGY))
    return x.groupBy(*keys, "pos").agg((num / den).alias(out))


def mean_map(df: DataFrame, keys: list[str], value: str, out: str = "k") -> DataFrame:
    return positions(df, keys, __v=value).groupBy(*keys, "pos").agg(F.avg("__v").alias(out))


def to_arrays(sig: DataFrame, keys: list[str], value: str = "k") -> DataFrame:
    """One row per signature with its values as an array in position order."""
    packed = sig.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", value))).alias("__a"))
    return packed.select(*keys, F.col(f"__a.{value}").alias(value))


def whole_blocks(a: Column, size: int) -> Column:
    """The array, or an error where its length is no multiple of ``size``: a tail is never dropped silently."""
    bad = F.raise_error(F.format_string(f"%d elements are no whole blocks of {size}", F.size(a))).cast("array<double>")
    return F.when(F.size(a) % size == 0, V.doubles(a)).otherwise(bad)


def zero_mean_grid(sig: DataFrame, keys: list[str], width: int, value: str = "k") -> DataFrame:
    """Subtract row means, then column means of the result; a signature is one array of rows of `width`."""
    def centre(a: Column) -> Column:
        n_rows = (F.size(a) / width).cast("int")
        rows = F.transform(F.sequence(F.lit(0), n_rows - 1), lambda i: V.centred(F.slice(a, i * width + 1, F.lit(width))))
        return V.let(rows, without_column_means)

    def without_column_means(rows: Column) -> Column:
        cols = F.transform(
            F.sequence(F.lit(1), F.lit(width)),
            lambda j: V.mean(F.transform(rows, lambda row: F.element_at(row, j))),
        )
        return V.let(cols, lambda c: F.flatten(F.transform(rows, lambda row: F.zip_with(row, c, lambda x, y: x - y))))

    return sig.withColumn(value, V.let(whole_blocks(F.col(value), width), centre))


def without_shared_part(sig: DataFrame, device: str, value: str = "k") -> DataFrame:
    """Remove from each device's signature its projection on the mean of the other devices.

    Long form (device, pos, value); the sum over devices is taken once per position.
    """
    totals = sig.groupBy("pos").agg(F.sum(value).alias("__t"), F.count(F.lit(1)).alias("__d"))
    x = sig.join(totals, "pos").withColumn("__o", (F.col("__t") - F.col(value)) / (F.col("__d") - 1))
    stats = x.groupBy(device).agg(
        F.avg(value).alias("__mk"), F.avg("__o").alias("__mo"),
        F.sum(F.col(value) * F.col("__o")).alias("__ko"), F.sum(F.col("__o") * F.col("__o")).alias("__oo"),
        F.count(F.lit(1)).alias("__n"),
    )
    cov = F.col("__ko") - F.col("__n") * F.col("__mk") * F.col("__mo")
    var = F.col("__oo") - F.col("__n") * F.col("__mo") * F.col("__mo")
    stats = stats.withColumn("__b", F.coalesce(V.safe_div(cov, var), F.lit(0.0)))
    y = x.join(stats, device)
    return y.select(device, "pos", (F.col(value) - F.col("__mk") - F.col("__b") * (F.col("__o") - F.col("__mo"))).alias(value))


def defect_split(sig: DataFrame, keys: list[str], value: str = "k", factor: float = 5.0) -> DataFrame:
    """Mark positions far from their local median: (keys, pos, value, defect)."""
    x = sig.withColumn("__r", F.zip_with(value, V.windows(F.col(value), 2, V.median), lambda a, b: F.abs(a - b)))
    rows = positions(x, keys, **{value: value, "__d": "__r"})
    med = exact_quantiles(rows, keys, "__d", {"__mad": 0.5})
    y = rows.join(med, keys)
    return y.select(*keys, "pos", value, (F.col("__d") > F.lit(factor) * F.col("__mad") / 0.6745).alias("defect"))


def band_matrix(size: int, low: int, high: int) -> list[list[float]]:
    """Keep frequencies low..high of the orthonormal cosine transform, as one linear map."""
    k = np.arange(size)[:, None]
    x = np.arange(size)[None, :]
    basis = np.sqrt(np.where(k == 0, 1.0, 2.0) / size) * np.cos(math.pi * (2 * x + 1) * k / (2 * size))
    part = basis[low : high + 1]
    return (part.T @ part).tolist()


def band_map(a: Column, size: int, low: int, high: int) -> Column:
    """Band-pass every block of `size` elements; an array that isn't made of whole blocks is an error."""
    rows = F.lit(band_matrix(size, low, high))

    def whole(v: Column) -> Column:
        def one(b: Column) -> Column:
            return V.let(F.slice(v, b * size + 1, F.lit(size)), lambda block: F.transform(rows, lambda coef: V.dot(coef, block)))

        return F.flatten(F.transform(F.sequence(F.lit(0), (F.size(v) / size).cast("int") - 1), one))

    return V.let(whole_blocks(a, size), whole)


def fold(a: Column, g: int) -> Column:
    """Mean per residue class mod g."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(g - 1)), lambda r: V.mean(F.filter(a, lambda x, i: i % g == r))
    )


def periodic_part(df: DataFrame, value: str, g: int, out: str) -> DataFrame:
    """The fold, tiled back to full length."""
    places = F.sequence(F.lit(0), F.size(value) - 1)
    tiled = V.let(fold(F.col(value), g), lambda f: F.transform(places, lambda p: F.element_at(f, p % g + 1)))
    return df.withColumn(out, tiled)


def quality(sig: DataFrame, device: str, first: str, second: str) -> DataFrame:
    """Per device: split-half correlation, mean correlation with the other devices, variance shares.

    The mean over the other devices is z_d . (sum z - z_d) / (D - 1) with z standardised, so
    no pair of devices is formed.
    """
    z = sig.withColumns({c: V.centred(F.col(c)) for c in (first, second)})
    z = z.withColumns({c: V.unit(F.col(c)) for c in (first, second)})
    sums = positions(z, [device], s=second).groupBy("pos").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("d"))
    tot = to_arrays(sums.select(F.lit(1).alias("one"), "pos", "s"), ["one"], "s")
    d = sums.agg(F.max("d"))
    z = z.select("*", tot.select("s").scalar().alias("__s"), d.scalar().alias("__d"))
    half = V.dot(F.col(first), F.col(second))
    others = (V.dot(F.col(second), F.col("__s")) - 1) / (F.col("__d") - 1)
    z = z.select(device, half.alias("split_half"), others.alias("pairwise"))
    return z.select(
        device, "split_half", "pairwise",
        F.greatest(F.col("split_half") - F.col("pairwise"), F.lit(0.0)).alias("device_share"),
        F.greatest(1 - F.col("split_half"), F.lit(0.0)).alias("noise_share"),
    )


def shuffle_blocks(a: Column, item: Column, size: int, salt: int) -> Column:
    """Reorder the blocks of one item by portable hash; a shorter last block is one of them."""
    n = F.ceil(F.size(a) / size).cast("int")
    ids = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.struct(portable_hash(b, item, salt).alias("h"), b.alias("b")))
    return F.flatten(F.transform(F.array_sort(ids), lambda s: F.slice(a, s["b"] * size + 1, F.lit(size))))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), parts)
