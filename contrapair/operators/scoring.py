"""Item against template.

Arrays of both sides are cut into tiles of positions and joined on the tile; each pair of an item and a template gets a few
partial sums from each tile, which add up to its correlations. Items are read once, no array has to fit anywhere whole, and
neither side passes through the driver. Templates whose measured size is small are broadcast, tile by tile; larger sets are
dealt into lots and items into parts, and each (tile, lot, part) is one block of the product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from contrapair.functions import vectors as V
from contrapair.functions.hashing import hash_sign

#: Positions of a tile, and the bytes of templates that may be broadcast or, above, that a lot holds.
TILE = 4096
LOT_BYTES = 8 << 20


def scalar_columns(df: DataFrame) -> list[str]:
    """The columns that aren't arrays; together they name a row."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, ArrayType)]


def tiled(df: DataFrame, arrays: list[str], size: int) -> DataFrame:
    """A row for each tile: the scalar columns, __tile, and that piece of each array."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(arrays[0]) - 1, F.lit(0)), F.lit(size))
    x = df.select("*", F.posexplode(starts).alias("__tile", "__at"))
    return x.select(*scalar_columns(df), "__tile", *[F.slice(a, F.col("__at") + 1, F.lit(size)).alias(a) for a in arrays])


def _meet(items: DataFrame, templates: DataFrame, on: list[str], names: list[str], size: int) -> DataFrame:
    """Join rows of equal ``on``: templates are broadcast if ``size`` bytes are few, else both sides are dealt into blocks."""
    if size <= LOT_BYTES:
        return items.join(F.broadcast(templates), on)
    lots, parts = -(-size // LOT_BYTES), int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = templates.select("*", F.pmod(F.xxhash64(*names), F.lit(lots)).alias("__lot"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("__part"))
    x = items.select("*", F.pmod(F.xxhash64(*[c for c in scalar_columns(items) if c not in on]), F.lit(parts)).alias("__part"),
                     F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))).alias("__lot"))
    return x.join(t, [*on, "__lot", "__part"]).drop("__lot", "__part")


def _measure(templates: DataFrame, vector: str) -> tuple[int, int]:
    """Rows and longest array of the templates."""
    size = templates.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("w")).first()
    return size["n"], size["w"] or 0


def beside(items: DataFrame, templates: DataFrame, vector: str) -> DataFrame:
    """Every item row next to every template row, arrays whole: for what can't be summed over tiles."""
    n, width = _measure(templates, vector)
    one = F.lit(0).alias("__one")
    arrays = len(templates.columns) - len(scalar_columns(templates))
    return _meet(items.select("*", one), templates.select("*", one), ["__one"], scalar_columns(templates), n * width * 8 * arrays).drop("__one")


def item_sums(items: DataFrame, w: str = "w") -> DataFrame:
    """The item side of every correlation, computed once however many templates follow."""
    return items.withColumns({"__sw": V.total(F.col(w)), "__sww": V.dot(F.col(w), F.col(w))})


def ncc(w: Column, z: Column, sw: Column | None = None, sww: Column | None = None) -> Column:
    """Centred correlation of w and z; pass the sums of w when they are already columns."""
    sw = V.total(w) if sw is None else sw
    sww = V.dot(w, w) if sww is None else sww
    return V.correlation_from_sums(F.size(w), sw, V.total(z), sww, V.dot(z, z), V.dot(w, z))


def pair_sums(items: DataFrame, templates: DataFrame, patterns: dict[str, tuple[str, bool]], w: str = "w", y: str = "y") -> DataFrame:
    """One row per item and template: __n, __sw, __sww and, for each pattern, the sums __s_, __ss_ and __sw_ of z, z z and w z.

    patterns: {name: (array column of the templates, times y or not)}. Scalar columns of both sides name the rows and must be
    unique; an item's arrays have one length, and a template's. Arrays of one tile give final sums without a shuffle.
    """
    columns = list(dict.fromkeys(c for c, _ in patterns.values()))
    n, width = _measure(templates, columns[0])
    keys, names = scalar_columns(items), scalar_columns(templates)
    left, right = tiled(items.select(*keys, w, y), [w, y], TILE), tiled(templates.select(*names, *columns), columns, TILE)
    left = left.withColumns({"__sw": V.total(F.col(w)), "__sww": V.dot(F.col(w), F.col(w))})
    x = _meet(left, right, ["__tile"], names, n * width * 8 * len(columns))
    x = x.withColumns({f"__z_{p}": V.times(F.col(y), F.col(c)) if times else F.col(c) for p, (c, times) in patterns.items()})
    sums = {"__n": F.size(w).cast("long")}
    for p in patterns:
        z = F.col(f"__z_{p}")
        sums |= {f"__s_{p}": V.total(z), f"__ss_{p}": V.dot(z, z), f"__sw_{p}": V.dot(F.col(w), z)}
    x = x.select(*keys, *names, "__sw", "__sww", *[v.alias(k) for k, v in sums.items()])
    if width <= TILE:
        return x
    return x.groupBy(*keys, *names).agg(*[F.sum(c).alias(c) for c in ("__sw", "__sww", *sums)])


def correlations(sums: DataFrame, **named: str) -> DataFrame:
    """The sums' columns replaced by correlations: {output: pattern}."""
    out = {o: V.correlation_from_sums(F.col("__n"), F.col("__sw"), F.col(f"__s_{p}"), F.col("__sww"), F.col(f"__ss_{p}"), F.col(f"__sw_{p}")) for o, p in named.items()}
    spent = {"__n", "__sw", "__sww", *[f"__{s}_{p}" for p in named.values() for s in ("s", "ss", "sw")]}
    return sums.select(*[c for c in sums.columns if c not in spent], *[v.alias(o) for o, v in out.items()])


def score(items: DataFrame, templates: DataFrame, y: str = "y", w: str = "w", k: str = "tk") -> DataFrame:
    """rho_mult = NCC(W, Y K) and rho_add = NCC(W, K) for every item and template, beside the scalar columns of both."""
    return correlations(pair_sums(items, templates, {"mult": (k, True), "add": (k, False)}, w, y), rho_mult="mult", rho_add="add")


def own_score(items: DataFrame, templates: DataFrame, device: str = "device", y: str = "y", w: str = "w") -> DataFrame:
    """NCC against the item's own device template only."""
    x = items.join(templates, device)
    return x.withColumn("rho", ncc(F.col(w), V.times(F.col(y), F.col("k"))))


def decoy_rank(items: DataFrame, templates: DataFrame, shifts: list[int], device: str = "device") -> DataFrame:
    """Place of the true template's mean score among its circular shifts; 1 is best."""
    x = items.join(templates, device)
    x = item_sums(x).select(device, "y", "w", "k", "__sw", "__sww", F.explode(F.lit(shifts)).alias("d"))
    z = V.times(F.col("y"), V.roll(F.col("k"), F.col("d")))
    x = x.select(device, "d", ncc(F.col("w"), z, F.col("__sw"), F.col("__sww")).alias("rho"))
    m = x.groupBy(device, "d").agg(F.avg("rho").alias("m"), F.count(F.lit(1)).alias("n"))
    true = m.where("d = 0").select(device, F.col("m").alias("rho"), "n")
    y = m.where("d <> 0").select(device, "m").join(true, device)
    return y.groupBy(device).agg(
        F.max("rho").alias("rho"), F.max("n").alias("n"),
        (F.count_if(F.col("m") > F.col("rho")) + 1).alias("rank"), F.max("m").alias("best_decoy"),
    )


def field_rank(items: DataFrame, templates: DataFrame, fields: int, salt: int, device: str = "device") -> DataFrame:
    """Place of the true template's mean score among independent random fields; 1 is best: device, rho, n, rank, best_decoy.

    Field j at position p is a sign by hash of (p, j), made where it is needed: no table of fields, nothing to ship.
    """
    x = item_sums(items.join(templates, device))
    x = x.select(device, "y", "w", "k", "__sw", "__sww", F.explode(F.sequence(F.lit(0), F.lit(fields))).alias("j"))
    field = F.transform("y", lambda v, p: v * hash_sign(p, F.col("j"), salt))
    z = F.when(F.col("j") == 0, V.times(F.col("y"), F.col("k"))).otherwise(field)
    x = x.withColumn("z", z).select(device, "j", ncc(F.col("w"), F.col("z"), F.col("__sw"), F.col("__sww")).alias("rho"))
    m = x.groupBy(device, "j").agg(F.avg("rho").alias("m"), F.count(F.lit(1)).alias("n"))
    true = m.where("j = 0").select(device, F.col("m").alias("rho"), "n")
    return m.where("j > 0").select(device, "m").join(true, device).groupBy(device).agg(
        F.max("rho").alias("rho"), F.max("n").alias("n"), (F.count_if(F.col("m") > F.col("rho")) + 1).alias("rank"), F.max("m").alias("best_decoy"))


def shift_grid(items: DataFrame, templates: DataFrame, shifts: list[int], grid: int, device: str = "device") -> DataFrame:
    """Scores at chosen displacements: excess of grid-aligned over other shifts, with its Welch SE."""
    x = item_sums(items.join(templates, device))
    x = x.select(device, "y", "w", "k", "__sw", "__sww", F.explode(F.lit(shifts)).alias("d"))
    z = V.times(F.col("y"), V.roll(F.col("k"), F.col("d")))
    x = x.select(device, "d", ncc(F.col("w"), z, F.col("__sw"), F.col("__sww")).alias("rho"))
    m = x.groupBy(device, "d").agg(F.avg("rho").alias("m"))
    on = F.col("d") % grid == 0

    def side(cond: Column, tag: str) -> list[Column]:
        v = F.when(cond, F.col("m"))
        return [F.avg(v).alias(f"m_{tag}"), F.var_samp(v).alias(f"v_{tag}"), F.count(v).alias(f"n_{tag}")]

    s = m.groupBy(device).agg(*side(on, "on"), *side(~on, "off"))
    se = F.sqrt(F.col("v_on") / F.col("n_on") + F.col("v_off") / F.col("n_off"))
    return s.withColumns({"excess": F.col("m_on") - F.col("m_off"), "se": se})


def lag_surface(w: np.ndarray, z: np.ndarray) -> np.ndarray:
    """c(s) = sum_p w[p + s] z[p] over all circular displacements s of centred, scaled fields (rows, height, width)."""
    def unit(a: np.ndarray) -> np.ndarray:
        a = a - a.mean(axis=(1, 2), keepdims=True)
        return a / np.maximum(np.sqrt((a * a).sum(axis=(1, 2), keepdims=True)), 1e-12)

    return np.fft.irfft2(np.fft.rfft2(unit(w)) * np.conj(np.fft.rfft2(unit(z))), s=w.shape[1:])


def far_lags(height: int, width: int, exclude: int) -> np.ndarray:
    """Which displacements lie outside the square of ``exclude`` x ``exclude`` around zero, distances taken around the torus."""
    r, c = np.minimum(np.arange(height), height - np.arange(height)), np.minimum(np.arange(width), width - np.arange(width))
    return (r[:, None] > exclude // 2) | (c[None, :] > exclude // 2)


def peak_energy(scored: DataFrame, y: str = "y", w: str = "w", k: str = "tk", exclude: int = 11, width: int | None = None) -> DataFrame:
    """Peak-to-correlation energy at zero lag and at the largest lag, with that lag: pce0, pce_max, shift, shift_row, shift_col.

    Fields are rows of ``width`` positions (one row without it), and the whole surface of lags comes from one fast transform of
    a batch. Energy is the mean square outside an exclusion zone around zero. Of equal peaks (to 12 digits) the first counts.
    """
    if width is not None and width < 1:
        raise ValueError("width must be positive")

    @F.pandas_udf("pce0 double, pce_max double, shift long, shift_row long, shift_col long")
    def peaks(ws: pd.Series, zs: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(ws), 5))
        sizes = ws.map(len).to_numpy()
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            across = width or int(size)
            if size % across or any(len(z) != size for z in zs.iloc[at]):
                raise ValueError(f"{size} positions are no whole rows of {across}, or item and template differ in length")
            shape = (-1, int(size) // across, across)
            far = far_lags(*shape[1:], exclude)
            if not far.any():
                raise ValueError("the exclusion zone covers all lags")
            for some in np.array_split(at, max(1, len(at) * int(size) // (1 << 20))):
                c = lag_surface(np.stack(ws.iloc[some]).reshape(shape), np.stack(zs.iloc[some]).reshape(shape))
                energy = np.maximum((c[:, far] ** 2).mean(axis=1), 1e-24)
                flat = c.reshape(len(some), -1)
                top = np.abs(flat).round(12).argmax(axis=1)
                peak, zero = flat[np.arange(len(some)), top], flat[:, 0]
                out[some] = np.stack([np.sign(zero) * zero**2 / energy, np.sign(peak) * peak**2 / energy, top, top // across, top % across], axis=1)
        done = pd.DataFrame(out, columns=["pce0", "pce_max", "shift", "shift_row", "shift_col"])
        return done.astype({c: "int64" for c in ("shift", "shift_row", "shift_col")})

    x = scored.withColumn("__p", peaks(V.doubles(F.col(w)), V.times(F.col(y), F.col(k))))
    return x.select(*scored.columns, "__p.*")


def shift_residues(peaks: DataFrame, keys: list[str], shift: str = "shift") -> DataFrame:
    """Share of peak lags that are multiples of 8 and 16, beside their chance shares."""
    def share(g: int) -> Column:
        return F.avg((F.col(shift) % g == 0).cast("double"))

    return peaks.groupBy(*keys).agg(
        share(8).alias("mod8"), share(16).alias("mod16"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(shift) == 0).alias("at_zero"),
    ).withColumns({"chance8": F.lit(1 / 8), "chance16": F.lit(1 / 16)})


def at_levels(items: DataFrame, levels: list[float], name: str = "alpha") -> DataFrame:
    return items.select("*", F.explode(F.lit(levels)).alias(name))


def marked(y: Column, k: Column, alpha: Column) -> Column:
    """Y (1 + a K)."""
    return F.zip_with(y, k, lambda v, p: v * (1 + alpha * p))


def added(y: Column, f: Column, alpha: Column) -> Column:
    """Y + a F."""
    return F.zip_with(y, f, lambda v, p: v + alpha * p)


def swapped(y: Column, k_from: Column, k_to: Column, alpha: float = 1.0) -> Column:
    """Y (1 - a K_from) (1 + a K_to), clipped to the pixel range."""
    clean = F.zip_with(y, k_from, lambda v, p: v * (1 - alpha * p))
    return F.transform(F.zip_with(clean, k_to, lambda v, p: v * (1 + alpha * p)), lambda v: F.greatest(F.least(v, F.lit(255.0)), F.lit(0.0)))


def suppressed(y: Column, k: Column, alpha: float = 1.0) -> Column:
    return F.transform(F.zip_with(y, k, lambda v, p: v * (1 - alpha * p)), lambda v: F.greatest(F.least(v, F.lit(255.0)), F.lit(0.0)))


def stored(y: Column) -> Column:
    """What an 8-bit file keeps."""
    return F.transform(y, lambda v: F.greatest(F.least(F.rint(v), F.lit(255.0)), F.lit(0.0)))


def change_report(df: DataFrame, before: str, after: str, keys: list[str]) -> DataFrame:
    """RMS change, clipped share and PSNR of stored items by level."""
    d = F.zip_with(before, after, lambda a, b: b - a)
    x = df.withColumn("__d", d)
    per = x.select(
        *keys, V.dot(F.col("__d"), F.col("__d")).alias("ss"), F.size(after).alias("px"),
        F.size(F.filter(after, lambda v: (v <= 0) | (v >= 255))).alias("cl"),
    )
    agg = per.groupBy(*keys).agg(
        F.avg(F.sqrt(F.col("ss") / F.col("px"))).alias("rms_change"),
        (F.sum("cl") / F.sum("px")).alias("clip_frac"), (F.sum("ss") / F.sum("px")).alias("mse"),
        F.count(F.lit(1)).alias("n"),
    )
    return agg.withColumn("psnr", F.when(F.col("mse") > 0, 10 * F.log10(F.lit(255.0 * 255.0) / F.nullif("mse", F.lit(0.0))))).drop("mse")


def transplanted(y: Column, bank: Column, place: Column, scale: Column) -> Column:
    """Y plus a scaled residual taken from a packed bank at `place` (0-based)."""
    return F.zip_with(y, F.element_at(bank, place.cast("int") + 1), lambda v, f: v + scale * f)


def remove_two(w: Column, p: Column, q: Column) -> Column:
    """w minus its least-squares fit on p and q; a singular pair leaves w unchanged."""
    pp, qq, pq = V.dot(p, p), V.dot(q, q), V.dot(p, q)
    wp, wq = V.dot(w, p), V.dot(w, q)
    det = F.nullif(pp * qq - pq * pq, F.lit(0.0))
    coef = F.struct(
        F.coalesce((wp * qq - wq * pq) / det, F.lit(0.0)).alias("a"), F.coalesce((wq * pp - wp * pq) / det, F.lit(0.0)).alias("b"))
    return V.let(coef, lambda c: F.zip_with(w, F.zip_with(p, q, lambda x, z: c["a"] * x + c["b"] * z), lambda v, f: v - f))
