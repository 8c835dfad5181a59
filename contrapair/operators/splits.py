"""Split construction and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrapair.functions.hashing import portable_hash
from contrapair.functions.ordered import with_rank, with_running
from contrapair.session import materialise


def _with_position(df: DataFrame, device: str, order: list[str]) -> DataFrame:
    return with_rank(df, [device], order, "rn", "n")


def _labelled(splits: list[tuple[str, Column, Column]]) -> Column:
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(splits):
        out = F.when((F.col("rn") > lo) & (F.col("rn") <= hi), name).otherwise(out)
    return F.coalesce(out, F.lit("guard"))


def percent_splits(df: DataFrame, device: str, order: list[str], bounds: list[tuple[str, int, int]]) -> DataFrame:
    """Contiguous runs of each device's ordered items, bounded in percent; what lies between is guard."""
    out = F.lit("guard")
    hundredths = F.col("rn") * 100
    for name, lo, hi in reversed(bounds):
        out = F.when((hundredths > F.lit(lo) * F.col("n")) & (hundredths <= F.lit(hi) * F.col("n")), name).otherwise(out)
    return _with_position(df, device, order).withColumn("split", out)


def sized_splits(df: DataFrame, device: str, order: list[str], sizes: list[tuple[str, int]], guard: int) -> DataFrame:
    """Contiguous runs of fixed sizes with `guard` items dropped between them."""
    at, bounds = 0, []
    for name, size in sizes:
        bounds.append((name, F.lit(at), F.lit(at + size)))
        at += size + guard
    return _with_position(df, device, order).withColumn("split", _labelled(bounds))


def split_collisions(df: DataFrame, path: str, split: str = "split", ignore: str = "guard") -> DataFrame:
    """Items seen in more than one split; an empty result passes the gate."""
    seen = df.where(F.col(split) != ignore).groupBy(path)
    return seen.agg(F.count_distinct(F.col(split)).alias("n_splits"), F.count(F.lit(1)).alias("n_rows")).where("n_splits > 1")


def choose_pair(df: DataFrame, model: str, device: str, need: int, keep: int = 2) -> DataFrame:
    """Per model the `keep` devices with most items, among those with at least `need`; models need two."""
    counts = df.groupBy(model, device).agg(F.count(F.lit(1)).alias("n_items")).where(F.col("n_items") >= need)
    order = Window.partitionBy(model).orderBy(F.desc("n_items"), device)
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    full = ranked.where(F.col("rank") == 2).select(model)
    return ranked.join(full, model, "left_semi")


def stratum_capacity(df: DataFrame, stratum: str, device: str) -> DataFrame:
    """Smallest count any device has in each stratum; 0 where a device has none."""
    counts = df.groupBy(stratum, device).agg(F.count(F.lit(1)).alias("c"))
    n_devices = df.agg(F.count_distinct(F.col(device)).alias("d"))
    per = counts.groupBy(stratum).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("k"))
    return per.select(stratum, F.when(F.col("k") == n_devices.scalar(), F.col("c")).otherwise(F.lit(0)).alias("cap"))


def largest_remainder(cap: DataFrame, stratum: str, targets: dict[str, int]) -> DataFrame:
    """Share each stratum's capacity over the targets; leftovers go to the largest remainders."""
    total = sum(targets.values())
    shares = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(s).alias("split"), F.lit(t).cast("long").alias("t"))
                       for i, (s, t) in enumerate(targets.items())])
    x = cap.select(stratum, "cap", F.inline(shares))
    x = x.withColumn("base", F.floor(F.col("cap") * F.col("t") / total)).withColumn("rem", (F.col("cap") * F.col("t")) % total)
    w = Window.partitionBy(stratum)
    left = F.col("cap") - F.sum("base").over(w)
    place = F.row_number().over(w.orderBy(F.desc("rem"), "ord"))
    return x.select(stratum, "split", "cap", (F.col("base") + F.when(place <= left, 1).otherwise(0)).alias("alloc"))


def hold_out_smallest(cap: DataFrame, stratum: str, target: int) -> DataFrame:
    """Smallest strata first, until their capacity reaches the target. One row per stratum."""
    before = with_running(cap, [], ["cap", stratum], {"before": ("sum", "cap")}, inclusive=False)
    return before.withColumn("held_out", F.col("before") < target)


def smallest_gaps(df: DataFrame, device: str, split: str, ts: str, uid: str, splits: list[str]) -> DataFrame:
    """Smallest time gap between items of two different splits of one device.

    Ordered by time, the nearest earlier item of another split is the running maximum of
    its times, so no pair of items is ever formed.
    """
    marked = df.select(device, split, ts, uid, *[F.when(F.col(split) == s, F.col(ts)).alias(f"__t{i}") for i, s in enumerate(splits)])
    run = with_running(marked, [device], [ts, uid], {f"__p{i}": ("max", f"__t{i}") for i in range(len(splits))})
    prev = F.array(*[F.struct(F.lit(s).alias("other"), F.col(f"__p{i}").alias("__prev")) for i, s in enumerate(splits)])
    x = run.select(device, split, ts, F.inline(prev)).where((F.col("other") != F.col(split)) & F.col("__prev").isNotNull())
    a, b = F.least(split, "other"), F.greatest(split, "other")
    return x.groupBy(device, a.alias("split_a"), b.alias("split_b")).agg(F.min(F.col(ts) - F.col("__prev")).alias("gap"))


def first_n(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("rn", rn).where(F.col("rn") <= n)


def evenly_spaced(df: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """The rows at positions floor(i (n-1) / (k-1)), i = 0..k-1, of each group."""
    x = _with_position(df, group, order)
    zero = F.col("rn") - 1
    # position z is picked when some i has floor(i (n-1)/(k-1)) = z
    i = F.ceil(zero * (k - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    hit = F.floor(i * (F.col("n") - 1) / (k - 1)) == zero
    return x.where(hit & (i <= k - 1))


def hashed_sample(df: DataFrame, group: str, uid: str, n: int, salt: int) -> DataFrame:
    """n rows per group without replacement, in portable-hash order."""
    h = portable_hash(F.col(uid), F.lit(0), salt)
    return first_n(df.withColumn("h", h), group, ["h", uid], n)


def estimate_variants(df: DataFrame, pos: str = "rn", half: Column | None = None) -> DataFrame:
    """Each row once per estimate it belongs to: pooled, its interleaved half, its contiguous half."""
    first = (F.col(pos) * 2 <= F.col("n")) if half is None else half
    names = F.array(
        F.lit("pooled"),
        F.when(F.col(pos) % 2 == 0, "even").otherwise("odd"),
        F.when(first, "first_half").otherwise("second_half"),
    )
    return df.select("*", F.explode(names).alias("estimate"))


def device_ring(devices: DataFrame, device: str = "device") -> DataFrame:
    """Each distinct device with the next in alphabetical order, the last followed by the first: device, next_device, ring_place.

    Codes may be any strings; null ones are left out. A device alone is its own neighbour.
    """
    names = materialise(devices.select(F.col(device).alias("device")).where("device IS NOT NULL").distinct())
    # ranks need a leading number: the first six bytes, which order as the strings do
    lead = F.conv(F.rpad(F.hex(F.substring(F.col("device").cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    ranked = materialise(with_rank(names.withColumn("__lead", lead), [], ["__lead", "device"], "ring_place").drop("__lead"))
    n = F.lit(ranked.count())
    following = ranked.select(F.col("device").alias("next_device"), F.col("ring_place").alias("__p"))
    out = ranked.join(following, F.col("__p") == F.col("ring_place") % n + 1)
    return out.select("device", "next_device", (F.col("ring_place") - 1).alias("ring_place"))


def of_next_device(facts: DataFrame, ring: DataFrame) -> DataFrame:
    """The facts of each device's next one, under the name of the device before it."""
    pairs = ring.select(F.col("device").alias("__before"), F.col("next_device").alias("device"))
    return facts.join(pairs, "device").drop("device").withColumnRenamed("__before", "device")
