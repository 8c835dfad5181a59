"""Scene groups: a k-means of each device on its own, all devices at once, with labels matched between devices.

Sums of positions are kept in whole numbers (units of 2 ** -20), so results do not depend on partitions, order or retries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrapair.functions import vectors as V
from contrapair.functions.hashing import portable_hash
from contrapair.session import materialise

UNIT = float(1 << 20)


def nearest_centre(vec: Column, centres: Column) -> Column:
    """Scene of the nearest of an array of (scene, k); of equally near ones the smallest."""
    far = F.transform(centres, lambda c: F.struct(V.total(F.zip_with(vec, c["k"], lambda x, m: (x - m) * (x - m))).alias("far"), c["scene"].alias("scene")))
    return F.array_min(far)["scene"]


def device_centres(rows: DataFrame, k: int, rounds: int, salt: int = 61) -> DataFrame:
    """(device, scene, k) of a k-means of each device in rows (device, item, vec); scenes are 0 to k - 1 within the device.

    A device starts from its k items of smallest hash of the item's number (all, if it has fewer). A scene left without items
    keeps its centre. A round is one scan, whose sums are combined before the shuffle to (device, scene, position).
    """
    order = Window.partitionBy("device").orderBy(portable_hash(F.col("item"), F.lit(0), salt), "item")
    first = rows.withColumn("scene", F.row_number().over(order) - 1).where(F.col("scene") < k)  # k rows of a device leave each task
    centres = materialise(first.select("device", "scene", F.col("vec").alias("k")))
    for _ in range(rounds):
        x = with_scene(rows, centres).select("device", "scene", F.posexplode("vec").alias("pos", "x"))
        sums = x.groupBy("device", "scene", "pos").agg(F.sum(F.round(F.col("x") * UNIT).cast("long")).alias("s"), F.count(F.lit(1)).alias("n"))
        mean = F.struct("pos", (F.col("s") / F.col("n") / UNIT).alias("m"))
        moved = sums.groupBy("device", "scene").agg(F.transform(F.sort_array(F.collect_list(mean)), lambda p: p["m"]).alias("moved"))
        centres = materialise(centres.join(moved, ["device", "scene"], "left").select("device", "scene", F.coalesce("moved", "k").alias("k")))
    return centres


def with_scene(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """Rows with the scene of their device's nearest centre. Centres are k rows a device."""
    packed = centres.groupBy("device").agg(F.sort_array(F.collect_list(F.struct("scene", "k"))).alias("centres"))
    return rows.join(packed, "device").withColumn("scene", nearest_centre(F.col("vec"), F.col("centres"))).drop("centres")


def best_assignment(gain: np.ndarray) -> list[int]:
    """Column for each row so that the gains add up to the most, each column once; rows are no more than columns.

    Row by row over sets of used columns, so it is meant for a dozen scenes. Of equal sums the smaller columns win.
    """
    n, m = gain.shape
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(n):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, path) in best.items():
            for j in range(m):
                if not used >> j & 1:
                    at, to = used | 1 << j, (total + gain[i, j], [*path, j])
                    if at not in step or (to[0], [-c for c in to[1]]) > (step[at][0], [-c for c in step[at][1]]):
                        step[at] = to
        best = step
    return max(best.values(), key=lambda b: (b[0], [-c for c in b[1]]))[1]


def matched_labels(centres: DataFrame) -> DataFrame:
    """(device, scene, label): label is the scene of the reference device, first by name of those with most scenes, that goes with it.

    The sum of cosines between matched centres is the greatest possible; the reference keeps its numbers.
    """
    whole = centres.groupBy("device").agg(F.sort_array(F.collect_list(F.struct("scene", "k"))).alias("own"))
    ref = whole.orderBy(F.desc(F.size("own")), "device").limit(1).select("own").scalar()
    kind = centres.schema["device"].dataType.simpleString()

    def unit(rows) -> np.ndarray:
        m = np.stack([np.asarray(r["k"], dtype=float) for r in rows])
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def match(batches):
        for batch in batches:
            out = []
            for device, own, base in zip(batch["device"], batch["own"], batch["base"], strict=True):
                to = best_assignment(np.round(unit(own) @ unit(base).T, 9))
                out += [(device, own[i]["scene"], base[j]["scene"]) for i, j in enumerate(to)]
            yield pd.DataFrame(out, columns=["device", "scene", "label"])

    return whole.withColumn("base", ref).mapInPandas(match, f"device {kind}, scene int, label int")


def device_scenes(items: DataFrame, device: str, item: str, vec: str, k: int, rounds: int = 10) -> DataFrame:
    """(device, item, label): each item's scene, clustered within its device, under labels that agree between devices.

    ``item`` is a whole number. Rows without a device or vector have no scene and are left out; vectors of one device have one length.
    """
    rows = items.select(F.col(device).alias("device"), F.col(item).alias("item"), V.doubles(F.col(vec)).alias("vec")).dropna()
    rows = materialise(rows)
    centres = device_centres(rows, k, rounds)
    labels = materialise(matched_labels(centres))
    return with_scene(rows, centres).join(labels, ["device", "scene"]).select("device", "item", "label")
