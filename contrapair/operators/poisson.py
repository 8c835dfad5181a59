"""Bootstraps in one pass over the items.

Resampling n items with replacement gives each a multiplicity, and for many items these are as good as independent Poisson
numbers of mean 1. So an item draws its own multiplicity for every replicate from a hash of (item, replicate), and a task adds
up multiplicity times value for all replicates while it reads its items: neither a row for each item and replicate nor a rank
of items is needed, and what is shuffled is one row per group and replicate and task. Draws don't depend on layout or retries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrapair.functions.hashing import P, hash_array, portable_hash_sql
from contrapair.functions.vectors import safe_div
from contrapair.operators.scoring import tiled

#: A hash in [0, P) at or above CUTS[j] means more than j copies: P times the Poisson(1) distribution, rounded down.
CUTS = [math.floor(P * sum(math.exp(-1) / math.factorial(i) for i in range(j + 1))) for j in range(12)]
#: Multiplicities made at once.
BLOCK = 1 << 20


def copies(hashes: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(CUTS), hashes, side="right")


def copies_sql(h: str) -> str:
    return "(" + " + ".join(f"({h} >= {c})::BIGINT" for c in CUTS) + ")"


def item_copies_sql(item: str, rep: str, stream: str | None, salt: int) -> str:
    """Multiplicity of an item in a replicate; a stream gives a second draw of its own."""
    h = portable_hash_sql(item, rep, salt)
    return copies_sql(h if stream is None else portable_hash_sql(h, stream, salt + 1))


def _sums(uid: np.ndarray, values: np.ndarray, rep: np.ndarray, stream: np.ndarray | None, salt: int) -> np.ndarray:
    """(draws, values + 1): sums of multiplicity times each value, and of multiplicities; draw i is (rep[i], stream[i])."""
    ones = np.column_stack([values, np.ones(len(values))])
    total = np.zeros((len(rep), ones.shape[1]))
    step = max(1, BLOCK // max(1, len(rep)))
    for at in range(0, len(uid), step):
        h = hash_array(uid[at:at + step, None], rep[None, :], salt)
        if stream is not None:
            h = hash_array(h, stream[None, :], salt + 1)
        total += copies(h).T.astype(float) @ ones[at:at + step]
    return total


def poisson_means(items: DataFrame, keys: list[str], uid: str, values: list[str], reps: int, salt: int) -> DataFrame:
    """keys, rep, values: means of each replicate's resample of a group. Rows with a null take no part."""
    types = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["rep long"] + [f"`{v}` double" for v in values] + ["__m double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, held = np.arange(reps), {}
        for batch in batches:
            for key, at in batch.groupby(keys).indices.items() if keys else [((), np.arange(len(batch)))]:
                some = batch.iloc[at]
                got = _sums(some[uid].to_numpy(), some[values].to_numpy(float), every, None, salt)
                held[key] = held[key] + got if key in held else got
        for key, total in held.items():
            out = pd.DataFrame(total, columns=[*values, "__m"])
            out["rep"] = every
            for k, v in zip(keys, key if isinstance(key, tuple) else (key,), strict=True):
                out[k] = v
            yield out[[*keys, "rep", *values, "__m"]]

    x = items.select(*keys, F.col(uid).cast("long").alias(uid), *[F.col(v).cast("double").alias(v) for v in values]).dropna()
    x = x.mapInPandas(run, schema)
    return x.groupBy(*keys, "rep").agg(*[safe_div(F.sum(v), F.sum("__m")).alias(v) for v in values])


def hierarchical_means(items: DataFrame, clusters: DataFrame, arm: str, tag: str, place: str, uid: str, values: list[str], reps: int,
                       cluster_salt: int, salt: int, shared: bool = False) -> DataFrame:
    """Means of resampled items of resampled clusters: arm, rep, slot, tag, values.

    items: arm, place, uid, values. clusters: arm, tag, place (1, 2, ... in each arm), one row per cluster. Slot s of replicate
    r draws the cluster in place h(s, r) mod k + 1 of its arm; each slot resamples that cluster's items for itself, or, with
    ``shared``, all slots of a replicate use the same multiplicities of items. A slot that draws no item has null means.
    A task holds sums for its clusters' draws, that is reps x clusters of them at most.
    """
    sizes = {r[arm]: r["k"] for r in clusters.groupBy(arm).agg(F.count(F.lit(1)).alias("k")).collect()}  # arms are few by design
    arms = sorted(sizes)
    types = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    schema = f"`{arm}` {types[arm]}, `{place}` long, rep long, slot long, " + ", ".join(f"`{v}` double" for v in values) + ", __m double"

    def draws(which: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """place -> (rep, slot) of the draws that took it."""
        k = sizes[which]
        rep, slot = (a.ravel() for a in np.meshgrid(np.arange(reps), np.arange(1, k + 1), indexing="ij"))
        drawn = hash_array(slot, rep * len(arms) + arms.index(which), cluster_salt) % k + 1
        order = np.argsort(drawn, kind="stable")
        ends = np.searchsorted(drawn[order], np.arange(1, k + 2))
        return {p: (rep[order[ends[p - 1]:ends[p]]], slot[order[ends[p - 1]:ends[p]]]) for p in range(1, k + 1)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn: dict[str, dict] = {}
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for (which, p), at in batch.groupby([arm, place]).indices.items():
                if which not in drawn:
                    drawn[which] = draws(which)
                rep, slot = drawn[which][p]
                stream = np.zeros_like(slot) if shared else slot * len(arms) + arms.index(which)
                some = batch.iloc[at]
                got = _sums(some[uid].to_numpy(), some[values].to_numpy(float), rep, stream, salt)
                held[which, p] = held[which, p] + got if (which, p) in held else got
        for (which, p), total in held.items():
            out = pd.DataFrame(total, columns=[*values, "__m"])
            out["rep"], out["slot"] = drawn[which][p]
            out[arm], out[place] = which, p
            yield out[[arm, place, "rep", "slot", *values, "__m"]]

    x = items.select(arm, F.col(place).cast("long").alias(place), F.col(uid).cast("long").alias(uid), *[F.col(v).cast("double").alias(v) for v in values]).dropna()
    x = x.mapInPandas(run, schema).groupBy(arm, place, "rep", "slot").agg(*[safe_div(F.sum(v), F.sum("__m")).alias(v) for v in values])
    return x.join(clusters.select(arm, tag, F.col(place).cast("long").alias(place)), [arm, place]).select(arm, "rep", "slot", tag, *values)


def bootstrap_signatures(items: DataFrame, device: str, uid: str, y: str, w: str, reps: int, salt: int, tile: int = 4096, least: float = 1e-6) -> DataFrame:
    """Multiplicative signatures of each replicate's resample of a device's items: device, rep, pos, k.

    Arrays are cut into tiles of positions, so a task holds reps x tile sums for the devices of its rows.
    """
    types = {f.name: f.dataType.simpleString() for f in items.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, held = np.arange(reps), {}
        for batch in batches:
            for key, at in batch.groupby([device, "__tile"]).indices.items():
                some = batch.iloc[at]
                a, b = np.stack(some[y]).astype(float), np.stack(some[w]).astype(float)
                got = _sums(some[uid].to_numpy(), np.concatenate([a * b, a * a], axis=1), every, None, salt)[:, :-1]
                held[key] = held[key] + got if key in held else got
        for (which, t), total in held.items():
            num, den = np.split(total, 2, axis=1)
            yield pd.DataFrame({device: which, "rep": np.repeat(every, num.shape[1]), "pos": np.tile(t * tile + np.arange(num.shape[1]), reps),
                                "num": num.ravel(), "den": den.ravel()})

    x = tiled(items.select(device, F.col(uid).cast("long").alias(uid), y, w), [y, w], tile)
    x = x.mapInPandas(run, f"`{device}` {types[device]}, rep long, pos long, num double, den double")
    return x.groupBy(device, "rep", "pos").agg((F.sum("num") / F.greatest(F.sum("den"), F.lit(least))).alias("k"))
