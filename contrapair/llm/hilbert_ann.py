"""Approximate nearest neighbours on shifted space-filling curves.

Each distinct vector is projected to a few axes and placed on several Hilbert curves, each with its own
projection and shift. A curve is cut into ranges of about equal length; vectors near each other tend to meet
in the same or the next range of some curve. A range is one group of a shuffle: it holds its own vectors as
candidates and, as queries, those of its own and of its two neighbours. What the ranges find is merged,
scored on the original vectors and ranked.

The cut points come from a sample of at most ``sample_rows`` vectors, but every vector is indexed. The ranges'
number is ``ranges_factor * n ** ranges_power`` (0.2 by default): their share of the rows falls as the table
grows, since the nearest of more vectors are nearer. Places depend on directions only, so vectors should be of
similar length. Vectors without structure, as independent Gaussian ones
in 64 dimensions, need wide ranges for a recall of 0.9; on clustered vectors a higher power serves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrapair.llm.common import proper_vector, stack, unit_hash
from contrapair.llm.curves import Curves
from contrapair.session import materialise


def directions(m: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component comes out first, so that no square overflows or vanishes."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def mended(scores: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products whose terms overflowed in both senses (NaN) from rows scaled by their largest components."""
    bad = np.isnan(scores)
    if bad.any():
        a, b = (np.abs(x[bad]).max(axis=1) for x in (left, right))
        with np.errstate(over="ignore"):
            scores[bad] = ((left[bad] / a[:, None]) * (right[bad] / b[:, None])).sum(axis=1) * a * b
    return scores


def nearest(vectors: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int = 20, *, curves: int = 24, axes: int = 8,
            bits: int = 4, ranges_factor: float = 7.0, ranges_power: float = 0.2, sample_rows: int = 20000, seed: int = 7,
            range_rows: int = 65536) -> DataFrame:
    """The ``k`` largest inner products found for each query: query_id, rank, vec_id, score.

    ``is_query`` marks the queries among the rows; candidates are all rows with another id. Ties go to the smaller id.

    * Null ids, null, empty and zero vectors, and vectors with a null, NaN or infinite component take no part.
    * Vectors of different lengths never meet: each length has curves of its own.
    * Rows repeating an id and a vector count once. An id with several vectors is a candidate by each of them, keeps its
      best score, and is one query, by its smallest vector.
    * Equal vectors are one candidate that carries its k + 1 smallest ids: others could not enter a result,
      so a vector that a third of all rows share costs no more than any other.
    * A score beyond the range of doubles is infinite; infinite ones tie.
    * A range that holds more than about ``range_rows`` candidates by the sample's estimate, as where many keys are equal, is dealt
      out in parts by a hash of the vector; its queries go to each part.
    * An empty table gives no rows. Other columns of the table are not looked at.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), is_query.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & proper_vector(F.col("vec")))
    rows = rows.where(F.exists("vec", lambda x: x != 0.0))
    # a long run of equal vectors leaves each task as its k + 1 smallest ids, then meets
    first = Window.partitionBy("vec").orderBy("id")
    known = rows.select("id", "vec").withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= k + 1)
    known = materialise(known.groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids")))
    asked = rows.where("asks").groupBy("id").agg(F.min("vec").alias("vec")).select("vec", F.array("id").alias("ids"), F.lit(True).alias("asks"))
    sizes = {r["dim"]: r["n"] for r in known.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total = sum(sizes.values())

    def curves_of(dim: int) -> Curves:
        return Curves(dim, curves, axes, bits, seed)

    cuts: dict[int, np.ndarray] = {}
    parts: dict[int, np.ndarray] = {}  # of each curve's ranges
    sample = known.where(unit_hash("vec") < min(1.0, sample_rows / total)).select("vec").limit(2 * sample_rows).toPandas()["vec"]
    by_dim: dict[int, list] = {d: [] for d in sizes}
    for v in sample:
        by_dim[len(v)].append(v)
    for dim, n in sizes.items():
        ranges = max(1, min(n, round(ranges_factor * n ** ranges_power)))
        m = stack(by_dim[dim]) if by_dim[dim] else np.eye(1, dim)
        keys = curves_of(dim).keys(directions(m))
        cuts[dim] = np.quantile(keys, np.arange(1, ranges) / ranges, axis=0, method="nearest").T  # a row of cuts for each curve
        held = np.stack([np.bincount(np.searchsorted(c, keys[:, j], side="right"), minlength=ranges) for j, c in enumerate(cuts[dim])])
        parts[dim] = np.maximum(1, np.ceil(held * (n / len(m)) / range_rows)).astype(np.int64)

    def places(m: np.ndarray) -> np.ndarray:
        keys = curves_of(m.shape[1]).keys(directions(m))
        return np.stack([np.searchsorted(c, keys[:, j], side="right") for j, c in enumerate(cuts[m.shape[1]])], axis=1)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each candidate to its range of every curve, each query to three."""
        for batch in batches:
            for dim, part in batch.groupby(batch["vec"].map(len), sort=False):
                m = stack(part["vec"])
                at, last = places(m), cuts[dim].shape[1]
                packed = np.array([r.tobytes() for r in m], dtype=object)
                ids, asks = part["ids"].to_numpy(), part["asks"].to_numpy(dtype=bool)
                salt = np.fromiter((zlib.crc32(b) for b in packed), dtype=np.int64, count=len(packed))
                for c in range(curves):
                    for step in (-1, 0, 1):
                        to = at[:, c] + step
                        take = np.flatnonzero((asks | (step == 0)) & (to >= 0) & (to <= last))
                        count = parts[dim][c, to[take]]
                        copies = np.where(asks[take], count, 1)
                        first = np.repeat(np.cumsum(copies) - copies, copies)
                        go = np.repeat(take, copies)
                        lot = np.where(asks[go], np.arange(len(go)) - first, salt[go] % np.repeat(count, copies))
                        yield pd.DataFrame({
                            "dim": np.int32(dim), "curve": np.int32(c), "range": to[go].astype(np.int32), "lot": lot.astype(np.int32),
                            "vec": packed[go], "ids": ids[go], "asks": asks[go]})

    def search(_key, group):
        """Best candidates of one range for the queries that reach it."""
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        asks = group["asks"].to_numpy(dtype=bool)
        own, queries = group[~asks], group[asks]
        if not len(own) or not len(queries):
            return empty
        m, q = (np.stack([np.frombuffer(b) for b in x["vec"]]) for x in (own, queries))
        ids, qid = own["ids"].to_numpy(), np.array([i[0] for i in queries["ids"]], dtype=np.int64)
        out, keep = [], min(len(m), k + 1)
        flat = np.concatenate(ids)
        repeats = len(np.unique(flat)) < len(flat)  # ids of several vectors: one query at a time, so that k ids are held, not k rows
        step = 1 if repeats else max(1, (1 << 22) // len(m))
        for at in range(0, len(q), step):
            with np.errstate(over="ignore", invalid="ignore"):
                s = q[at:at + step] @ m.T
            for r in np.flatnonzero(np.isnan(s).any(axis=1)):  # only where components near 1e150 and more meet
                c = np.flatnonzero(np.isnan(s[r]))
                s[r, c] = mended(s[r, c], np.broadcast_to(q[at + r], (len(c), q.shape[1])), m[c])
            finite = np.where(np.isfinite(s), np.abs(s), 0.0).max(axis=1)
            best = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
            # all that reach the last kept score, up to the last bits, so that ties are settled by id
            least = np.take_along_axis(s, best, axis=1).min(axis=1)
            if repeats:
                down = np.argsort(-s[0], kind="stable")
                owner = np.repeat(down, [len(ids[j]) for j in down])
                firsts = np.sort(np.unique(np.concatenate(ids[down]), return_index=True)[1])
                least = s[0, owner[firsts[:k + 1][-1:]]]
            least = least - 1e-9 * np.maximum(1.0, finite)
            r, c = np.nonzero(s >= least[:, None])
            with np.errstate(over="ignore", invalid="ignore"):
                exact = mended((q[at + r] * m[c]).sum(axis=1), q[at + r], m[c])  # term by term, so that equal pairs score equally in every range
            n = np.fromiter((len(ids[j]) for j in c), dtype=np.int64, count=len(c))
            found = pd.DataFrame({
                "query_id": np.repeat(qid[at + r], n), "vec_id": np.concatenate([np.asarray(ids[j], dtype=np.int64) for j in c]),
                "score": np.repeat(exact, n)})
            found = found[found["query_id"] != found["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            if repeats:
                found = found.drop_duplicates(["query_id", "vec_id"])
            out.append(found.groupby("query_id", sort=False).head(k))
        return pd.concat(out) if out else empty

    both = known.select("vec", "ids", F.lit(False).alias("asks")).unionByName(asked)
    dealt = both.mapInPandas(deal, "dim int, curve int, range int, lot int, vec binary, ids array<long>, asks boolean")
    found = dealt.groupBy("dim", "curve", "range", "lot").applyInPandas(search, "query_id long, vec_id long, score double")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
