"""Exact top-k by inner product on a bit-sliced index.

The index holds blocks of rows. In a block, attribute j of all rows is stored as bit slices: one bitmap over the
rows for each bit of the attribute (minus its smallest value in the block). A query adds the slices of all
attributes, shifted by the bits of its own components, with carry-save bitmap arithmetic; the result is the bit-sliced
score of every row. The best rows are then selected from the most significant slice downward, and rows that tie at
the boundary are taken in order of their id, so the result is exact.

Queries are dealt out in groups of their own, and each (row block, query group) is one group of a shuffle. The work is
rows x queries by definition; its pieces have a fixed size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrapair.llm.common import proper_vector
from contrapair.session import materialise

LONG_MAX, LONG_MIN = 2 ** 63 - 1, -2 ** 63

INDEX = "dim int, block int, count int, ids binary, low array<long>, width int, slices binary"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float, keep: list[Column]) -> DataFrame:
    """Rows (id, vec array<long>, ...) with components floor(scale * x)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("raw"), *keep)
    rows = rows.where(F.col("id").isNotNull() & proper_vector(F.col("raw")))
    return rows.select("id", F.transform("raw", lambda x: F.floor(x * F.lit(scale))).alias("vec"), *[c for c in rows.columns if c not in ("id", "raw")])


def build_index(rows: DataFrame, block_rows: int = 16384) -> DataFrame:
    """Blocks of the bit-sliced index over rows (id, vec array<long>); rows repeating an id and a vector count once."""
    rows = rows.select("id", "vec").distinct()
    blocks = rows.count() // block_rows + 1

    def slice_block(key, group):
        group = group.sort_values("id", kind="stable")
        m = np.stack(group["vec"].to_numpy()).astype(np.int64)
        low = m.min(axis=0)
        m = (m.view(np.uint64) - low.view(np.uint64)).T  # attributes x rows; a difference of longs fits 64 bits without sign
        width = max(1, int(m.max()).bit_length())
        words = -(-m.shape[1] // 64)
        slices = np.zeros((m.shape[0], width, words * 8), dtype=np.uint8)
        for b in range(width):
            packed = np.packbits(((m >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little")
            slices[:, b, :packed.shape[1]] = packed
        return pd.DataFrame({
            "dim": [int(key[0])], "block": [int(key[1])], "count": [m.shape[1]], "ids": [group["id"].to_numpy(dtype=np.int64).tobytes()],
            "low": [low], "width": [width], "slices": [slices.tobytes()]})

    placed = rows.withColumn("dim", F.size("vec")).withColumn("block", F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)).cast("int"))
    return placed.groupBy("dim", "block").applyInPandas(slice_block, INDEX)


def add_slices(planes: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Bit slices of the sum of bitmaps: ``planes[w]`` are stacks of bitmaps of weight 2**w."""
    total, level = [], 0
    while planes:
        parts = planes.pop(level, [])
        m = np.concatenate(parts) if parts else np.zeros((0, 0), dtype=np.uint64)
        carries = []
        while len(m) > 2:  # three bitmaps of a weight become one of it and one of the next
            n = len(m) // 3
            a, b, c = m[:n], m[n:2 * n], m[2 * n:3 * n]
            odd = a ^ b
            carries.append((a & b) | (odd & c))
            m = np.concatenate([odd ^ c, m[3 * n:]])
        if len(m) == 2:
            carries.append((m[:1] & m[1:]))
            m = m[:1] ^ m[1:]
        total.append(m[0] if len(m) else None)
        if carries:
            planes.setdefault(level + 1, []).extend(carries)
        level += 1
    zero = next((np.zeros_like(t) for t in total if t is not None), None)
    return [zero if t is None else t for t in total]


def select_top(slices: list[np.ndarray], valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows surely among the k largest, and of those that tie for the places left."""
    sure, tied = np.zeros_like(valid), valid
    for bit in reversed(slices):
        above = sure | (tied & bit)
        n = int(np.bitwise_count(above).sum())
        if n > k:
            tied = tied & bit
        else:
            sure, tied = above, tied & ~bit
            if n == k:
                return sure, np.zeros_like(valid)
    return sure, tied


def compare(slices: list[np.ndarray], bound: int, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows of ``whole`` whose bit-sliced number is above, and below, ``bound``."""
    if bound < 0:
        return whole, np.zeros_like(whole)
    if bound >> len(slices):
        return np.zeros_like(whole), whole
    above, below, open_ = np.zeros_like(whole), np.zeros_like(whole), whole
    for w in reversed(range(len(slices))):
        if (bound >> w) & 1:
            below, open_ = below | (open_ & ~slices[w]), open_ & slices[w]
        else:
            above, open_ = above | (open_ & slices[w]), open_ & ~slices[w]
    return above, below


def places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def best_places(total: list[np.ndarray], valid: np.ndarray, k: int, base: int) -> np.ndarray:
    """Places of the k best rows, in order of place among equals; scores beyond either end of ``long`` are equal there."""
    over, under = compare(total, LONG_MAX - base, valid)[0], compare(total, LONG_MIN - base, valid)[1]
    at = places(over)[:k]
    inner = valid & ~over & ~under
    if len(at) < k:
        sure, tied = select_top(total, inner, k - len(at))
        at = np.concatenate([at, places(sure)])
        at = np.concatenate([at, places(tied)[:k - len(at)]])
    return np.concatenate([at, places(under)[:k - len(at)]])


def bits_of(mask: np.ndarray) -> np.ndarray:
    return np.packbits(mask, bitorder="little").view(np.uint64)


def search_block(block, queries: list[tuple[int, np.ndarray]], k: int) -> pd.DataFrame:
    """Rows with the k best ids of one index block for each (id, vector) query, the best row of each among them; rows with the query's id are left out."""
    count, width = int(block["count"]), int(block["width"])
    ids, low = np.frombuffer(block["ids"], dtype=np.int64), np.asarray(block["low"], dtype=np.int64)
    plus = np.frombuffer(block["slices"], dtype=np.uint64).reshape(len(low), width, -1)
    both = np.stack([plus, ~plus])  # the complement of x counts as 2**width - 1 - x: negative factors become positive ones
    whole = np.zeros(plus.shape[2] * 64, dtype=np.uint8)
    whole[:count] = 1
    whole = bits_of(whole)
    repeats = bool((ids[1:] == ids[:-1]).any())
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for qid, q in queries:
        size, negative = np.abs(q).view(np.uint64), (q < 0).astype(np.int64)  # the view holds 2**63 too
        planes: dict[int, list[np.ndarray]] = {}
        for a in range(int(size.max()).bit_length()):
            js = np.flatnonzero((size >> np.uint64(a)) & np.uint64(1))
            if len(js):
                for b in range(width):
                    planes.setdefault(a + b, []).append(both[negative[js], js, b])
        # Python's integers: neither the products nor their sum need fit 64 bits
        base = sum(x * y for x, y in zip(q.tolist(), low.tolist(), strict=True)) + sum(x for x in q.tolist() if x < 0) * ((1 << width) - 1)
        valid = whole
        lo, hi = np.searchsorted(ids, qid, side="left"), np.searchsorted(ids, qid, side="right")
        if hi > lo:
            own = np.zeros(len(whole) * 64, dtype=np.uint8)
            own[lo:hi] = 1
            valid = whole & ~bits_of(own)
        total = add_slices(planes)
        at = best_places(total, valid, k, base)
        while repeats and len(np.unique(ids[at])) < k:  # all rows of ids already held make way until k ids are held
            held = np.zeros(len(whole) * 64, dtype=np.uint8)
            held[:count] = np.isin(ids, ids[at])
            more = best_places(total, valid & ~bits_of(held), k - len(np.unique(ids[at])), base)
            if not len(more):
                break
            at = np.concatenate([at, more])
        score = [base] * len(at)
        for w, bit in enumerate(total):
            held = (bit[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            score = [s + (int(h) << w) for s, h in zip(score, held, strict=True)]
        score = np.array([min(max(s, LONG_MIN), LONG_MAX) for s in score], dtype=np.int64)
        found.append((np.full(len(at), qid), ids[at], score))
    cols = [np.concatenate(c) if found else np.zeros(0, dtype=np.int64) for c in zip(*found, strict=True)] or [np.zeros(0, dtype=np.int64)] * 3
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))


def top_k(vectors: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int = 20, *, scale: float = 64.0,
          block_rows: int = 16384, query_rows: int = 256) -> DataFrame:
    """The ``k`` highest integer inner products of floor(scale * x) vectors for each query: query_id, rank, vec_id, score.

    ``is_query`` marks the queries; candidates are all rows with another id. Ties go to the smaller id.

    * Null ids, null and empty vectors, and vectors with a null, NaN or infinite component take no part.
    * Vectors of another length than the query's are no candidates.
    * Rows repeating an id and a vector count once; an id with several vectors keeps its best score and asks by its smallest vector.
    * Components beyond ``long`` count as its nearest end. Products are added without a limit of size; a score beyond ``long``
      becomes its nearest end, for that pair only, and ties with others there.
    * An empty table gives no rows. Other columns are not looked at.
    """
    rows = materialise(quantised(vectors, id_col, vec_col, scale, [is_query.alias("asks")]))
    index = materialise(build_index(rows, block_rows))
    asked = materialise(rows.where("asks").groupBy("id").agg(F.min("vec").alias("vec")))
    groups = asked.count() // query_rows + 1
    packed = (asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("dim", F.size("vec"))
              .groupBy("dim", "part").agg(F.sort_array(F.collect_list(F.struct("id", "vec"))).alias("asked")))
    meets = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(packed, ["dim", "part"])

    def search(_key, group):
        out = []
        for _, row in group.iterrows():
            queries = [(int(a["id"]), np.asarray(a["vec"], dtype=np.int64)) for a in row["asked"]]
            out.append(search_block(row, queries, k))
        return pd.concat(out)

    found = meets.groupBy("dim", "block", "part").applyInPandas(search, "query_id long, vec_id long, score long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
