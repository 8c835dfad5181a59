"""SimHash near-duplicates by runs of bits and vantage-point trees.

Fingerprints within r bits of each other agree in all bits of at least one of r + 1 runs of bits. Each fingerprint therefore
goes to one shard for each run, a range of that run's values, and is compared with those of equal value: r + 1 copies of a
row, however many rows there are. A pair belongs to the first run it agrees in, so its link is found once.

Where one value has too many fingerprints, a tree splits them by their Hamming distance to a vantage point: near ones
(distance t or less) to one side, the others to the other. By the triangle inequality two fingerprints within r of each other
can lie on different sides only if the farther one is at most t + r away, so the near side also takes the fingerprints up to
there, and every linked pair meets on at least one side. Cuts and trees over shards are chosen on a bounded sample; each
shard goes on splitting its own, down to leaves small enough to compare.
The result is exact. A shard passes on only links that join what it hasn't joined before, never all pairs of a group.

Linked fingerprints become classes by repeated star contraction in tables; nothing about them is collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrapair.llm.common import map_texts, release, unit_hash
from contrapair.session import materialise, scratch

LEAF = 128
#: Members of trees that are looked at together, on average; no tree is cut.
LOT = 512


# ---- fingerprints -------------------------------------------------------------------------------------------------


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words, repeats included; of the whole sequence if it is shorter."""
    w = (text or "").encode().lower().split()  # bytes: lowers A-Z and splits at the six ASCII blanks only
    if not w:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(b" ".join(w), 42)], dtype=np.uint64)
    joined = b" ".join(w)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == ord(" ")), len(joined))
    starts = np.concatenate([[0], ends[:-words] + 1]).tolist()
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1:].tolist(), strict=True)], dtype=np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many rows have each bit, most significant first; eight counters share a word for up to 255 rows at a time."""
    rows = np.ascontiguousarray(hashes.astype(">u8").reshape(len(hashes), -1)).view(np.uint8)
    out = np.zeros(rows.shape[1] * 8, dtype=np.int64)
    for at in range(0, len(rows), 255):
        bits = np.unpackbits(rows[at:at + 255], axis=1)
        out += np.add.reduce(bits.view(np.uint64), axis=0).view(np.uint8)
    return out


def widened(hashes: np.ndarray, times: int) -> np.ndarray:
    """Each hash as ``times`` independent ones (a 64-bit mixer with a step for each)."""
    if times == 1:
        return hashes[:, None]
    x = hashes[:, None] + np.uint64(0x9E3779B97F4A7C15) * np.arange(1, times + 1, dtype=np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, words: int, times: int = 1) -> bytes:
    """64 * ``times`` bits, big-endian: a bit is one if more than half of the shingles have it; all zero without words."""
    h = shingle_hashes(text, words)
    if not len(h):
        return bytes(8 * times)
    return np.packbits(2 * bit_counts(widened(h, times)) > len(h)).tobytes()


def fingerprints(docs: DataFrame, text_col: str, carry: list[str], words: int, times: int = 1) -> DataFrame:
    """The columns ``carry`` with ``print``, the fingerprint's bytes. A null text is one without words."""

    def start():
        return lambda texts: {"print": [fingerprint(t, words, times) for t in texts]}

    return map_texts(docs, text_col, carry, {"print": "binary"}, start)


def shingle_sets(docs: DataFrame, text_col: str, carry: list[str], words: int, times: int) -> DataFrame:
    """The columns ``carry`` with ``shingles``, the sorted set of a text's shingle hashes, and ``print``, the fingerprint of that set."""

    def one(text):
        h = np.sort(shingle_hashes(text, words))
        h = h[np.append(h[:-1] != h[1:], True)] if len(h) else h  # a set; np.unique takes four times as long
        bits = np.packbits(2 * bit_counts(widened(h, times)) > len(h)).tobytes() if len(h) else bytes(8 * times)
        return h.view(np.int64), bits

    def start():
        def work(texts):
            made = [one(t) for t in texts]
            return {"shingles": [h for h, _ in made], "print": [b for _, b in made]}
        return work

    return map_texts(docs, text_col, carry, {"shingles": "array<long>", "print": "binary"}, start)


# ---- vantage-point trees ------------------------------------------------------------------------------------------


def vantage_split(x: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """A vantage point of the set and the distance that halves it best, boundary counted; None if it hardly splits."""
    point = x[len(x) // 2]
    far = np.bitwise_count(x ^ point)
    below = np.cumsum(np.bincount(far, minlength=65 + radius)) / len(x)  # share within each distance
    near, rest = below[radius:65 + radius], 1.0 - below[:65]
    t = int(np.maximum(near, rest).argmin())
    return (point, t) if max(near[t], rest[t]) <= 0.95 else None


class ShardTree:
    """The upper part of the tree: which shards a fingerprint belongs to."""

    def __init__(self, sample: np.ndarray, rows: int, radius: int, shard_rows: int):
        self.radius, self.nodes, self.shards = radius, [], 0
        self._grow(sample, max(1.0, rows / max(1, len(sample))), shard_rows)

    def _grow(self, sample: np.ndarray, scale: float, shard_rows: int) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        split = vantage_split(sample, self.radius) if len(sample) * scale > shard_rows and len(sample) > 16 else None
        if split is None:
            self.nodes[at] = self.shards
            self.shards += 1
            return at
        point, t = split
        far = np.bitwise_count(sample ^ point)
        near = self._grow(sample[far <= t + self.radius], scale, shard_rows)
        self.nodes[at] = (point, t, near, self._grow(sample[far > t], scale, shard_rows))
        return at

    def route(self, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(shard, places in x) for every shard that some of x belong to."""
        out, waiting = [], [(0, np.arange(len(x)))]
        while waiting:
            at, rows = waiting.pop()
            node = self.nodes[at]
            if not len(rows):
                continue
            if not isinstance(node, tuple):
                out.append((node, rows))
                continue
            point, t, near, rest = node
            far = np.bitwise_count(x[rows] ^ point)
            waiting += [(near, rows[far <= t + self.radius]), (rest, rows[far > t])]
        return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


class Forest:
    """Links between places that join all that is linked, and no more than that takes."""

    def __init__(self, label: np.ndarray):
        self.label, self.out = label, []

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            new = np.flatnonzero(a != b)
            if not len(new):
                return
            i, j, a, b = i[new], j[new], a[new], b[new]
            key = np.minimum(a, b) * len(label) + np.maximum(a, b)
            first = np.unique(key, return_index=True)[1]
            parent: dict[int, int] = {}

            def root(v: int) -> int:
                while v in parent:
                    v = parent[v]
                return v

            for k in first.tolist():
                p, q = root(int(a[k])), root(int(b[k]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    self.out.append((int(i[k]), int(j[k])))
            old = np.fromiter(parent, dtype=np.int64)
            to = np.array([root(v) for v in parent], dtype=np.int64)
            move = np.arange(len(label))
            move[old] = to
            label[:] = move[label]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.array(self.out, dtype=np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


def close_pairs(x: np.ndarray, radius: int, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of fingerprints within ``radius`` bits of each other among ``rows``, in blocks; near a boundary more than once."""
    waiting = [rows]
    while waiting:
        rows = waiting.pop()
        if len(rows) < 2:
            continue
        split = vantage_split(x[rows], radius) if len(rows) > LEAF else None
        if split is not None:
            far = np.bitwise_count(x[rows] ^ split[0])
            waiting += [rows[far <= split[1] + radius], rows[far > split[1]]]
            continue
        step = max(1, (1 << 22) // len(rows))
        for at in range(0, len(rows), step):  # a set that no vantage point splits is compared in blocks
            close = np.bitwise_count(x[rows[at:at + step], None] ^ x[rows[at:]][None, :]) <= radius
            i, j = np.nonzero(close)
            up = j > i
            yield rows[at + i[up]], rows[at + j[up]]


def forest_links(x: np.ndarray, radius: int, wide: np.ndarray, most: int, sets: list[np.ndarray] | None = None,
                 similarity: float = 0.0, joined: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) of linked fingerprints that join all linked ones of a set, a spanning forest and not all pairs, and their trees.

    Linked ones also differ in at most ``most`` bits of their rows in ``wide``, a matrix of words; with ``sets``, they must
    have this Jaccard similarity. Fingerprints with equal numbers in ``joined`` count as joined before.
    A tree goes by the place of one of its fingerprints.
    """
    label = np.arange(len(x))
    if joined is not None:
        first, of = np.unique(joined, return_index=True, return_inverse=True)[1:]
        label = first[of]
    forest = Forest(label)
    block = 1 << (16 if sets is None else 10)  # sets take longer to compare, so what has been joined is looked at more often
    for i, j in close_pairs(x, radius, np.arange(len(x))):
        for part in range(0, len(i), block):
            p, q = i[part:part + block], j[part:part + block]
            apart = label[p] != label[q]  # what is joined already needs no look at its rows
            p, q = p[apart], q[apart]
            same = np.bitwise_count(wide[p] ^ wide[q]).sum(axis=1, dtype=np.int64) <= most
            p, q = p[same], q[same]
            if sets is not None:
                same = np.array([jaccard(sets[a], sets[b]) >= similarity for a, b in zip(p.tolist(), q.tolist(), strict=True)], dtype=bool)
                p, q = p[same], q[same]
            forest.join(p, q)
    i, j = forest.links()
    return i, j, label[i]


# ---- runs of bits -------------------------------------------------------------------------------------------------


def run_masks(bits: int, radius: int) -> np.ndarray:
    """The lowest ``bits`` bits as radius + 1 runs; what differs in at most ``radius`` bits agrees in one of them. Higher bits are in the first."""
    ends = [bits * k // (radius + 1) for k in range(radius + 1)] + [64]
    return np.array([(1 << b) - (1 << a) for a, b in zip(ends, ends[1:], strict=False)][::-1], dtype=np.uint64)


def run_links(x: np.ndarray, radius: int, masks: np.ndarray, runs: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``forest_links`` without more to check, for the pairs that belong to one of these runs: the first run they agree in.

    Equal fingerprints are compared once. They belong to the first run; in others they are tied where one of them has a link,
    so that each linked pair of places lies in one tree.
    """
    u, place, of = np.unique(x, return_index=True, return_inverse=True)
    forest, tied = Forest(np.arange(len(u))), np.full(len(u), 0 in runs)

    def take(run: int, i: np.ndarray, j: np.ndarray) -> None:
        apart = u[i] ^ u[j]
        own = np.bitwise_count(apart) <= radius
        for earlier in masks[:run]:
            own &= (apart & earlier) != 0
        i, j = i[own], j[own]
        tied[i] = tied[j] = True
        forest.join(i, j)

    for run in runs:
        value = u & masks[run]
        order = np.argsort(value, kind="stable")
        starts = np.flatnonzero(np.diff(value[order], prepend=~value[order[:1]]) != 0)
        sizes = np.diff(starts, append=len(u))
        end = np.repeat(starts + sizes, sizes)
        live = np.flatnonzero(np.repeat(sizes <= LEAF, sizes))
        for k in range(1, LEAF):  # each fingerprint with the k-th after it of equal value
            live = live[live + k < end[live]]
            if not len(live):
                break
            close = live[np.bitwise_count(u[order[live]] ^ u[order[live + k]]) <= radius]
            take(run, order[close], order[close + k])
        for k in np.flatnonzero(sizes > LEAF).tolist():
            for i, j in close_pairs(u, radius, order[starts[k]:starts[k] + sizes[k]]):
                take(run, i, j)
    i, j = forest.links()
    more = np.flatnonzero((place[of] != np.arange(len(x))) & tied[of])
    return np.concatenate([place[i], place[of[more]]]), np.concatenate([place[j], more]), place[forest.label[np.concatenate([i, of[more]])]]


class Shards:
    """Which shards a table's fingerprints belong to: a range of the values of each run, or a tree's shard where one value is too frequent.

    A shard's number divided by the number of runs leaves its run. A small table is the one shard WHOLE.
    """

    WHOLE = -1

    def __init__(self, sample: np.ndarray, rows: int, radius: int, masks: np.ndarray, shard_rows: int):
        self.masks, self.cells = masks, []
        for mask in masks if rows > shard_rows else []:
            value = np.sort(sample & mask)
            cells = -(-rows // shard_rows)
            cuts = np.unique(value[np.arange(1, cells) * len(value) // cells]) if len(value) else value
            cell, trees, first = np.searchsorted(cuts, sample & mask, side="right"), {}, len(cuts) + 1
            share = np.bincount(cell, minlength=first) * (rows / max(1, len(sample)))
            for c in np.flatnonzero(share > 2 * shard_rows).tolist():
                tree = ShardTree(sample[cell == c], int(share[c]), radius, shard_rows)
                trees[c] = (first, tree)
                first += tree.shards
            self.cells.append((cuts, trees))

    def route(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(shards, places in x), for all of x as often as they are dealt out."""
        if not self.cells:
            return [(np.full(len(x), self.WHOLE), np.arange(len(x)))]
        out = []
        for run, (cuts, trees) in enumerate(self.cells):
            cell = np.searchsorted(cuts, x & self.masks[run], side="right")
            plain = np.flatnonzero(~np.isin(cell, list(trees)))
            out.append((cell[plain] * len(self.masks) + run, plain))
            for c, (first, tree) in trees.items():
                rows = np.flatnonzero(cell == c)
                out += [(np.full(len(at), (first + shard) * len(self.masks) + run), rows[at]) for shard, at in tree.route(x[rows])]
        return out


def links(prints: DataFrame, radius: int, *, bits: int = 64, shard_rows: int = 4096, sample_rows: int = 1 << 18,
          sizes: dict[int, int] | None = None) -> DataFrame:
    """Links (a, b) between nodes whose fingerprints in the same table differ in at most ``radius`` of their ``bits`` bits.

    ``prints`` has (tab int, print long, node long). The links connect exactly what all such pairs connect. ``tree`` tells
    which links of a shard hang together: both nodes of a pair are in one tree of its shard. ``sample_rows`` bounds the sample the
    shards are chosen by; every fingerprint is dealt out. ``sizes`` has the rows of each table, if the caller knows them.
    """
    if sizes is None:
        sizes = {r["tab"]: r["n"] for r in prints.groupBy("tab").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return prints.sparkSession.createDataFrame([], LINK)
    masks = run_masks(bits, radius)
    want = min(1.0, sample_rows / sum(sizes.values()), 16.0 * 64 / shard_rows)
    rows = prints.where(unit_hash("tab", "print", "node") < want).select("tab", "print").toPandas()
    shards: dict[int, Shards] = {}
    for tab, n in sizes.items():
        sample = np.sort(rows["print"][rows["tab"] == tab].to_numpy(dtype=np.int64).view(np.uint64))
        shards[tab] = Shards(sample, n, radius, masks, shard_rows)
    shared = prints.sparkSession.sparkContext.broadcast(shards)  # a number for each cut, two for each split of at most sample_rows / 16

    def deal(batches):
        release()
        for batch in batches:
            out = []
            for tab, part in batch.groupby("tab", sort=False):
                x, node = part["print"].to_numpy(dtype=np.int64), part["node"].to_numpy()
                out += [(np.full(len(at), tab), shard, x[at], node[at]) for shard, at in shared.value[tab].route(x.view(np.uint64))]
            if out:
                tab, shard, x, node = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pd.DataFrame({"tab": tab.astype(np.int32), "shard": shard.astype(np.int32), "print": x, "node": node})

    def join(key, group):
        group = group.sort_values(["print", "node"])  # the shuffle's order must not choose the links
        runs = list(range(len(masks))) if key[1] == Shards.WHOLE else [key[1] % len(masks)]
        i, j, tree = run_links(group["print"].to_numpy(dtype=np.int64).view(np.uint64), radius, masks, runs)
        node = group["node"].to_numpy()
        return link_rows(key, node[i], node[j], node[tree])

    dealt = prints.select("tab", "print", "node").mapInPandas(deal, "tab int, shard int, print long, node long")
    return dealt.groupBy("tab", "shard").applyInPandas(join, LINK).where("a <> b")


LINK = "tab int, shard int, tree long, a long, b long"


def link_rows(key: tuple, a: np.ndarray, b: np.ndarray, tree: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"tab": np.int32(key[0]), "shard": np.int32(key[1]), "tree": tree, "a": np.minimum(a, b), "b": np.maximum(a, b)})


def classes(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its class.

    Alternates two contractions until every class is a star: each node's larger neighbours are tied to its smallest neighbour, then
    each node's smaller neighbours are. Each round is a written table, so lost executors repeat one round at most.
    """
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = materialise(both)
    while True:
        ends = now.select(F.col("u").alias("n"), F.lit(1).alias("below")).union(now.select("v", F.lit(0)))
        # in stars a node has one smaller neighbour and no other, or larger ones only
        crossed = ends.groupBy("n").agg(F.sum("below").alias("below"), F.count("*").alias("all")).where("below > 0 and all > 1")
        if not crossed.count():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        out = now.select("u", "v").union(now.select("v", "u")).toDF("n", "m")
        least = out.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("least"))
        large = out.join(least, "n").where("m > n").select(F.col("m").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        large = materialise(large)
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        tied = large.join(least, "u")
        now = materialise(tied.select(F.col("v").alias("u"), F.col("least").alias("v")).union(tied.select("u", "least")).where("u <> v").distinct())


# ---- the operator -------------------------------------------------------------------------------------------------


def as_longs(column: str) -> Column:
    """The 64-bit words of a fingerprint's bytes as an array of longs; the first bit is the sign."""
    return F.transform(F.sequence(F.lit(0), (F.length(column) / 8).cast("int") - 1), lambda i: word(F.substring(column, i * 8 + 1, F.lit(8))))


def word(part: Column) -> Column:
    text = F.hex(part)
    high, low = F.conv(F.substring(text, 1, 8), 16, 10).cast("long"), F.conv(F.substring(text, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def exact_classes(docs: DataFrame, id_col: str, text_col: str, *, words: int = 3, radius: int = 2, shard_rows: int = 4096) -> DataFrame:
    """id, fingerprint (hex of 64 bits) and component: the smallest id reachable over fingerprints within ``radius`` bits.

    One row per input row.

    * Null, empty and blank texts have fingerprint zero and are linked like any other. Fewer words than a shingle: one shingle.
    * Null ids stay null and are never smallest; a class of null ids only has a null component. Repeated rows stay rows.
    * Equal fingerprints are one node of the tree, however many documents share it. An empty table gives no rows.
    * Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = fingerprints(rows, "text", ["id"], words).select("id", word(F.col("print")).alias("print"))
    rows = materialise(rows)
    nodes = materialise(rows.groupBy("print").agg(F.min("id").alias("least")))
    edges = links(nodes.select(F.lit(0).alias("tab"), "print", F.col("print").alias("node")), radius, shard_rows=shard_rows)
    root = classes(edges)
    tied = nodes.join(root, F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    smallest = tied.groupBy("root").agg(F.min("least").alias("component"))
    owner = tied.select("print", "root").join(smallest, "root").select(F.col("print").alias("p"), "component")
    return rows.join(owner, F.col("print") == F.col("p")).select("id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component")


def bits_apart(similarity: float, bits: int) -> int:
    """Bits in which fingerprints of texts of this Jaccard similarity differ, with room for five deviations.

    Sets of equal size and similarity s have cosine 2s / (1 + s), and a bit differs with the angle's share of a half turn.
    Sets of few shingles differ in more bits than that, because an even count can be a tie.
    """
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * p + 5 * np.sqrt(bits * p * (1 - p)))


def short_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Candidates (a, b) among sets (node, shingles) so small that similar ones differ by one shingle on each side at most.

    A node's number is ``set_number`` of its shingles, so a set without one of its shingles is found by number. Sets that
    share such a rest are tied to the smallest of them where the rest makes them similar.
    """
    n = F.size("shingles")
    few = materialise(sets.where(n * (1 - similarity) < 2).select("node", "shingles"))
    small = few.where((n - 1) / F.greatest(n, F.lit(1)) >= similarity).select("node", "shingles", n.alias("n")).dropDuplicates(["node"])
    cut = materialise(small.select("node", "n", F.explode(F.transform("shingles", lambda s: set_number(F.array_remove("shingles", s)))).alias("rest")))
    whole = few.select(F.col("node").alias("b")).distinct()
    within = cut.join(whole, F.col("rest") == F.col("b")).select(F.col("node").alias("a"), "b")
    both = cut.where((F.col("n") - 1) / (F.col("n") + 1) >= similarity)
    least = both.groupBy("rest", "n").agg(F.min("node").alias("b"))
    beside = both.join(least, ["rest", "n"]).select(F.col("node").alias("a"), "b")
    return within.union(beside).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def set_number(shingles) -> Column:
    """64 bits of a sorted set of shingles."""
    return F.xxhash64(shingles)


def similar_classes(prints: DataFrame, similarity: float, *, times: int = 12, radius: int = 2, shard_rows: int = 32768,
                    sets: DataFrame | None = None) -> DataFrame:
    """(node, root) over wide fingerprints (print binary, node long) of texts of at least this similarity.

    A wide fingerprint is cut into pieces of 32 bits, each a table of ``links``; fingerprints within ``radius`` bits
    in some piece are candidates, and those within the bits the similarity allows overall are links. With 24 pieces a pair
    of similarity 0.8 is a candidate with probability 0.96, one of 0.85 with 0.995, one of 0.9 with 0.9999, and a class is
    found through any of its pairs; unrelated texts differ in half of all bits and never link.

    With ``sets`` (node, shingles: sorted array of long; rows may repeat) the bits only choose the candidates: what is within them is
    a link if the sets have the similarity, and small sets get their candidates from ``short_pairs`` as well. Only the sets of
    fingerprints that are within the bits are moved.

    A shard hands on one tree for fingerprints that hang together as candidates. Where a tree holds a candidate that is no link,
    two of its fingerprints may be linked without a path of links between them, so its members meet again in their shard, this
    time with all their bits: the classes are those of all candidates that are links.
    """
    whole = materialise(prints.select("node", as_longs("print").alias("bits")))
    n = whole.count()
    halves = F.flatten(F.transform("bits", lambda w: F.array(F.shiftrightunsigned(w, 32), w.bitwiseAND(F.lit(0xFFFFFFFF)))))
    pieces = whole.select("node", F.posexplode(halves).alias("tab", "print")).select("tab", "print", "node")
    found = materialise(links(pieces, radius, bits=32, shard_rows=shard_rows, sizes=dict.fromkeys(range(2 * times), n) if n else {}))
    left, right = whole.toDF("a", "x"), whole.toDF("b", "y")
    apart = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, n: total + n)
    most = bits_apart(similarity, 64 * times)
    seen = materialise(found.select("a", "b").distinct().join(left, "a").join(right, "b").select("a", "b", (apart <= most).alias("same")))

    def rejoin(key, group):
        group = group.sort_values("node")
        wide = np.frombuffer(b"".join(group["print"]), dtype=">u8").reshape(len(group), -1).astype(np.uint64)
        piece = wide[:, key[0] // 2] >> np.uint64(0 if key[0] % 2 else 32) & np.uint64(0xFFFFFFFF)
        i, j, tree = forest_links(piece, radius, wide, most)
        node = group["node"].to_numpy()
        return link_rows(key, node[i], node[j], node[tree])

    place = ["tab", "shard", "tree"]
    broken = found.join(seen.where("not same"), ["a", "b"], "left_semi").select(place).distinct()
    again = found.join(broken, place, "left_semi").select("tab", "shard", F.explode(F.array("a", "b")).alias("node")).distinct()
    again = again.join(prints.select("node", "print"), "node").groupBy("tab", "shard").applyInPandas(rejoin, LINK)
    if sets is None:
        return classes(seen.where("same").select("a", "b").union(again.select("a", "b")))
    within = materialise(found.join(broken, place, "left_anti").union(again.select(found.columns)))
    pairs = materialise(within.select("a", "b").union(short_pairs(sets, similarity)).distinct())
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    wide = materialise(sets.join(wanted, "node", "left_semi").select("node", "shingles").dropDuplicates(["node"]))
    both = pairs.join(wide.toDF("a", "x"), "a").join(wide.toDF("b", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    alike = common / F.greatest(F.lit(1), F.size("x") + F.size("y") - common) >= similarity
    sure = materialise(both.select("a", "b", alike.alias("same")))
    root = materialise(classes(sure.where("same")))
    # a tree with a pair that is no link is looked at again, unless its members are all in one class by other pairs
    parted = within.join(sure.where("not same"), ["a", "b"], "left_semi").select(place).distinct()
    members = within.join(parted, place, "left_semi").select(*place, F.explode(F.array("a", "b")).alias("node")).distinct()
    members = members.join(root, "node", "left").select(*place, "node", F.coalesce("root", "node").alias("root"))
    members = materialise(members)
    unsettled = members.groupBy(place).agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select(place)

    def confirm(group):
        group = group.sort_values([*place, "node"])
        bits = np.frombuffer(b"".join(group["print"]), dtype=">u8").reshape(len(group), -1).astype(np.uint64)
        tab, node, joined, shingles = group["tab"].to_numpy(), group["node"].to_numpy(), group["root"].to_numpy(), group["shingles"].tolist()
        starts = np.flatnonzero(~group.duplicated(place).to_numpy()).tolist()
        out = []
        for a, b in pairwise([*starts, len(group)]):
            piece = bits[a:b, tab[a] // 2] >> np.uint64(0 if tab[a] % 2 else 32) & np.uint64(0xFFFFFFFF)
            i, j, _ = forest_links(piece, radius, bits[a:b], most, shingles[a:b], similarity, joined[a:b])
            out.append(pd.DataFrame({"a": node[a + i], "b": node[a + j]}))
        return pd.concat(out)

    members = materialise(members.join(unsettled, place, "left_semi"))
    lots = -(-members.count() // LOT) or 1  # most trees have two or three members: several go to the workers at once
    members = members.withColumn("lot", F.pmod(F.xxhash64(*place), F.lit(lots))).join(prints.select("node", "print"), "node").join(wide, "node")
    more = materialise(members.groupBy("lot").applyInPandas(confirm, "a long, b long"))
    if more.isEmpty():
        return root
    return classes(root.toDF("a", "b").union(more))


def keep_one(docs: DataFrame, id_col: str, text_col: str, *, words: int = 5, similarity: float = 0.8, times: int = 12) -> DataFrame:
    """One row of each class of near-duplicates, with all its columns: the one of the smallest id.

    * Texts are near-duplicates if their sets of shingles of ``words`` words have a Jaccard similarity of ``similarity`` or more, or through
      others that are. Fingerprints of the sets find candidates; the sets themselves decide.
    * Texts without words are copies of each other. A null id is larger than any. Of rows with equal id the one of the smaller
      text hash stays, of equal rows one. An empty table stays empty; other columns are carried whatever their names.
    """
    key = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"), F.col(f"`{text_col}`").alias("text"))
    same = F.col("kept_id").eqNullSafe(F.col("id")) & (F.col("kept_h") == F.col("h"))
    with scratch(docs.sparkSession) as tables:  # the sets of shingles are as large as the texts; only the choice outlives the stage
        rows = materialise(shingle_sets(key, "text", ["id", "h"], words, times).withColumn("node", set_number(F.col("shingles"))))
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("first")
        nodes = materialise(rows.groupBy("print", "node").agg(first))
        root = similar_classes(nodes.select("print", "node"), similarity, times=times, sets=rows).toDF("n", "root")
        tied = nodes.select("node", "first").join(root, F.col("node") == F.col("n"), "left").select(F.coalesce("root", "node").alias("root"), "first")
        chosen = tables.keep(tied.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("kept_id"), F.col("first.h").alias("kept_h")))
        repeated = rows.join(chosen, same).groupBy("id", "h").count().where("count > 1").limit(1).count()
    names = docs.columns
    pair = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"))
    kept = pair.join(chosen, same, "left_semi")
    if repeated:
        kept = kept.dropDuplicates(["id", "h"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in names])
