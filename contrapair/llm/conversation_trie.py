"""Conversation prefix trie by a splitter skeleton.

A conversation is a path of turns, and its prefixes are nodes of a trie. Paths are sorted over the cluster: a bounded sample
gives splitters, and each shard takes the paths between two of them. Members of a node are neighbours in this order, so a node
whose members lie in two shards is a prefix of the splitter between them. Hence:

* the *skeleton*, the trie of all splitter paths, is broadcast; it is bounded by ``SPLITTERS`` and ``SKELETON_BYTES``;
* every other node lies whole in one shard, which finishes it with one pass over its sorted paths and a stack as deep as a path;
* for nodes of the skeleton a shard emits partial aggregates, which a reduction adds up; what they owe to one another is then
  worked out on the skeleton alone.

A path is a string of bytes with ``WIDTH`` of them a turn: 16 of a digest of role and text, 4 with the words of the text.
Splitters are pairs of a path and a conversation id, so that any number of equal conversations is dealt over several shards.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrapair.llm.common import WORD
from contrapair.session import materialise

DIGEST, WIDTH = 16, 20
#: Most splitters, sampled paths a splitter, and bytes of all splitter paths; these bound the skeleton and steer balance only.
SPLITTERS, SAMPLED, SKELETON_BYTES = 4096, 8, 8 << 20
#: Turns that a shard is meant to hold at most; there is a shard for each shuffle partition at least.
SHARD_TURNS = 200_000
#: Ids of members that one row of a skeleton node's end carries.
ENDS_A_ROW = 4096

_NO_ENDS = hashlib.sha256(b"").hexdigest()
_OUT = ("kind int, node int, conv_id long, depth long, parent_conv_id long, parent int, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string, shard int, place long, ends string")
_ARROW = pa.schema([("kind", pa.int32()), ("node", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
                    ("parent", pa.int32()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
                    ("ends_sha256", pa.string()), ("shard", pa.int32()), ("place", pa.int64()), ("ends", pa.string())])
LOCAL, PARTIAL, ENDS = 0, 1, 2


def step(role: Column, text: Column) -> Column:
    """A turn's part of a path, in hexadecimal."""
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    words = F.regexp_count(text, F.lit(WORD))
    return F.concat(F.substring(digest, 1, 2 * DIGEST), F.lpad(F.hex(words.cast("long")), 2 * (WIDTH - DIGEST), "0"))


def conversations(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(id, steps): each conversation's turns in order, as parts of a path. Only digests are shuffled."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    x = turns.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("id"), F.struct(F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), step(role, text).alias("step")).alias("t"))
    return x.groupBy("id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["step"]).alias("steps"))


def rebuilt(own: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """(id, path): the first h turns of conversation id - id % every, then the own turns after the first h; h = crc32(id) % heads."""
    base = own.where(F.col("id") % every == 0).select(F.col("id").alias("base"), F.slice("steps", 1, heads - 1).alias("head"))
    x = own.withColumn("base", F.col("id") - F.col("id") % every).join(base, "base", "left")
    h = (F.crc32(F.col("id").cast("string").cast("binary")) % heads).cast("int")
    head = F.when(F.col("head").isNull() | (h == 0), F.array().cast("array<string>")).otherwise(F.slice("head", F.lit(1), F.greatest(h, F.lit(1))))
    rest = F.slice("steps", h + 1, F.greatest(F.size("steps") - h, F.lit(0)))
    return x.select("id", F.unhex(F.array_join(F.concat(head, rest), "")).alias("path"))


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with in common."""
    most = min(len(a), len(b)) // WIDTH
    lo, hi = 0, most
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo * WIDTH:mid * WIDTH] == b[lo * WIDTH:mid * WIDTH]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def splitters(paths: DataFrame, shard_turns: int | None = None) -> list[tuple[bytes, int]]:
    """Ordered (path, id) pairs that cut the sorted paths into shards of about as many turns.

    A splitter's path ends with the first turn that tells it from the sampled path before it, unless both are equal.
    """
    tasks = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = paths.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("path") / WIDTH + 1).alias("turns")).first()
    n, turns = size["n"], size["turns"] or 0
    wanted = min(SPLITTERS, n // SAMPLED, int(turns // shard_turns) if shard_turns else max(tasks, int(turns // SHARD_TURNS)))
    if wanted < 1:
        return []
    share = min(0.5, wanted * SAMPLED / n)
    hashed = F.pmod(F.xxhash64("id", F.lit("splitter")), F.lit(1 << 31)) < F.lit(int(share * (1 << 31)))
    # a long path's end is left out of the sample, which moves a splitter but breaks no order
    rows = paths.where(hashed).select(F.substring("path", 1, WIDTH * 512).alias("path"), "id", (F.length("path") / WIDTH + 1).alias("w")).limit(2 * SPLITTERS * SAMPLED).collect()
    sample = sorted((bytes(r["path"]), r["id"], r["w"]) for r in rows)
    total, done, out, held = sum(s[2] for s in sample), 0.0, [], 0
    for before, (path, at, w) in zip([None, *sample], sample):
        if before and done >= total * (len(out) + 1) / (wanted + 1):
            cut = path[:(shared_turns(before[0], path) + 1) * WIDTH]
            one = (path, at) if before[0] == path else (cut, -(1 << 63))
            held += len(one[0])
            if held > SKELETON_BYTES:
                break
            if not out or one > out[-1]:
                out.append(one)
        done += w
    return out


class Skeleton:
    """The trie of splitter paths: nodes numbered from the root, each with its parent, depth and the words of its last text."""

    def __init__(self, cuts: list[tuple[bytes, int]]):
        self.cuts = cuts
        self.children: list[dict[bytes, int]] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.words: list[int] = []
        self._add(-1, 0, 0)
        for path, _ in cuts:
            at = 0
            for i in range(0, len(path), WIDTH):
                key = path[i:i + WIDTH]
                if key not in self.children[at]:
                    self.children[at][key] = self._add(at, self.depth[at] + 1, words_of(key))
                at = self.children[at][key]

    def _add(self, parent: int, depth: int, words: int) -> int:
        self.children.append({})
        self.parent.append(parent)
        self.depth.append(depth)
        self.words.append(words)
        return len(self.parent) - 1

    def shard(self, path: bytes, at: int) -> int:
        return bisect.bisect_right(self.cuts, (path, at))


def words_of(key: bytes) -> int:
    return struct.unpack(">I", key[DIGEST:])[0]


class _Node:
    """A node on the stack of a shard's pass."""

    __slots__ = ("key", "depth", "skeleton", "least", "members", "children", "leaves", "saved", "ends", "hash", "waiting", "place")

    def __init__(self, key: bytes, depth: int, skeleton: int):
        self.key, self.depth, self.skeleton = key, depth, skeleton
        self.least, self.members, self.children, self.leaves, self.saved, self.place = None, 0, 0, 0, 0, 0
        self.ends: list[str] = []  # of a skeleton node: ids not yet handed on
        self.hash = None  # of another: of the ids so far
        self.waiting: list[tuple] = []  # finished children that wait for this node's smallest member


class Shard:
    """One pass over a shard's sorted (path, id) rows; ``rows`` collects what is finished."""

    def __init__(self, skeleton: Skeleton, number: int, rows: list[tuple]):
        self.skeleton, self.number, self.rows = skeleton, number, rows
        self.stack = [_Node(b"", 0, 0)]
        self.before = b""

    def add(self, path: bytes, at: int) -> None:
        same = shared_turns(self.before, path)
        while len(self.stack) > same + 1:
            self.close()
        for i in range(same * WIDTH, len(path), WIDTH):
            key, above = path[i:i + WIDTH], self.stack[-1].skeleton
            inner = self.skeleton.children[above].get(key, -1) if above >= 0 else -1
            self.stack.append(_Node(key, len(self.stack), inner))
        top = self.stack[-1]
        top.members += 1
        top.least = at if top.least is None else min(top.least, at)
        if top.skeleton >= 0:
            top.ends.append(str(at))
            if len(top.ends) >= ENDS_A_ROW:
                self.hand_on(top)
        elif top.hash is None:
            top.hash = hashlib.sha256(str(at).encode())
        else:
            top.hash.update(b"," + str(at).encode())
        self.before = path

    def hand_on(self, node: _Node) -> None:
        if node.ends:
            self.rows.append((ENDS, node.skeleton, *[None] * 9, self.number, node.place, ",".join(node.ends)))
            node.place += 1
            node.ends = []

    def close(self) -> None:
        node = self.stack.pop()
        above = self.stack[-1] if self.stack else None
        for conv, depth, members, children, leaves, saved, ends in node.waiting:
            self.rows.append((LOCAL, None, conv, depth, node.least, None, members, children, leaves, saved, ends, None, None, None))
        if node.skeleton >= 0:
            self.hand_on(node)
            self.rows.append((PARTIAL, node.skeleton, node.least, None, None, None, node.members, node.children, node.leaves, node.saved, None, None, None, None))
        else:
            node.leaves = node.leaves or 1
            node.saved += (node.members - 1) * words_of(node.key)
            ends = node.hash.hexdigest() if node.hash else _NO_ENDS
            above.children += 1
            if above.skeleton >= 0:
                self.rows.append((LOCAL, None, node.least, node.depth, None, above.skeleton, node.members, node.children, node.leaves, node.saved, ends, None, None, None))
            else:
                above.waiting.append((node.least, node.depth, node.members, node.children, node.leaves, node.saved, ends))
        if above:
            above.members += node.members
            above.least = node.least if above.least is None else min(above.least, node.least)
            if node.skeleton < 0:  # what skeleton nodes owe their parents is settled once, by reduced()
                above.leaves += node.leaves
                above.saved += node.saved

    def finish(self) -> None:
        while self.stack:
            self.close()


def dealt(paths: DataFrame, skeleton: Skeleton) -> DataFrame:
    """Paths with the number of their shard, each shard in one partition and in order."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = [skeleton.shard(p, i) for p, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shards, type=pa.int32()), batch.column(0), batch.column(1)], names=["shard", "path", "id"])

    x = paths.select("path", "id").mapInArrow(number, "shard int, path binary, id long")
    return x.repartition("shard").sortWithinPartitions("shard", "path", "id")


def passes(sorted_paths: DataFrame, skeleton: Skeleton) -> DataFrame:
    """What the shards finish (LOCAL), their shares of skeleton nodes (PARTIAL) and the ids that end at those (ENDS)."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        shard = None
        for batch in batches:
            for number, path, at in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if shard is None or shard.number != number:
                    if shard:
                        shard.finish()
                    shard = Shard(skeleton, number, rows)
                shard.add(path, at)
                if len(rows) >= 8192:
                    yield packed(rows)
                    rows.clear()
        if shard:
            shard.finish()
        for i in range(0, len(rows), 8192):
            yield packed(rows[i:i + 8192])

    return sorted_paths.mapInArrow(run, _OUT)


def end_hashes(found: DataFrame) -> DataFrame:
    """(node, ends_sha256) of skeleton nodes: ids in shard order, hashed as they come, so any number of them fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[int] = []
        hashes: list = []
        for batch in batches:
            for node, ends in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if nodes and nodes[-1] == node:
                    hashes[-1].update(b"," + ends.encode())
                else:
                    nodes.append(node)
                    hashes.append(hashlib.sha256(ends.encode()))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, type=pa.int32()), pa.array([h.hexdigest() for h in hashes], type=pa.string())], names=["node", "hash"])

    x = found.where(F.col("kind") == ENDS).select("node", "shard", "place", "ends").repartition("node").sortWithinPartitions("node", "shard", "place")
    return x.mapInArrow(run, "node int, hash string")


def reduced(found: DataFrame, skeleton: Skeleton) -> DataFrame:
    """(node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) of the skeleton's nodes.

    Shards' shares are added up; then the few nodes of the skeleton pass what they owe from child to parent. No more rows
    reach the driver than the skeleton it made has nodes.
    """
    sums = found.where(F.col("kind") == PARTIAL).groupBy("node").agg(
        F.min("conv_id").alias("least"), F.sum("n_convs").alias("members"), F.sum("n_children").alias("children"), F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved"))
    by = {r["node"]: [r["least"], r["members"], r["children"], r["leaves"], r["saved"]] for r in sums.collect()}
    for node in range(len(skeleton.parent) - 1, -1, -1):  # children have higher numbers than their parents
        if node in by:
            at, above = by[node], by.get(skeleton.parent[node])
            at[3] = at[3] or 1
            at[4] += (at[1] - 1) * skeleton.words[node]
            if above:
                above[2] += 1
                above[3] += at[3]
                above[4] += at[4]
    rows = [(n, v[0], skeleton.depth[n], by[skeleton.parent[n]][0] if n else None, *v[1:]) for n, v in by.items()]
    return found.sparkSession.createDataFrame(rows, "node int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                *, shard_turns: int | None = None) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, with the columns of the contract.

    * A null role or text is an empty one. Rows without a conversation id belong to no conversation and take no part.
    * Turns are ordered by number, null first; rows of one number by role and then by the digest of role and text, repeated
      rows being turns of their own.
    * Negative ids: ``id % 20`` has the sign of the id, so the base is the next multiple of 20 towards zero.
    * Without conversations there is no node, not even a root. Other columns take no part, whatever their names.
    * Texts are read whole and may have any length; only digests are shuffled. A conversation is one path, 20 bytes a turn,
      and has to fit a task; equal conversations may be any number.
    """
    paths = materialise(rebuilt(materialise(conversations(turns, conv_col, turn_col, role_col, text_col))))
    skeleton = Skeleton(splitters(paths, shard_turns))
    found = materialise(passes(dealt(paths, skeleton), skeleton))
    inner = reduced(found, skeleton)
    names = F.broadcast(inner.select(F.col("node").alias("parent"), F.col("conv_id").alias("above")))
    local = found.where(F.col("kind") == LOCAL).join(names, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    ended = inner.join(end_hashes(found), "node", "left").withColumn("ends_sha256", F.coalesce("hash", F.lit(_NO_ENDS)))
    return local.select(COLUMNS).unionByName(ended.select(COLUMNS))
