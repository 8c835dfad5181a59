"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``order`` bytes with counts of the byte that follows. A text is scored by
the length of its code under each tree: a byte seen after the longest context costs -log2(n / (total + distinct)); otherwise
the escape costs -log2(distinct / (total + distinct)) and the next shorter context is asked, down to eight bits for a byte
never seen. Statistics are frozen, so the cost of a byte depends on it and the ``order`` bytes before it alone, and whole
batches are scored by table look-ups. The language with the shortest code wins.

Trees are counted by Spark on a bounded sample: about ``sample_docs`` whole texts of each language, chosen by a hash
of their ids, and of the most frequent nodes of each language, whose equal share of ``max_nodes`` no other language can take.
Everything else is scored in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from contrapair.llm.common import Index, map_texts, slices, unit_hash
from contrapair.session import materialise, scratch

UNDECIDED = "und"
WINDOW = 1 << 18  # bytes scored at a time


class Trees:
    """Code lengths of bytes in their contexts under the trees of all languages.

    ``counts[m]`` are (language, gram, n) arrays of the grams of m + 1 bytes: m bytes of context and the byte that follows.
    """

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], shares: list[float]):
        self.langs, self.order = langs, len(counts) - 1
        self.prior = -np.log2(np.asarray(shares, dtype=np.float64))
        self.grams: list[Index] = []
        self.costs: list[np.ndarray] = []
        self.contexts: list[Index] = []
        self.escapes: list[np.ndarray] = []
        for lang, gram, n in counts:
            shape = len(langs)
            contexts, place = np.unique(gram >> 8, return_inverse=True)
            total, distinct = np.zeros((len(contexts), shape)), np.zeros((len(contexts), shape))
            np.add.at(total, (place, lang), n)
            np.add.at(distinct, (place, lang), 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(distinct > 0, -np.log2(distinct / (total + distinct)), 0.0)
            known = np.unique(gram)
            row = np.searchsorted(known, gram)
            below = self.cost(len(self.grams) - 1, known & self._mask(len(self.grams)))
            cost = escape[np.searchsorted(contexts, known >> 8)] + below if len(known) else np.zeros((0, shape))
            cost[row, lang] = -np.log2(n / (total + distinct)[place, lang])
            self.grams.append(Index(known))
            self.costs.append(cost.astype(np.float32))
            self.contexts.append(Index(contexts))
            self.escapes.append(escape.astype(np.float32))

    @staticmethod
    def _mask(m: int) -> int:
        return (1 << 8 * m) - 1

    def cost(self, m: int, gram: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram of m + 1 bytes after its first m, for each language."""
        if m < 0:
            return np.full((len(gram), len(self.langs)), 8.0, dtype=np.float32)
        at = self.grams[m].find(gram)
        out = self.costs[m][at] if len(self.costs[m]) else np.zeros((len(gram), len(self.langs)), dtype=np.float32)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            g = gram[miss]
            c = self.contexts[m].find(g >> 8)
            escape = np.where((c >= 0)[:, None], self.escapes[m][c], np.float32(0)) if len(self.escapes[m]) else np.float32(0)
            out[miss] = escape + self.cost(m - 1, g & self._mask(m))
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text under each language's tree."""
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        out = np.zeros((len(texts), len(self.langs)))
        filled = np.flatnonzero(ends > starts)
        for a in range(0, len(data), WINDOW):
            b = min(len(data), a + WINDOW)
            first = max(0, a - self.order)
            part = data[first:b].astype(np.int64)
            gram = part.copy()
            for back in range(1, self.order + 1):
                gram[back:] |= part[:-back] << 8 * back
            gram = gram[a - first:]
            inside = filled[(ends[filled] > a) & (starts[filled] < b)]
            cuts = np.maximum(starts[inside], a) - a
            bits = self.cost(self.order, gram)
            for m in range(self.order):  # a text's first bytes have fewer before them
                young = starts[inside] + m
                young = young[(young >= a) & (young < np.minimum(ends[inside], b))] - a
                bits[young] = self.cost(m, gram[young] & self._mask(m + 1))
            out[inside] += np.add.reduceat(bits, cuts, axis=0, dtype=np.float64)
        return out


def folded(text: str | None) -> bytes:
    return (text or "").lower().encode()


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, may_learn: Column, *, order: int = 3, sample_docs: int = 1500,
          max_nodes: int = 400_000) -> Trees | None:
    """Trees of all languages named in rows that may be learnt from; None where there are none.

    The names of languages come to the driver: they are taken to be few. Each language keeps its most frequent nodes, of equal
    counts all or none, within ``max_nodes`` divided by the number of languages; its nodes without context always stay.
    """
    usable = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    usable = usable.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return None
    share = F.coalesce(*[F.when(F.col("lang") == name, F.lit(min(1.0, sample_docs / n))) for name, n in sizes.items()])
    sample = usable.where(unit_hash("id") < share).select("lang", "text")

    def tally(batches):
        for batch in batches:
            for part in slices(batch, 512, 4 << 20):
                names = part.column(0).to_pylist()
                for lang in sorted(set(names)):
                    texts = [folded(t) for t, name in zip(part.column(1).to_pylist(), names, strict=True) if name == lang]
                    for m in range(order + 1):
                        grams = []
                        for t in texts:
                            x = np.frombuffer(t, dtype=np.uint8).astype(np.int64)
                            if len(x) > m:
                                g = x[m:].copy()
                                for back in range(1, m + 1):
                                    g |= x[m - back:-back] << 8 * back
                                grams.append(g)
                        if grams:
                            gram, n = np.unique(np.concatenate(grams), return_counts=True)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([lang] * len(gram)), pa.array([m] * len(gram), type=pa.int64()), pa.array(gram), pa.array(n)],
                                names=["lang", "m", "gram", "n"])

    kinds = StructType([StructField("lang", StringType()), *[StructField(c, LongType()) for c in ("m", "gram", "n")]])
    nodes = sample.mapInArrow(tally, kinds).groupBy("lang", "m", "gram").agg(F.sum("n").alias("n"))
    with scratch(docs.sparkSession):
        nodes = materialise(nodes)
        # a context is at least as frequent as what follows it, so the most frequent nodes of a language form a tree
        held = nodes.groupBy("lang", "n").agg(F.count("*").alias("nodes"))
        down = Window.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)  # a row for each distinct count
        least = held.withColumn("total", F.sum("nodes").over(down)).where(F.col("total") <= max_nodes // len(langs))
        least = least.groupBy("lang").agg(F.min("n").alias("least"))
        kept = nodes.join(least, "lang", "left").where("m = 0 or n >= least").select("lang", "m", "gram", "n").toPandas()
    place = kept["lang"].map({name: i for i, name in enumerate(langs)}).to_numpy(dtype=np.int64)
    counts = []
    for m in range(order + 1):
        at = (kept["m"] == m).to_numpy()
        counts.append((place[at], kept["gram"].to_numpy(dtype=np.int64)[at], kept["n"].to_numpy(dtype=np.float64)[at]))
    total = sum(sizes.values())
    return Trees(langs, counts, [sizes[name] / total for name in langs])


def identify(docs: DataFrame, text_col: str, carry: list[str], trees: Trees | None) -> DataFrame:
    """The columns ``carry`` with lang_pred, score (its share of all languages' probabilities) and bits_per_byte.

    * A null text, an empty one, and one without a letter get ``und`` and score 0, as does every text if nothing was learnt.
    * Equal code lengths go to the language that comes first by name. Whole texts of any length are scored piece by piece.
    * Null and repeated ids are carried as they are; columns that are not carried are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by max_nodes

    def start():
        model: Trees | None = shared.value

        def score(texts: list) -> dict:
            lettered = [bool(t) and any(map(str.isalpha, t)) for t in texts]
            pred, share, rate = [UNDECIDED] * len(texts), [0.0] * len(texts), [None] * len(texts)
            at = [i for i, ok in enumerate(lettered) if ok and model is not None]
            if at:
                data = [folded(texts[i]) for i in at]
                bits = model.lengths(data)
                whole = bits + model.prior
                best = whole.argmin(axis=1)
                odds = np.exp2(np.maximum(whole.min(axis=1, keepdims=True) - whole, -1000.0)).sum(axis=1)
                for row, i in enumerate(at):
                    pred[i], share[i] = model.langs[best[row]], float(1.0 / odds[row])
                    rate[i] = float(bits[row, best[row]] / len(data[row]))
            return {"lang_pred": pred, "score": share, "bits_per_byte": rate}

        return score

    return map_texts(docs, text_col, carry, {"lang_pred": "string", "score": "double", "bits_per_byte": "double"}, start, size=2 << 20)
