"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into bins. Shallow trees are boosted cyclically, one feature after another, with small steps; all
trees of a feature add up to one look-up table over its bins. Pairs of features that explain most of what is left get
tables of their own in the same way. A score is the logistic of the sum of a few table entries, found for whole batches.

The model is fitted on a bounded sample of labelled rows: at most about ``sample_rows``, chosen by a hash of their ids, of
which only the features (a few numbers each) come to the driver. Features and scores cover every whole text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrapair.llm.common import map_texts, unit_hash

#: Byte classes whose shares are features.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "blank": b" \t\r\v\f", "newline": b"\n",
    "stop": b".?", "comma": b",;:", "shout": b"!", "bar": b"|", "hash": b"#*", "money": b"$%&", "bracket": b"()[]{}", "markup": b"<>/\\=_@~^`+", "quote": b"\"'-",
    "control": bytes([*range(9), *range(14, 32), 127]), "wide": bytes(range(128, 256)),
}
WHOLE = ("log_bytes", "log_words", "word_length", "longest_word", "distinct_words", "top_word", "distinct_pairs", "short_words", "marked_words",
         "log_lines", "distinct_lines", "words_a_line", "ended_lines", "entropy")
FEATURES = (*CLASSES, *WHOLE)
#: Bytes of text whose words are counted at a time.
TEXTS = 2 << 20
_SHARE = np.array([[c in members for c in range(256)] for members in CLASSES.values()], dtype=np.float64).T


def features(texts: list) -> np.ndarray:
    """A row for each whole text, in the order of FEATURES; all zero for a text without bytes."""
    data = [(t or "").encode() for t in texts]
    out = np.zeros((len(data), len(FEATURES)))
    at = len(CLASSES)
    n = word_features(texts, out[:, at + 2:at + 9])
    for row, text in enumerate(data):
        if not text:
            continue
        share = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) / len(text)
        some = share[share > 0]
        out[row, :at] = share @ _SHARE
        out[row, at:at + 2] = np.log1p(len(text)), np.log1p(n[row])
        out[row, -1] = -(some * np.log2(some)).sum()
        if n[row]:
            lines = [x for x in text.split(b"\n") if x.strip()]
            m = len(lines)
            ended = sum(x.rstrip()[-1:] in (b".", b"?", b"!") for x in lines)
            out[row, -5:-1] = np.log1p(m), len(set(lines)) / m, n[row] / m, ended / m
    return out


def word_features(texts: list, out: np.ndarray) -> np.ndarray:
    """Fills in the features of words, for all texts at once, and returns how many words each has."""
    parts = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
    row, words = pc.list_parent_indices(parts), parts.flatten()
    filled = pc.greater(pc.binary_length(words), 0)  # a blank at an end splits off an empty word
    row, words = row.filter(filled).to_numpy(), words.filter(filled).dictionary_encode()
    code, kinds = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
    length = pc.binary_length(words.dictionary).to_numpy()[code]
    marked = pc.match_substring_regex(words.dictionary, r"[!#*$%&|]$").to_numpy(zero_copy_only=False)[code]
    n = np.bincount(row, minlength=len(texts))
    some = np.flatnonzero(n)
    if not len(some):
        return n
    word, times = np.unique(row * kinds + code, return_counts=True)
    pair = np.sort(((row * kinds + code)[:-1] * kinds + code[1:])[row[:-1] == row[1:]])
    pair = pair[np.diff(pair, prepend=-1) > 0]

    def total(rows: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(rows, weights, len(texts))[some]

    longest = np.maximum.reduceat(length, np.searchsorted(row, some))
    top = np.maximum.reduceat(times, np.searchsorted(word // kinds, some))
    count = n[some]
    out[some] = np.stack([total(row, length) / count, np.log1p(longest), total(word // kinds) / count, top / count,
                          total(pair // kinds ** 2) / np.maximum(1, count - 1), total(row, length <= 3) / count, total(row, marked) / count], axis=1)
    return n


def feature_table(docs: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """The columns ``carry`` with ``features``, an array of numbers in the order of FEATURES."""

    def start():
        return lambda texts: {"features": list(features(texts))}

    return map_texts(docs, text_col, carry, {"features": "array<double>"}, start, size=TEXTS)


class Gam:
    """Look-up tables over binned features and pairs of features."""

    def __init__(self, base: float, edges: list[np.ndarray], tables: list[np.ndarray], pairs: dict[tuple[int, int], np.ndarray]):
        self.base, self.edges, self.tables, self.pairs = base, edges, tables, pairs

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[at[:, j]]
        for (i, j), table in self.pairs.items():
            total += table[at[:, i], at[:, j]]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -50, 50)))


def _stump(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> np.ndarray | None:
    """Steps of the best tree of one cut over a feature's bins: a value for each bin."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gt, ht = g.sum(), h.sum()
    gain = gl ** 2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt ** 2 / (ht + ridge)
    gain = np.where((hl >= least) & (ht - hl >= least), gain, -np.inf)
    if not len(gain) or gain.max() <= 1e-12:
        return None
    cut = int(gain.argmax())
    return np.where(np.arange(len(g)) <= cut, gl[cut] / (hl[cut] + ridge), (gt - gl[cut]) / (ht - hl[cut] + ridge))


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """Gain and steps of the best tree of one cut on each of two features, from sums over pairs of bins."""
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = []
    for c in (cg, ch):
        inner, right, down, whole = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        parts.append((inner, right - inner, down - inner, whole - right - down + inner))
    gain = sum(np.where(b >= least, a ** 2 / (b + ridge), 0.0) for a, b in zip(*parts, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    v = [float(a[i, j] / (b[i, j] + ridge)) if b[i, j] >= least else 0.0 for a, b in zip(*parts, strict=True)]
    row, col = np.arange(g.shape[0])[:, None] <= i, np.arange(g.shape[1])[None, :] <= j
    return float(gain[i, j]), np.where(row, np.where(col, v[0], v[1]), np.where(col, v[2], v[3]))


def fit(x: np.ndarray, y: np.ndarray, *, max_bins: int = 32, rounds: int = 150, pair_rounds: int = 50, pairs: int = 8, rate: float = 0.1,
        ridge: float = 1.0, least: float = 1.0) -> Gam:
    """Boost the tables on rows of features and labels between 0 and 1. Without rows every score is one half."""
    width = x.shape[1]
    if not len(x):
        return Gam(0.0, [np.zeros(0)] * width, [np.zeros(1)] * width, {})
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, max_bins) / max_bins, method="lower")) for j in range(width)]
    edges = [e[e < x[:, j].max()] for j, e in enumerate(edges)]
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Gam(float(np.log(mean / (1 - mean))), edges, [np.zeros(len(e) + 1) for e in edges], {})
    at, total = model.bins(x), np.full(len(x), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(width):
            g, h = slopes()
            n = len(edges[j]) + 1
            step = _stump(np.bincount(at[:, j], g, n), np.bincount(at[:, j], h, n), ridge, least)
            if step is not None:
                model.tables[j] += rate * step
                total += rate * step[at[:, j]]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        shape = (len(edges[i]) + 1, len(edges[j]) + 1)
        key = at[:, i] * shape[1] + at[:, j]
        return tuple(np.bincount(key, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    gains = {(i, j): _quadrants(*sums(i, j), ridge, least)[0] for i in range(width) for j in range(i + 1, width)}
    chosen = sorted(gains, key=lambda ij: (-gains[ij], ij))[:pairs]
    model.pairs = {ij: np.zeros((len(edges[ij[0]]) + 1, len(edges[ij[1]]) + 1)) for ij in chosen if gains[ij] > 1e-12}
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            gain, step = _quadrants(*sums(i, j), ridge, least)
            if gain > 1e-12:
                table += rate * step
                total += rate * step[at[:, i], at[:, j]]
    return model


def learn(table: DataFrame, labels: DataFrame, id_col: str, label_col: str, may_learn: Column, *, sample_rows: int = 20_000) -> Gam:
    """Fit on rows of a feature table that have a label and may be learnt from.

    Labels of an id given several times are averaged; null labels and ids are left out.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("label_id"), F.col(label_col).alias("label"))
    known = known.groupBy("label_id").agg(F.avg("label").alias("label"))
    rows = table.where(may_learn).join(known, F.col(id_col) == F.col("label_id")).select("label_id", "features", "label")
    n = rows.count()
    sample = rows.where(unit_hash("label_id") < min(1.0, sample_rows / max(1, n))).orderBy("label_id", "features").limit(2 * sample_rows).toPandas()
    x = np.stack(sample["features"]) if len(sample) else np.zeros((0, len(FEATURES)))
    return fit(x, np.clip(sample["label"].to_numpy(dtype=np.float64), 0.0, 1.0))


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, may_learn: Column, *,
                   sample_rows: int = 20_000) -> DataFrame:
    """Id and text of about ``sample_rows`` rows that have a label and may be learnt from, so that features are made for these alone.

    Ids are counted first without their texts; then a hash of the id decides which texts are read.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("label_id")).distinct()
    rows = docs.where(may_learn).select(id_col, text_col)
    labelled = F.col(id_col) == F.col("label_id")
    n = rows.select(id_col).join(known, labelled, "left_semi").count()
    return rows.where(unit_hash(id_col) < min(1.0, sample_rows / max(1, n))).join(known, labelled, "left_semi")


def score_texts(docs: DataFrame, text_col: str, carry: list[str], model: Gam) -> DataFrame:
    """The columns ``carry`` with ``score`` and ``predicted`` as ``score`` gives them, in one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def start():
        gam: Gam = shared.value
        return lambda texts: {"score": gam.score(features(texts))}

    return map_texts(docs, text_col, carry, {"score": "double"}, start, size=TEXTS).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score(table: DataFrame, model: Gam) -> DataFrame:
    """The feature table's other columns with ``score``, the probability of label 1, and ``predicted`` (1 if it is 0.5 or more).

    * Null, empty and blank texts have features (zeros) and so a score like any other. Null ids are carried.
    """
    shared = table.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    @F.pandas_udf("double")
    def apply(column: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.stack(column)) if len(column) else np.zeros(0))

    return table.withColumn("score", apply("features")).drop("features").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
