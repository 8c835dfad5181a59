"""Token counts of documents under a unigram vocabulary, by dynamic programming over a trie.

The distinct pre-tokens of a task's documents are inserted into one trie. A node stands for a prefix and keeps its forward
score, the best segmentation of that prefix, computed once from its ancestors however many words share it. The number of
tokens of a word is stored at its terminal node, and a document's count is the sum over its pre-tokens.

Nothing is shuffled: a word's count is the same in every task, and a trie costs less than sending words around. A task
forgets its counts when they pass ``max_words``, which bounds memory and changes no result.
"""

from __future__ import annotations

import base64
import math
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame

from contrapair.llm.common import Index, map_texts
from contrapair.llm.pretokens import Splitter


def rank_scores(path: str) -> dict[bytes, float]:
    """Unigram log-probabilities for a ranked vocabulary file (base64 token and rank per line): Zipf's law over the ranks."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    norm = math.log(sum(1.0 / (r + 1) for r in ranks.values()))
    return {token: -math.log(r + 1) - norm for token, r in ranks.items()}


class Pieces:
    """A vocabulary as a trie of bytes, with the scores of its pieces."""

    def __init__(self, scores: dict[bytes, float], unknown: float = -30.0):
        step: dict[int, int] = {}
        gains = [-np.inf]
        for piece, score in scores.items():
            at = 0
            for byte in piece:
                to = step.get(at << 8 | byte)
                if to is None:
                    to = step[at << 8 | byte] = len(gains)
                    gains.append(-np.inf)
                at = to
            gains[at] = score
        self.steps, self.targets = Index(np.array(list(step), dtype=np.int64)), np.array([*step.values(), -1], dtype=np.int64)
        self.gains = np.array([*gains, -np.inf])  # place -1 is no piece
        self.unknown, self.longest = unknown, max(map(len, scores), default=1)

    def token_counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of the best segmentation of each word; of equal scores the one with fewer tokens is best.

        The words form a trie, built level by level: the nodes of a level are its distinct (parent, byte) pairs. A node keeps the
        scores of the prefixes on its path and the pieces begun on it, so its own score is found once for all words below.
        """
        count = np.zeros(len(words), dtype=np.int64)
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        live, width = np.flatnonzero(length > 0), int(length.max(initial=0))
        node = np.zeros(len(words), dtype=np.int64)
        data, starts = np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum(length) - length
        score, tokens = np.zeros((1, 1)), np.zeros((1, 1), dtype=np.int64)
        begun = np.zeros((1, 0), dtype=np.int64)
        for depth in range(width):
            step, of = np.unique(node[live] << 8 | data[starts[live] + depth], return_inverse=True)
            parent, byte = step >> 8, step & 255
            piece = np.concatenate([begun[parent], np.zeros((len(step), 1), dtype=np.int64)], axis=1)[:, -self.longest:]
            open_ = piece >= 0
            found = self.steps.find((piece << 8 | byte[:, None])[open_])
            piece[open_] = self.targets[found]
            score, tokens = score[parent], tokens[parent]
            gain = self.gains[piece]
            gain[:, -1] = np.where(np.isinf(gain[:, -1]), self.unknown, gain[:, -1])
            total = score + gain
            best = total.max(axis=1, keepdims=True)
            fewest = np.where(total == best, tokens + 1, np.iinfo(np.int64).max).min(axis=1, keepdims=True)
            # what no piece can reach back to any more is let go
            score, tokens = (np.concatenate(x, axis=1)[:, -self.longest:] for x in ((score, best), (tokens, fewest)))
            begun, node[live] = piece, of
            ended = live[length[live] == depth + 1]
            count[ended] = fewest[node[ended], 0]
            live = live[length[live] > depth + 1]
        return count


def token_counts(docs: DataFrame, text_col: str, carry: list[str], scores: dict[bytes, float], *, max_words: int = 1_000_000) -> DataFrame:
    """The columns ``carry`` with n_tokens and n_words (pre-tokens) of the whole text.

    * A null text counts as empty, an empty text has no tokens; null and repeated ids are carried as they are.
    * A pre-token of any length is one path of the trie; its cost is linear in its length.
    * An empty table gives no rows. Columns that are not carried are not looked at, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scores)  # a vocabulary file: fixed size

    def start():
        split, pieces = Splitter(), Pieces(shared.value)
        known: dict[str, int] = {}  # stored terminal counts
        spaced: dict[str, tuple[int, int]] = {}  # tokens and pre-tokens of a segment with the space before it

        def count(texts: list) -> dict:
            if len(known) + len(spaced) > max_words:
                known.clear()
                spaced.clear()
            cut = [split.segments(t or "") for t in texts]
            whole = [split(t) if parts is None else split(parts[0]) for t, parts in zip(texts, cut, strict=True)]
            new = {s for s in set().union(*[parts[1:] for parts in cut if parts]) if s not in spaced}
            cuts = {s: split(" " + s) for s in new}
            words = sorted({w for w in set().union(*whole, *cuts.values()) if w not in known})
            data = [w.encode() for w in words]
            for some in (slice(0, 0), *(slice(i, i + 32768) for i in range(0, len(words), 32768))):
                known.update(zip(words[some], pieces.token_counts(data[some]).tolist(), strict=True))
            spaced.update((s, (sum(map(known.__getitem__, p)), len(p))) for s, p in cuts.items())
            tokens, n = [], []
            for first, parts in zip(whole, cut, strict=True):
                rest = list(map(spaced.__getitem__, parts[1:])) if parts else ()
                tokens.append(sum(map(known.__getitem__, first)) + sum(map(itemgetter(0), rest)))
                n.append(len(first) + sum(map(itemgetter(1), rest)))
            return {"n_tokens": tokens, "n_words": n}

        return count

    return map_texts(docs, text_col, carry, {"n_tokens": "long", "n_words": "long"}, start)
