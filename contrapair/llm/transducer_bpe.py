"""Exact byte-pair encoding and decoding with a transducer lexicon.

The tokenizer's own tokens that are pre-tokens are merged once and compiled into a minimal acyclic automaton
whose words share prefixes and suffixes. Its transitions carry numbers that add up to the place of a word, and the place leads
to the word's ids. The automaton is one flat file in the shared folder, memory-mapped by every task. Words that are not in
it are merged exactly, so the lexicon decides speed, never results.
"""

from __future__ import annotations

import heapq
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from contrapair.llm.common import Index, map_texts, publish
from contrapair.llm.pretokens import Splitter


NONE = (1 << 31) - 1
#: Bytes of text that are encoded at a time; the strings of its different words take as much again.
SLICE = 1 << 20
#: Words that are merged at a time: their tables, of 32 places a word, are the largest things a task holds.
MERGED_AT_ONCE = 1 << 12


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]


def pack(ids: tuple[int, ...]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.array(ids, dtype="<u4").tobytes()


class Vocabulary:
    """Merges, ids and special tokens of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        back = {c: bytes([b]) for b, c in enumerate(letters)}
        ids = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.byte_ids = [ids[c] for c in letters]
        #: pair of ids -> (rank, id of both together)
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        # pairs stand in order of rank, so a pair's place is its rank
        self.pairs = Index(np.array([a << 32 | b for a, b in self.merges], dtype=np.int64))
        self.joined = np.array([joined for _, joined in self.merges.values()], dtype=np.int64)
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = [b""] * (1 + max(max(ids.values()), *self.specials.values(), 0))
        for token, i in ids.items():
            self.bytes[i] = b"".join(back[c] for c in token)
        for token, i in self.specials.items():
            self.bytes[i] = token.encode()
        self.tokens = pa.array(self.bytes, pa.binary())

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of a pre-token: the pair of lowest rank is merged first, of equal ones the leftmost."""
        ids: list[int | None] = [self.byte_ids[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, joined, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two was merged since
            ids[i], ids[j] = joined, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.merges.get((joined, ids[k])):
                    heapq.heappush(queue, (m[0], i, m[1], joined, ids[k]))
            h = before[i]
            if h >= 0 and (m := self.merges.get((ids[h], joined))):
                heapq.heappush(queue, (m[0], h, m[1], ids[h], joined))
        return tuple(i for i in ids if i is not None)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of many words at once: each step joins the pair of lowest rank, the leftmost first, in every word."""
        out: list[bytes] = [b""] * len(words)
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        byte_ids = np.array(self.byte_ids, dtype=np.int64)
        for least, most in ((0, 8), (8, 16), (16, 32)):
            at = np.flatnonzero((length > least) & (length <= most))
            for some in np.array_split(at, -(-len(at) // MERGED_AT_ONCE) or 1):
                if not len(some):
                    continue
                data = np.frombuffer(b"".join(words[i].ljust(most, b"\0") for i in some), dtype=np.uint8).reshape(-1, most)
                ids = np.where(np.arange(most) < length[some, None], byte_ids[data], -1)
                rank = self._ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(some), -1)
                column = np.arange(most)
                while len(some):
                    best = rank.argmin(axis=1)
                    lowest = rank[np.arange(len(some)), best]
                    done = lowest == NONE
                    if done.any():
                        ready, size = ids[done].astype("<u4").tobytes(), 4 * most
                        for k, (i, n) in enumerate(zip(some[done].tolist(), (ids[done] >= 0).sum(axis=1).tolist(), strict=True)):
                            out[i] = ready[k * size:k * size + 4 * n]
                        go = ~done
                        some, ids, rank, best, lowest = some[go], ids[go], rank[go], best[go], lowest[go]
                        if not len(some):
                            break
                    row = np.arange(len(some))
                    ids[row, best] = self.joined[lowest]
                    later = column > best[:, None]
                    ids = np.take_along_axis(ids, np.minimum(column + later, most - 1), axis=1)
                    ids[:, -1] = -1
                    rank = np.take_along_axis(rank, np.minimum(column[:-1] + later[:, :-1], most - 2), axis=1)
                    rank[:, -1] = NONE
                    rank[row, np.minimum(best, most - 2)] = self._ranks(ids[row, best], ids[row, np.minimum(best + 1, most - 1)])
                    left = np.flatnonzero(best > 0)
                    rank[left, best[left] - 1] = self._ranks(ids[left, best[left] - 1], ids[left, best[left]])
        for i in np.flatnonzero(length > 32):
            out[i] = pack(self.merge(words[i]))
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NONE where they don't merge or the right one is missing."""
        place = self.pairs.find(np.where(right >= 0, left << 32 | right, -1))
        return np.where(place >= 0, place, NONE)

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_many([pack(ids)])[0]

    def decode_many(self, packed: list[bytes]) -> list[str]:
        """Texts of packed ids: all their tokens are taken at once, then joined for each text."""
        ends = np.cumsum([0, *(len(ids) // 4 for ids in packed)])
        tokens = self.tokens.take(pa.array(np.frombuffer(b"".join(packed), dtype="<u4")))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens), b"")
        return [text.decode("utf-8", errors="replace") for text in texts.to_pylist()]


def compile_lexicon(words: dict[bytes, tuple[int, ...]]) -> bytes:
    """A file with the minimal acyclic automaton of the words and their ids.

    Words arrive in byte order. When a word leaves the path of its predecessor, the states left behind are
    final in shape and are replaced by equal ones met before, so equal suffixes are stored once.
    """
    order = sorted(words)
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # accepting, transitions of the states along the last word
    last = b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            accepting, steps = path.pop()
            shape = (accepting, tuple(steps))
            if shape not in known:
                known[shape] = len(states)
                states.append(shape)
            path[-1][1].append((last[len(path) - 1], known[shape]))

    for word in order:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        settle(common)
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        last = word
    settle(0)
    states.append((path[0][0], tuple(path[0][1])))  # the start is the last state
    below = []  # words accepted from each state on; targets come before their sources
    keys, targets, skips = [], [], []
    for at, (accepting, steps) in enumerate(states):
        passed = int(accepting)
        for byte, to in sorted(steps):
            keys.append(at << 8 | byte)
            targets.append(to)
            skips.append(passed)
            passed += below[to]
        below.append(passed)
    ends = np.cumsum([0, *(len(words[w]) for w in order)])
    arrays = [np.array(keys), np.array(targets), np.array(skips), np.array([s[0] for s in states]), ends,
              np.fromiter(chain.from_iterable(words[w] for w in order), dtype=np.int64)]
    head = np.array([len(a) for a in arrays] + [max(map(len, order), default=0)], dtype=np.int64)
    return head.tobytes() + b"".join(a.astype(np.int64).tobytes() for a in arrays)


class Lexicon:
    """A compiled lexicon, memory-mapped; looks many words up at once."""

    def __init__(self, path: str):
        data = np.memmap(path, dtype=np.int64, mode="r").view(np.ndarray)  # still the file's pages
        sizes, self.longest = data[:6], int(data[6])
        cuts = 7 + np.cumsum([0, *sizes])
        self.keys, self.targets, self.skips, self.accepting, self.ends, self.ids = (
            data[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
        self.start = len(self.accepting) - 1

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """Packed ids of each word, None for those it doesn't hold."""
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        state = np.where(length <= self.longest, self.start, -1)
        place = np.zeros(len(words), dtype=np.int64)
        width = int(length[state >= 0].max(initial=0))
        letters = np.frombuffer(b"".join(w[:width].ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width)
        for at in range(width):
            live = np.flatnonzero((state >= 0) & (length > at))
            if not len(live) or not len(self.keys):
                break
            key = state[live] << 8 | letters[live, at]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[i] == key
            state[live] = np.where(hit, self.targets[i], -1)
            place[live] += np.where(hit, self.skips[i], 0)
        found = (state >= 0) & (self.accepting[np.maximum(state, 0)] == 1)
        if not len(self.keys):
            found &= length == 0
        out: list[bytes | None] = [None] * len(words)
        for i in np.flatnonzero(found).tolist():
            out[i] = self.ids[self.ends[place[i]]:self.ends[place[i] + 1]].astype("<u4").tobytes()
        return out


def own_words(vocabulary: Vocabulary, words: int, longest: int) -> list[bytes]:
    """The vocabulary's first tokens that are one pre-token of at most ``longest`` characters; at most ``words``.

    Ids of merges follow their ranks, so these are the tokens that the tokenizer's makers met most often.
    """
    split, out = Splitter(), []
    for token in vocabulary.bytes:
        text = token.decode("utf-8", errors="replace")
        if 0 < len(text) <= longest and text.encode() == token and text not in vocabulary.specials and split(text) == [text]:
            out.append(token)
            if len(out) == words:
                break
    return out


def encode_decode(docs: DataFrame, text_col: str, carry: list[str], tokenizer: str, *, lexicon_words: int = 50_000,
                  longest_word: int = 32, cache_words: int = 300_000) -> DataFrame:
    """The columns ``carry`` with n_tokens long, ids binary (little-endian unsigned 32-bit) and decoded string.

    Whole texts; special tokens' strings become their ids, nothing is added. ``lexicon_words`` words of at most
    ``longest_word`` characters bound the lexicon, which depends on the tokenizer's file alone; all other words are merged
    exactly. ``cache_words`` bounds what a task remembers between slices of about 1 MB of text.

    * A null text counts as empty; an empty text has no ids and decodes to the empty string.
    * Words of any length are merged in n log n steps. Rows repeating others are rows of their own, null ids stay null.
    * Equal texts of a slice are worked on once: ``mixing`` writes a document's copies beside each other.
    * Columns that are not carried are not looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary(tokenizer)
    specials = tuple(vocabulary.specials)
    words = own_words(vocabulary, lexicon_words, longest_word)
    file = publish(spark, "lexicon.bin", compile_lexicon({w: vocabulary.merge(w) for w in words}))
    shared = spark.sparkContext.broadcast(vocabulary)  # a tokenizer file: fixed size

    def start():
        vocab, lexicon = shared.value, Lexicon(SparkFiles.get(file))
        split, fresh = Splitter(specials), {s: pack((i,)) for s, i in vocab.specials.items()}
        known = dict(fresh)  # pre-tokens, and segments with the space before them

        def learn(words: set[str]) -> None:
            new = [w for w in words if w not in known]
            data = [w.encode() for w in new]
            found = lexicon.find(data)
            unseen = [i for i, ids in enumerate(found) if ids is None]
            for i, ids in zip(unseen, vocab.merge_many([data[i] for i in unseen]), strict=True):
                found[i] = ids
            known.update(zip(new, found, strict=True))

        def encode(texts: list) -> dict:
            nonlocal known
            distinct = list(dict.fromkeys(t or "" for t in texts))
            cut = [t.partition(" ") if split.cuts_at_spaces(t) else (t, "", "") for t in distinct]
            heads = [split(head) for head, _, _ in cut]
            rest = pc.split_pattern(pa.array([tail if space else None for _, space, tail in cut], pa.string()), " ")
            coded = rest.flatten().dictionary_encode()
            segments = pc.binary_join_element_wise("", coded.dictionary, " ").to_numpy(zero_copy_only=False).tolist()
            if len(known) > cache_words:  # what is met again just now is likely to be met once more
                known = fresh | {s: known[s] for s in segments if s in known}
            new = [s for s in segments if s not in known]
            pieces = split.pieces(new)
            words = set(chain.from_iterable(heads)).union(*pieces)
            if words:
                learn(words)
            known.update([(s, b"".join([known[w] for w in p])) for s, p in zip(new, pieces, strict=True) if len(p) > 1])
            tails = pa.array([known[s] for s in segments], pa.binary()).take(coded.indices)
            tails = pc.binary_join(pa.ListArray.from_arrays(rest.offsets, tails), b"").to_pylist()
            ids = [b"".join([known[w] for w in head]) + tail for head, tail in zip(heads, tails, strict=True)]
            done = dict(zip(distinct, zip(ids, vocab.decode_many(ids), strict=True), strict=True))
            rows = [done[t or ""] for t in texts]
            return {"n_tokens": [len(i) // 4 for i, _ in rows], "ids": [i for i, _ in rows], "decoded": [text for _, text in rows]}

        return encode

    return map_texts(docs, text_col, carry, {"n_tokens": "long", "ids": "binary", "decoded": "string"}, start, size=SLICE)
