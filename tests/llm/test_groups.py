"""Chat formatting, near-duplicates, mixing and the pipeline against brute force, and odd inputs."""

import collections
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from contrapair.llm import chat_grammar, queries, systematic_mix, vptree_simhash
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(queries.checks()))
def test_matches_sql(spark, name):
    assert compare(spark, connect(SMALL), SMALL, queries.queries()[name], queries.checks()[name])[0] == ""


# ---- chat ---------------------------------------------------------------------------------------------------------

HARD = [None, "", "plain", "a\\b", "\\", "\\\\", "</s>", "<s>", "<|user|>", "x|>y", "[INST] [/INST]", "<<SYS>>\\<</SYS>>", "<</s>", "</s", "<\\/s>", "|", "<", "日本\U0001f600</s>", "$1 \\$1"]


def test_chat_round_trip(spark):
    rows = [(c, t, role, text, "clash") for c, role in ((1, "user"), (2, "assistant"), (3, "a|>b</s>\\"), (None, None)) for t, text in enumerate(HARD)]
    rows += [(5, 1, "assistant", "same", "clash"), (5, 1, "assistant", "same", "clash"), (5, None, "user", "first", "clash")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string")
    for r in chat_grammar.format_conversations(df, "conv_id", "turn", "role", "text").collect():
        own = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text, _ in rows if c == r["conv"]))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role, text) for _, role, text in own]
        loss = [r["formatted"][s["start"]:s["end"]] for s in r["loss_spans"]]
        assert [re.sub(r"\\(\\?)", r"\1", x) for x in loss] == [text for _, role, text in own if role == "assistant"]
        inner = r["formatted"].split("</s>")
        assert inner[-1] == "" and len(inner) == len(own) + 1
    assert chat_grammar.format_conversations(df.limit(0), "conv_id", "turn", "role", "text").count() == 0


def test_trained_text_follows_the_mask(spark):
    df = spark.createDataFrame([(r"<s><|assistant|>a\\\\b</s>", [(16, 22)]), ("<s><|assistant|>abcd</s>", [(17, 19), (19, 20)]), ("<s>", [])],
                               "f string, spans array<struct<start: int, end: int>>")
    assert [r[0] for r in df.select(chat_grammar.trained_text("f", "spans")).collect()] == [r"a\\b", "bcd", ""]


def test_chat_grammar_refuses_other_text(spark):
    df = spark.createDataFrame([(x,) for x in ("<s>", "", "<s><|u|>x", "<s><|u>x</s>", "<s>u|>x</s>", "<s><|u|>[INST]</s>", "<s><|u|>x</s>")], "f string")
    assert [r[0] for r in df.select(chat_grammar.parse(df["f"]).isNotNull()).collect()] == [True, False, False, False, False, False, True]


# ---- near-duplicates ----------------------------------------------------------------------------------------------


def slow_print(text, words, bits=64):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(bits) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(prints, radius, near=None):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_fingerprint_by_hand():
    for text in (None, "", " \n", "One", "ÄÖ Ab", "a b c", "a b c d e f g a b c", "x\x0by\x1cz \x85 q", "w " * 700 + "v"):
        assert int.from_bytes(vptree_simhash.fingerprint(text, 3), "big") == slow_print(text, 3)
    assert len(vptree_simhash.fingerprint("a b c d e f", 5, 8)) == 64


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize(("bits", "spread"), [(64, 64), (24, 24), (64, 9)])
def test_trees_lose_no_link(spark, bits, spread):
    rng = np.random.default_rng(bits + spread)
    base = rng.integers(0, 1 << bits, 40, dtype=np.uint64)
    x = [int(b) for b in base]
    for b in base.tolist() * 25:
        for k in rng.choice(spread, rng.integers(0, 5), replace=False):
            b ^= 1 << int(k)
        x.append(b)
    x += [int(v) for v in rng.integers(0, 1 << bits, 800, dtype=np.uint64)]
    x = sorted(set(x))
    rows = [(0, v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "tab int, print long, node long")
    edges = vptree_simhash.links(df, 2, shard_rows=100)
    assert all((x[r["a"]] ^ x[r["b"]]).bit_count() <= 2 for r in edges.collect())
    root = {r["node"]: r["root"] for r in vptree_simhash.classes(edges).collect()}
    assert same_partition([root.get(i, i) for i in range(len(x))], slow_classes(x, 2))


def test_rows_dealt_out_grow_as_the_input(spark, monkeypatch):
    dealt = []

    def kept(self, *args, **kwargs):
        dealt.append(plain(self, *args, **kwargs))
        return dealt[-1]

    df = spark.range(80_000).selectExpr("0 as tab", "xxhash64(id) as print", "id as node")
    plain = type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", kept)
    for n in (10_000, 80_000):
        vptree_simhash.links(df.where(f"node < {n}"), 2, shard_rows=256)
    few, many = (d.count() for d in dealt)
    assert many <= 8.1 * few and many <= 3 * 80_000


@pytest.mark.parametrize("shard_rows", [100, 1 << 20])
def test_pairs_of_places_lie_in_one_tree(spark, shard_rows):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 32, 12, dtype=np.uint64).tolist()
    x = [base[0]] * 300  # frequent values, beside ones that agree with them in some of the bits only
    for b in base * 25:
        for k in rng.choice(32, rng.integers(0, 4), replace=False):
            b ^= 1 << int(k)
        x += [b] * int(rng.integers(1, 4))
    x += [base[1] & ~0x3FF | int(v) for v in rng.integers(0, 1 << 10, 400)] + [base[2] & 0x1FFFFF | int(v) << 21 for v in rng.integers(0, 1 << 11, 400)]
    df = spark.createDataFrame([(0, v, i) for i, v in enumerate(x)], "tab int, print long, node long")
    trees = {}
    for r in vptree_simhash.links(df, 2, bits=32, shard_rows=shard_rows).collect():
        assert (x[r["a"]] ^ x[r["b"]]).bit_count() <= 2
        for n in (r["a"], r["b"]):
            trees.setdefault(n, set()).add((r["shard"], r["tree"]))
    pairs = [(i, j) for i in range(len(x)) for j in range(i) if (x[i] ^ x[j]).bit_count() <= 2]
    assert pairs and all(trees.get(i, set()) & trees.get(j, set()) for i, j in pairs)


def test_wide_trees_lose_no_link(spark):
    rng = np.random.default_rng(5)

    def flipped(x, n):
        return x ^ sum(1 << int(k) for k in rng.choice(768, n, replace=False))

    def piece(x, tab):
        return x >> 32 * (23 - tab) & 0xFFFFFFFF

    prints = []
    for _ in range(40):
        a = int.from_bytes(rng.bytes(96), "big")
        c = flipped(a, 90)
        prints += [a, c]
        for t in range(24):  # a stranger that lies before both in the order of this piece, near to them, and would hide their link
            stranger = int.from_bytes(rng.bytes(96), "big")
            prints.insert(0, stranger ^ (piece(stranger, t) ^ piece(a, t) & piece(c, t)) << 32 * (23 - t))
    x = list(dict.fromkeys(prints))
    df = spark.createDataFrame([(v.to_bytes(96, "big"), n) for n, v in enumerate(x)], "print binary, node long")
    got = {r["node"]: r["root"] for r in vptree_simhash.similar_classes(df, 0.8, shard_rows=200).collect()}
    most, of = vptree_simhash.bits_apart(0.8, 768), list(range(len(x)))
    for i in range(len(x)):
        for j in range(i):
            apart = x[i] ^ x[j]
            if apart.bit_count() <= most and any(piece(apart, t).bit_count() <= 2 for t in range(24)):
                of = [of[j] if v == of[i] else v for v in of]
    assert len(set(of)) < len(of) - 10
    assert same_partition([got.get(i, i) for i in range(len(x))], of)


def test_classes_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("(id * 11) % 301 as a", "((id + 1) * 11) % 301 as b")
    root = {r["node"]: r["root"] for r in vptree_simhash.classes(edges).collect()}
    assert set(root) == set(range(1, 301)) and set(root.values()) == {0}
    assert vptree_simhash.classes(edges.limit(0)).count() == 0


def test_classes_that_are_stars_take_no_round(spark, monkeypatch):
    written, write = [], vptree_simhash.materialise
    monkeypatch.setattr(vptree_simhash, "materialise", lambda df: written.append(df) or write(df))
    found = vptree_simhash.classes(spark.createDataFrame([(1, 2), (3, 1), (4, 5)], "a long, b long")).collect()
    assert sorted(map(tuple, found)) == [(2, 1), (3, 1), (5, 4)] and len(written) == 1
    assert vptree_simhash.classes(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids = sorted(docs)
    prints = [slow_print(docs[i], 3) for i in ids]
    of = slow_classes(prints, 2)
    least = {}
    for i, c in zip(ids, of, strict=True):
        least[c] = min(i, least.get(c, i))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash(spark, SMALL).collect()}
    assert got == {i: (f"{p:016x}", least[c]) for i, p, c in zip(ids, prints, of, strict=True)}


def test_simhash_of_odd_rows(spark):
    texts = [None, "", " ", "one", "one", "a b c d", "a b c d", "x " * 50000]
    df = spark.createDataFrame([(None if i == 3 else i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, component long, id long")
    rows = vptree_simhash.exact_classes(df, "doc_id", "text").collect()
    assert sorted((r["id"] is None, r["id"] or 0, r["component"]) for r in rows) == [
        (False, 0, 0), (False, 1, 0), (False, 2, 0), (False, 4, 4), (False, 5, 5), (False, 6, 5), (False, 7, 7), (True, 0, 4)]
    assert vptree_simhash.exact_classes(df.limit(0), "doc_id", "text").count() == 0


def sentence(rng, n):
    return [f"w{v}" for v in rng.integers(0, 5000, n)]


def test_keep_one(spark):
    rng = np.random.default_rng(0)
    rows, clean = [], []
    for d in range(60):
        w = sentence(rng, 400)
        rows.append((d, " ".join(w)))
        clean.append(d)
        near = list(w)
        for at in rng.choice(400, 6, replace=False):
            near[at] = "changed"
        rows += [(1000 + d, " ".join(near)), (2000 + d, " ".join(w).upper())]
        rows.append((3000 + d, " ".join([*w[:80], *sentence(rng, 320)])))  # shares a passage only
        clean.append(3000 + d)
    rows += [(7000, "same row"), (7000, "same row"), (None, "same row"), (None, None), (None, ""), (8000, " ")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    kept = vptree_simhash.keep_one(df, "doc_id", "text")
    assert kept.columns == df.columns
    got = collections.Counter(r["doc_id"] for r in kept.collect())
    assert got == collections.Counter([*clean, 7000, 8000])
    assert vptree_simhash.keep_one(df.limit(0), "doc_id", "text").count() == 0


def test_keep_one_confirms_by_jaccard(spark):
    rng = np.random.default_rng(8)
    pairs = {}

    def add(kind, a, b):
        pairs.setdefault(kind, []).append((" ".join(a), " ".join(b)))

    for _ in range(20):
        w, line = sentence(rng, 404), sentence(rng, 10)
        add("above", w, [*w[:360], *sentence(rng, 44)])  # 356 of 444 shingles: 0.802
        add("below", w, [*w[:358], *sentence(rng, 46)])  # 354 of 446: 0.794
        add("line", [*line * 24, *sentence(rng, 160)], [*line * 24, *sentence(rng, 160)])
    for n in (4, 5, 6, 7, 8):  # shingles of n + 4 words
        w = sentence(rng, n + 4)
        add("short", w, [*w, "more"])
    w = sentence(rng, 12)
    add("short", ["one", *w], [*w, "two"])  # 8 of 10 shingles
    w = sentence(rng, 11)
    add("different", ["one", *w], [*w, "two"])  # 7 of 9
    for n in (1, 2, 3):
        w = sentence(rng, n + 4)
        add("different", w, [*w, "more"])
    texts = [t for kind in pairs.values() for pair in kind for t in pair]
    df = spark.createDataFrame([(n, t, "en", "s", 0) for n, t in enumerate(texts)], DOCS)
    kept = {r["text"] for r in vptree_simhash.keep_one(df, "doc_id", "text").select("text").collect()}
    gone = {kind: sum(a not in kept or b not in kept for a, b in of) for kind, of in pairs.items()}
    assert gone["below"] == gone["line"] == 0
    assert gone["above"] >= 16
    assert gone["short"] == 6 and gone["different"] == 0


# ---- mixing -------------------------------------------------------------------------------------------------------


def slow_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        rest = budget - sum(most * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        level = rest / sum(w[s] for s in free) if free else 0
        over = [s for s in free if w[s] * level > most * sizes[s] + 1e-9]
        if not over:
            return {s: most * sizes[s] if s in full else w[s] * level for s in names}
        full |= set(over)


def test_mix_on_given_rows(spark):
    for sf in (SMALL, "/root/testdata/sf0.1"):
        rows = queries.op8_mix(spark, sf).collect()
        source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()}
        sizes, taken, target, largest = collections.Counter(), collections.Counter(), {}, collections.Counter()
        for r in rows:
            s = source[r["doc_id"]]
            sizes[s] += r["size"]
            taken[s] += r["taken"]
            target[s] = r["target"]
            largest[s] = max(largest[s], r["size"])
            assert r["taken"] <= 2 * r["size"]
        want = slow_targets(sizes)
        for s in sizes:
            assert target[s] == pytest.approx(want[s])
            assert abs(taken[s] - target[s]) <= 1.0 * largest[s] + 1e-6
        assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op8_mix(spark, sf).collect()))


def test_mix_of_odd_rows(spark):
    rows = [(1, "a b c", None), (2, None, "x"), (3, "", "x"), (None, "d e", ""), (5, "f", "y"), (5, "f", "y"), (6, "g " * 5000, "z"), (7, "h", "z")]
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS).selectExpr("*", "1 as size", "2 as target", "3 as id", "4 as h")
    got = systematic_mix.mix(df).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = slow_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["copies"] <= 2
    again = systematic_mix.repeat_rows(df)
    assert again.columns == df.columns and again.where("source = 'x'").count() == 0
    assert abs(again.count() - sum(r["copies"] for r in got)) <= 1
    assert systematic_mix.mix(df.limit(0)).count() == 0 and systematic_mix.repeat_rows(df.limit(0)).count() == 0


def test_rows_of_null_and_repeated_ids_keep_their_sources(spark):
    rng = np.random.default_rng(4)
    rows = [(None if n % 3 == 0 else n % 50, " ".join(sentence(rng, int(rng.integers(5, 40)))), "en", s, 0) for s in ("a", "b") for n in range(600)]
    rows += [(None, "the same words here", "en", s, 0) for s in ("a", "b") for _ in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    sizes, got, largest = collections.Counter(), collections.Counter(), 40
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    copies = collections.Counter()
    for r in systematic_mix.repeat_rows(df, weights=(2.0, 0.5), share=1.25).collect():
        got[r["source"]] += len(r["text"].split())
        copies[r["source"], r["text"]] += 1
    want = slow_targets(sizes, (2.0, 0.5), 1.25)
    assert want["a"] > 3 * want["b"]
    for s in sizes:
        assert abs(got[s] - want[s]) <= largest
        assert abs(copies[s, "the same words here"] - 300 * want[s] / sizes[s]) <= 1


def test_copies_are_placed_without_the_texts(spark):
    df = spark.createDataFrame([(n, "a b " * (n % 7), "en", "x", 0) for n in range(50)], DOCS)
    plan = systematic_mix.repeat_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # whole rows were shuffled and sorted to be numbered


# ---- pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    from tests.llm.test_texts import tokenizer
    t = tokenizer()
    assert rows and all(r["round_trip"] for r in rows)
    for r in rows:
        assert np.frombuffer(r["ids"], dtype="<u4").tolist() == t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
    assert len({texts[r["doc_id"]] for r in rows}) == len({r["doc_id"] for r in rows})


def test_stages_keep_columns_and_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "...", "en", "s", 3), (None, "ein Wort", "de", None, 8), (4, "plain words here", "en", "s", 1),
            (4, "plain words here", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS + ", score string, row string")
    for name, stage in corpus_pipeline.STAGES:
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, SMALL)
            if name != "encoding":
                assert out.columns == corpus_pipeline.COLUMNS
            out.collect()
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, SMALL).collect()}
    assert kept == {None, 4}
    assert corpus_pipeline.near_duplicates(spark, docs, SMALL).count() == 4


def test_whole_texts_go_to_workers_in_batches_of_bounded_size(spark):
    docs = spark.range(0, 4000, 1, 1).selectExpr("id as doc_id", "repeat('abcd ', 1000) as text", "'en' as lang", "'s' as source", "0L as n_chars")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"size": [b.nbytes]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    for stage in (corpus_pipeline.language, corpus_pipeline.quality, corpus_pipeline.near_duplicates, corpus_pipeline.encoding):
        spark.conf.unset(key)
        stage(spark, docs.limit(0), SMALL)
        assert max(r["size"] for r in docs.mapInArrow(sizes, "size long").collect()) < 5_000_000
        spark.conf.set(key, "1m")
        stage(spark, docs.limit(0), SMALL)
        assert spark.conf.get(key) == "1m"
    spark.conf.set(key, before)
