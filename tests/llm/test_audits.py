"""License scans, filter audits and conversation tries against brute force and SQL, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pytest

from contrapair.llm import conversation_trie, filter_audit, license_join, queries
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_prefix_trie", "op13_filter_audit"])
def test_queries_match_sql(spark, con, name):
    message, rows = compare(spark, con, SMALL, queries.queries()[name], queries.checks()[name])
    assert message == "" and rows


# license scans

NOTICES = [("one", "alpha beta gamma delta epsilon"), ("two", "alpha beta gamma delta zeta eta theta"), ("two", "iota kappa"), ("three", "the the of and")]
PHRASES = {"alpha beta": "one", "of the": "four", "kappa kappa": "five"}
TEXTS = [None, "", " .,;-", "ALPHA beta", "alpha-beta.Gamma\ndelta EPSILON", "a" * 300, "of the of the of the", "kappa kappa kappa", "Alphaİbeta kKappa alpha beta",
         "alpha x beta x gamma x delta x zeta", "the of and and", "x " * 5000 + "iota " + "y " * 30 + "kappa", "x " * 31 + "iota " + "y " * 31 + "kappa", "éalpha beta", "1alpha beta",
         "alpha beta", "alpha beta", "zeta eta theta delta gamma beta"]


def brute_scan(text, containment, width, stride):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, base, labels, score = [], set(), set(), 0.0
    for phrase, label in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(ws)) if ws[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    for b in range(-(-len(ws) // stride)):
        block = set(ws[b * stride:b * stride + width])
        fits = [(len(block & (s := set(n.split()))) / len(s), len(block & s), label) for label, n in NOTICES]
        fits = [f for f in fits if f[0] >= containment - 1e-12]
        if fits:
            labels.add(max(fits)[2])
            score = max(score, max(fits)[0])
    return (len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)),
            1.0 if places else score)


@pytest.mark.parametrize("containment,width,stride", [(0.8, 64, 32), (0.5, 8, 4), (1.0, 5, 5), (0.3, 7, 3)])
def test_license_join_is_brute_force(spark, containment, width, stride):
    rng = random.Random(3)
    pool = "alpha beta gamma delta epsilon zeta eta theta iota kappa the of and".split() + ["x", "y", "z"] * 4
    texts = TEXTS + [" ".join(rng.choices(pool, k=rng.randrange(60))) for _ in range(300)]
    rows = [(None if i % 7 == 3 else i % 50, t, "clash", "clash", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, row string, n_words int").repartition(3)
    got = license_join.scan(docs, notices=NOTICES, phrases=PHRASES, containment=containment, width=width, stride=stride)
    want = [(r[0], *brute_scan(r[1], containment, width, stride)) for r in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_license_texts_of_any_length_and_no_texts(spark, monkeypatch):
    monkeypatch.setattr(license_join, "SEGMENT", 10)
    vocabulary = license_join.Vocabulary(NOTICES, PHRASES)
    for text in ("x " * 40 + "alpha beta", "alpha " * 50 + "b" * 100 + " of the", "é" * 60, "," * 35 + "a"):
        whole = [vocabulary.number.get(w, -1) for w in license_join.words(text.encode())]
        assert vocabulary.read(text.encode()).tolist() == whole
    assert license_join.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        license_join.Vocabulary([("none", "...")], {})


def test_license_finds_notices_reworded_and_leaves_others(spark):
    wrapped = "// Permission is hereby granted, free of\n// charge, to any person obtaining a copy of this software\n// and its associated documentation files"
    nc = "This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 International License."
    docs = spark.createDataFrame([(1, "filler " * 50 + wrapped), (2, nc), (3, "The license of this work is public, see the terms of the version."), (4, "GNU tools are public.")], "doc_id long, text string")
    got = {r["id"]: (r["labels"], r["n_base"]) for r in license_join.scan(docs).collect()}
    assert got == {1: ("mit", 0), 2: ("cc-by-nc", 0), 3: ("", 0), 4: ("", 0)}


# filter audits

def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {(d[2] or "") for d in docs}:
        masks = []
        for i, text, lang in docs:
            if (lang or "") == part:
                text = text or ""
                ws = re.findall(r"[^\x20\x09-\x0D]+", text)
                fails = {c for c, f in zip("ABCDE", (
                    len(ws) < 100, 100 * len(set(ws)) < 80 * len(ws), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)),
                    i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)), strict=True) if f}
                masks.append((fails, i in good, i in toxic))
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            past = set()
            for k, c in enumerate(order):
                gone = [m for m in masks if c in m[0] and not m[0] & past]
                out[part, "".join(order), k + 1] = [sum(not m[0] & (past | {c}) for m in masks), len(gone), sum(c in m[0] and bool(m[0] & past) for m in masks),
                                                    sum(m[0] == {c} for m in masks), sum(m[1] for m in gone), sum(m[2] for m in gone)]
                removed_by[c] += len(gone)
                past.add(c)
        for order in itertools.permutations("ABCDE"):
            for k, c in enumerate(order):
                out[part, "".join(order), k + 1].append(removed_by[c])
    return out


def audit_rows(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def test_filter_audit_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS", 2)
    rng = random.Random(8)
    long = " ".join(f"w{i}" for i in range(120))
    texts = [None, "", long, long + " $", long.upper(), "A", "a " * 130, "word " * 99 + "#", "\x1cx y " * 101, "a|b", "ÄÖ" * 3]
    docs = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice([None, "", "en", "fr", "x y"])) for _ in range(150)]
    docs += [(5, long, "en"), (5, long, "en"), (4, long, "fr")]
    labels = [(rng.choice([None, *range(30)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(40)]
    made = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, lang string, mask string, step int")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(made, said)
    assert audit_rows(got) == brute_audit(docs, labels) and got.count() == 600 * len({(d[2] or "") for d in docs})


def test_filter_audit_without_rows(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "a", "en")], docs.schema)
    assert filter_audit.audit(one, labels).count() == 600


# conversation tries

def brute_trie(turns):
    own = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:])
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    out = []
    for node, members in nodes.items():
        below = [m for m in nodes if m[:len(node)] == node]
        leaves = [m for m in below if not any(x[:-1] == m for x in nodes if x)]
        saved = sum((len(nodes[m]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) for m in below if m)
        ends = ",".join(str(c) for c in sorted(members) if paths[c] == node)
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), sum(x[:-1] == node for x in nodes if x), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def some_turns(rng, n):
    said = ["", "hello", "hello there", "how are  you", None, "x\n y", "hello"]
    out = []
    for c in range(n):
        conv = rng.choice([c, c, c, -c, 20 * c])
        out += [(conv, t if rng.random() > 0.1 else None, rng.choice(["user", "assistant"]) if rng.random() > 0.1 else None, rng.choice(said)) for t in range(rng.randrange(1, 6))]
    first = [(0, t, "user", f"long {t}") for t in range(30)]
    copies = [(1000 + c, t, "user", "same words") for c in range(120) for t in range(3)]
    return out + first + copies + [(None, 1, "user", "nobody"), (7, 3, "user", "twice"), (7, 3, "user", "twice")]


@pytest.mark.parametrize("shard_turns", [None, 7, 40, 10**9])
def test_prefix_trie_is_brute_force(spark, monkeypatch, shard_turns):
    monkeypatch.setattr(conversation_trie, "ENDS_A_ROW", 3)
    turns = some_turns(random.Random(6), 90)
    rows = [(*t, "clash", 1, 2) for t in turns]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string, depth int, id int").repartition(5)
    if shard_turns == 7:
        paths = conversation_trie.rebuilt(conversation_trie.conversations(table, "conv_id", "turn", "role", "text"))
        cuts = conversation_trie.splitters(paths, 7)
        assert len(cuts) > 5 and len({p for p, _ in cuts}) < len(cuts) and cuts == sorted(cuts)  # the copies lie in several shards
    got = conversation_trie.prefix_trie(table, shard_turns=shard_turns)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_trie(turns)


def test_prefix_trie_of_one_and_of_none(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_trie.prefix_trie(spark.createDataFrame([], schema)).collect() == []
    turns = [(21, 0, "user", "word " * 50000)]
    for t in (turns, [(c, None, None, None) for c in (41, 42, 43)]):
        assert sorted(repr(tuple(r)) for r in conversation_trie.prefix_trie(spark.createDataFrame(t, schema)).collect()) == brute_trie(t)
