"""Token counts, language, byte-pair encoding, main text and quality against brute force, round trips and held-out rows."""

import hashlib
import math
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from contrapair.llm import gam_quality, ppm_langid, queries, tagpath_html, transducer_bpe, trie_counts
from contrapair.llm.pretokens import Splitter

SMALL = "/root/testdata/sf0.01"
ODD = [None, "", " ", "\n\n  x", "a" * 5000, "x<|endoftext|>y", "don't we'll  go\t\n ", "Ünïcödé 日本語 \U0001f600‍", "\x1c\x1d\x85\xa0　 z",
       "123 4567", "the the the", "the the the", "word " * 20000]
SCHEMA = "doc_id long, text string, n_tokens string, score string, features string, main_text string, ids string"


def table(spark, texts):
    return spark.createDataFrame([(None if i == 3 else i, t, "clash", "clash", "clash", "clash", "clash") for i, t in enumerate(texts)], SCHEMA)


def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_splits_like_the_tokenizer():
    t = tokenizer()
    rng = random.Random(5)
    letters = [chr(c) for c in [*range(1, 0x250), 0x3000, 0x2028, 0x200b, 0x660, 0x4e2d, 0x1f600, 0x301, 0xfeff, 0x1680]]
    texts = ["".join(rng.choices(letters + [" "] * 60 + ["'s", "'ll", "\n"] * 20, k=40)) for _ in range(2000)]
    vocab = transducer_bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    split = Splitter(tuple(vocab.specials))
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert [i for w in split(text) for i in vocab.merge(w.encode())] == want.ids, repr(text)


def test_merging_many_words():
    vocab, rng = transducer_bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json")), random.Random(2)
    words = [bytes(rng.choices(b" etaoinshrdlu\xc3\xa9.", k=rng.randrange(45))) for _ in range(5000)] + [b" the", b"aaaaaaaaaaaaaaaa"]
    assert vocab.merge_many(words) == [transducer_bpe.pack(vocab.merge(w)) for w in words] and vocab.merge_many([]) == []


def test_merging_many_words_takes_little_memory():
    vocab = transducer_bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    words = [b" nowhere%012d" % n for n in range(60_000)]
    tracemalloc.start()
    vocab.merge_many(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000


def test_slice_without_new_words(spark):
    text = "the same words " * 20_000  # more than a slice, so the second row meets only words that are known
    docs = spark.createDataFrame([(n, text) for n in range(3)], "doc_id long, text string").coalesce(1)
    want = tokenizer().encode(text, add_special_tokens=False).ids
    rows = transducer_bpe.encode_decode(docs, "text", ["doc_id"], public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(rows) == 3 and all(np.frombuffer(r["ids"], dtype="<u4").tolist() == want and r["decoded"] == text for r in rows)


def test_segments_split_like_whole_texts():
    rng, split = random.Random(4), Splitter(("<|endoftext|>",))
    kinds = {True: 0, False: 0}
    for _ in range(20000):
        text = "".join(rng.choices(["a", "b,", " ", " ", "\n", "\t", "\xa0", "1", "'s", "'", "é", "<|endoftext|>"], weights=[9, 3, 6, 2, 2, 1, 1, 2, 1, 1, 1, .1], k=rng.randrange(12)))
        parts = split.segments(text)
        kinds[parts is None] += 1
        if parts is not None:
            assert split(parts[0]) + [w for p in parts[1:] for w in split(" " + p)] == split(text), repr(text)
    assert min(kinds.values()) > 1000


def test_segments_are_cut_in_one_pass_as_alone():
    rng, split = random.Random(7), Splitter()
    segments = [" " + "".join(rng.choices(["a", "b,", "\n", "\t", "\xa0", "\x1c", "1", "'s", "'", "é", "日"], k=rng.randrange(6))) for _ in range(5000)]
    assert split.pieces(segments) == [split(s) for s in segments] and split.pieces([]) == []


def test_copies_in_a_slice_are_encoded_once(spark, monkeypatch):
    taken, asked, decode = {}, [], transducer_bpe.Vocabulary.decode_many
    monkeypatch.setattr(transducer_bpe, "map_texts", lambda docs, text, carry, fields, start, **_: taken.update(start=start))
    monkeypatch.setattr(transducer_bpe.Vocabulary, "decode_many", lambda self, packed: asked.append(len(packed)) or decode(self, packed))
    transducer_bpe.encode_decode(table(spark, ODD), "text", ["doc_id"], public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one two"] * 3 + [None, "", "two  one", "one two", ""]
    made = taken["start"]()(texts)
    assert asked == [3] and made["decoded"] == [t or "" for t in texts]
    assert [np.frombuffer(i, dtype="<u4").tolist() for i in made["ids"]] == [tokenizer().encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoding_is_the_tokenizers(spark):
    t = tokenizer()
    done = transducer_bpe.encode_decode(table(spark, ODD), "text", ["doc_id", "score"], public_tokenizers.path("byte_bpe_50k.json"), lexicon_words=3, cache_words=4)
    rows = done.collect()
    assert len(rows) == len(ODD)
    for row, text in zip(rows, ODD, strict=True):
        want = t.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(row["ids"], dtype="<u4").tolist() == want and row["n_tokens"] == len(want)
        assert row["decoded"] == t.decode(want, skip_special_tokens=False) and row["score"] == "clash"


def test_encoding_query_on_given_texts(spark):
    t = tokenizer()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.op5_bpe(spark, SMALL).collect():
        want = t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_lexicon_comes_from_the_tokenizer_alone(spark, monkeypatch):
    """Neither a sample nor a count of the documents decides which words the lexicon has."""
    docs = table(spark, ODD)

    def refuse(*_, **__):
        raise AssertionError("reads the documents")

    for name in ("sample", "count", "collect"):
        monkeypatch.setattr(type(docs), name, refuse)
    transducer_bpe.encode_decode(docs, "text", ["doc_id"], public_tokenizers.path("byte_bpe_50k.json"))
    vocab = transducer_bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    words = transducer_bpe.own_words(vocab, 1000, 4)
    assert len(words) == 1000 and b" the" in words and max(len(w.decode()) for w in words) <= 4


def test_lexicon_shares_suffixes(tmp_path):
    words = {w.encode(): (i, i + 1) for i, w in enumerate(["walking", "talking", "walked", "talked", "a", "", "übung"])}
    path = tmp_path / "lexicon"
    path.write_bytes(transducer_bpe.compile_lexicon(words))
    lexicon = transducer_bpe.Lexicon(str(path))
    asked = [*words, b"walk", b"x", b"talkings", b"walkinG", b"\0"]
    assert lexicon.find(asked) == [transducer_bpe.pack(words[w]) if w in words else None for w in asked]
    assert len(lexicon.accepting) < sum(map(len, words)) - 10
    path.write_bytes(transducer_bpe.compile_lexicon({}))
    assert transducer_bpe.Lexicon(str(path)).find([b"a", b""]) == [None, None]


def test_decoding_odd_ids():
    vocab, t = transducer_bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json")), tokenizer()
    rng = random.Random(1)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(9))]
        assert vocab.decode(np.array(ids, dtype=np.int64)) == t.decode(ids, skip_special_tokens=False)


def best_split(word: bytes, scores, unknown=-30.0):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        options = []
        for start in range(end):
            gain = scores.get(word[start:end], unknown if end - start == 1 else None)
            if gain is not None:
                options.append((best[start][0] + gain, best[start][1] + 1))
        top = max(o[0] for o in options)
        best[end] = min((o for o in options if o[0] == top), key=lambda o: o[1])
    return best[-1][1]


def test_token_counts(spark):
    scores = trie_counts.rank_scores(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    split, known = Splitter(), {}

    def count(text):
        words = split(text or "")
        for w in set(words) - known.keys():
            known[w] = best_split(w.encode(), scores) if len(w) < 200 else None
        return [known[w] for w in words]

    texts = [t for t in ODD if t is None or len(t) != 5000]
    for rows, texts, nodes in ((trie_counts.token_counts(table(spark, texts), "text", ["doc_id"], scores, max_words=5), texts, 5),):
        for row, text in zip(rows.collect(), texts, strict=True):
            assert row["n_tokens"] == sum(count(text)) and row["n_words"] == len(split(text or ""))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op3_token_counts(spark, "/root/testdata/sf0.001").collect():
        assert r["n_tokens"] == sum(count(docs[r["doc_id"]]))
    assert trie_counts.token_counts(table(spark, []), "text", ["doc_id"], scores).count() == 0
    assert trie_counts.token_counts(table(spark, ["a" * 5000]), "text", ["doc_id"], scores).first()["n_words"] == 1


def code_length(trees, counts, text: bytes, lang: int, order: int) -> float:
    """Escape by escape, from raw counts."""
    total = 0.0
    for at in range(len(text)):
        for m in range(min(order, at), -1, -1):
            follow = {g & 255: n for (l, g), n in counts[m].items() if l == lang and g >> 8 == int.from_bytes(text[at - m:at], "big")}
            if not follow:
                continue
            t, d = sum(follow.values()), len(follow)
            if text[at] in follow:
                total -= math.log2(follow[text[at]] / (t + d))
                break
            total -= math.log2(d / (t + d))
        else:
            total += 8
    return total


def test_code_lengths_by_hand(monkeypatch):
    monkeypatch.setattr(ppm_langid, "WINDOW", 7)
    train, order = [b"abracadabra abrakadabra", b"zyxzyxxyz zzyx"], 3
    counts = [{} for _ in range(order + 1)]
    for lang, text in enumerate(train):
        for m in range(order + 1):
            for at in range(m, len(text)):
                key = (lang, int.from_bytes(text[at - m:at + 1], "big"))
                counts[m][key] = counts[m].get(key, 0) + 1
    arrays = [(np.array([k[0] for k in c]), np.array([k[1] for k in c]), np.array(list(c.values()), dtype=float)) for c in counts]
    trees = ppm_langid.Trees(["a", "z"], arrays, [0.5, 0.5])
    texts = [b"abra", b"", b"zyxabra", b"q", b"abracadabra zyx zzz qq \xff"]
    found = trees.lengths(texts)
    for i, t in enumerate(texts):
        for lang in (0, 1):
            assert found[i, lang] == pytest.approx(code_length(trees, counts, t, lang, order), rel=1e-5, abs=1e-5)


def test_language_on_held_out_rows(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op4_language(spark, SMALL).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and held and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.95


def test_language_of_odd_rows(spark):
    docs = table(spark, ODD)
    assert {r["lang_pred"] for r in ppm_langid.identify(docs, "text", ["doc_id"], None).collect()} == {"und"}
    from pyspark.sql import functions as F
    named = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").when(F.col("doc_id") % 3 == 0, "yy"))
    trees = ppm_langid.learn(named, "doc_id", "text", "lang", F.lit(True))
    rows = ppm_langid.identify(named, "text", ["doc_id", "score"][:1], trees).collect()
    assert [r["lang_pred"] == "und" for r in rows] == [not any(c.isalpha() for c in t or "") for t in ODD]
    assert ppm_langid.learn(named.limit(0), "doc_id", "text", "lang", F.lit(True)) is None


def test_rare_language_keeps_its_nodes(spark):
    """Ten languages of 200 texts and one of 20: the rare one has the smallest counts and still its share of long contexts."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    words = {f"l{k:02}": ["".join(rng.choices("abcdefghijkl", k=rng.randint(3, 7))) for _ in range(60)] for k in range(11)}
    write = lambda lang, n: [(lang, " ".join(rng.choices(words[lang], k=40))) for _ in range(n)]
    rows = [r for k in range(10) for r in write(f"l{k:02}", 200)] + write("l10", 20)
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(4)
    trees = ppm_langid.learn(docs, "doc_id", "text", "lang", F.lit(True), max_nodes=3300)
    finite = [np.isfinite(c).all() for c in trees.costs]
    assert all(finite) and (trees.costs[2][:, 10] < trees.costs[2].mean()).any()
    deep = [int((trees.escapes[3][:, i] > 0).sum()) for i in range(11)]
    assert 2 * deep[10] >= min(deep[:10]) > 0  # contexts of three bytes; smaller counts tie more often and ties go together
    fresh = [r for k in range(11) for r in write(f"l{k:02}", 20)]
    asked = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(fresh)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in ppm_langid.identify(asked, "text", ["doc_id"], trees).collect()}
    assert sum(got[i] == "l10" for i, (lang, _) in enumerate(fresh) if lang == "l10") >= 19
    assert sum(got[i] == lang for i, (lang, _) in enumerate(fresh)) >= 210


def test_quality_on_held_out_rows(spark):
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = queries.op10_quality(spark, SMALL).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in label]
    assert sum(r["predicted"] == label[r["doc_id"]] for r in held) / len(held) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_gam_learns_features_and_pairs():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 1] * x[:, 2] > 0) | (x[:, 0] > 1)).astype(float)
    model = gam_quality.fit(x[:3000], y[:3000], pair_rounds=200)
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.85
    assert (1, 2) in model.pairs
    one = x[3100]
    at = [int(np.searchsorted(e, v, side="left")) for e, v in zip(model.edges, one, strict=True)]
    by_hand = model.base + sum(t[a] for t, a in zip(model.tables, at, strict=True)) + sum(t[at[i], at[j]] for (i, j), t in model.pairs.items())
    assert model.score(one[None])[0] == pytest.approx(1 / (1 + math.exp(-by_hand)))
    assert gam_quality.fit(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((1, 2)))[0] == 0.5
    assert gam_quality.fit(np.ones((9, 2)), np.ones(9)).score(np.zeros((1, 2)))[0] > 0.9


def test_features_of_many_texts_are_those_of_each():
    texts = [*ODD, "a! b$ \0 c| \0", ". ?\n!\n\n x\x0b", "Two\x1cwords a b a b."]
    many = gam_quality.features(texts)
    assert np.array_equal(many, np.concatenate([gam_quality.features([t]) for t in texts])) and gam_quality.features([]).shape == (0, len(gam_quality.FEATURES))
    for row, text in zip(many, texts, strict=True):
        words = (text or "").encode().split()
        pairs, of = list(zip(words, words[1:], strict=False)), dict(zip(gam_quality.FEATURES, row.tolist(), strict=True))
        if words:
            want = (len(set(words)) / len(words), max(map(words.count, set(words))) / len(words), len(set(pairs)) / max(1, len(pairs)), sum(w[-1:] in b"!#*$%&|" for w in words) / len(words))
            assert tuple(of[k] for k in ("distinct_words", "top_word", "distinct_pairs", "marked_words")) == want


def test_quality_of_odd_rows(spark):
    docs = table(spark, ODD)
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (None, 1), (5, None), (6, 1)], "doc_id long, quality int")
    from pyspark.sql import functions as F
    features = gam_quality.feature_table(docs, "text", ["doc_id"])
    for l in (labels, labels.limit(0)):
        rows = gam_quality.score(features, gam_quality.learn(features, l, "doc_id", "quality", F.lit(True))).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert gam_quality.score(features.limit(0), gam_quality.fit(np.zeros((0, 30)), np.zeros(0))).count() == 0


def test_quality_in_one_pass_equals_the_feature_table(spark):
    from pyspark.sql import functions as F
    docs = table(spark, ODD)
    labels = spark.createDataFrame([(1, 0), (2, 1), (4, 1), (6, 1), (6, 0), (None, 1), (7, None), (99, 1)], "doc_id long, quality int")
    texts = gam_quality.labelled_texts(docs, labels, "doc_id", "text", "quality", F.col("doc_id") != 2)
    assert sorted(r["doc_id"] for r in texts.collect()) == [1, 4, 6]
    features = gam_quality.feature_table(docs, "text", ["doc_id", "score"])
    model = gam_quality.learn(features, labels, "doc_id", "quality", F.col("doc_id") != 2)
    again = gam_quality.learn(gam_quality.feature_table(texts, "text", ["doc_id"]), labels, "doc_id", "quality", F.lit(True))
    want = {r["doc_id"]: r["score"] for r in gam_quality.score(features.drop("score"), model).collect()}
    got = gam_quality.score_texts(docs, "text", ["doc_id", "text", "main_text"], again).collect()
    assert {r["doc_id"]: r["score"] for r in got} == want
    assert {r["doc_id"]: (r["text"], r["main_text"]) for r in got} == {None if i == 3 else i: (t, "clash") for i, t in enumerate(ODD)}
    assert gam_quality.labelled_texts(docs, labels.limit(0), "doc_id", "text", "quality", F.lit(True)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href=/>Site</a></header><nav><ul><li><a href="/a">Menu one</a></li><li>Two, three.</li></ul></nav><div class="cookie-notice">We use cookies, as all do. Accept them.</div>
<div id=wrap><!-- ad --><div class="ad">Buy now, it is cheap.</div><article><h1>A headline</h1><p><b>First &amp; foremost,  text.<br><p>Second
 paragraph&nbsp;here, with a <a href="x">link</a>; and &lt;more&gt;.</p><ul><li>An item, too.</ul><aside>Not this, please.</aside></article>
<section class="comments"><p>I disagree, strongly. Very long comment text, with many, many words, and commas.</p></section>
<form><label>Name</label><textarea>x</textarea></form><div class="sidebar"><p>Elsewhere, others write.</p></div></div><footer>&copy; us, all rights.</footer>"""


def test_main_text_of_a_page():
    assert tagpath_html.main_text(PAGE) == "A headline\nFirst & foremost, text.\nSecond paragraph here, with a link; and <more>.\nAn item, too."
    for page in (None, "", "   ", "<", "<p", "<!-- open", "<script>alert('x, y.')", "<nav>Menu, menu.</nav>"):
        assert tagpath_html.main_text(page) in ("", "<", "<p")
    assert tagpath_html.main_text("Only text, no tags.") == "Only text, no tags."
    plain = "<div class=top><a href=1>Home</a> <a href=2>News</a></div><div class=post>" + "".join(f"<p>Sentence {i}, and so on it goes, at length.</p>" for i in range(9)) + "</div>"
    assert tagpath_html.main_text(plain) == "\n".join(f"Sentence {i}, and so on it goes, at length." for i in range(9))


@pytest.mark.parametrize("wrapper", ["div class='content no-sidebar'", "div class='with-sidebar'", "div id='main-widget'", "div class='entry comments-open'",
                                     "div class=sidebar", "form action=/page.aspx"])
@pytest.mark.parametrize("heading", ["<h1>A headline</h1>", "<h2>A headline</h2>"])
def test_names_alone_lose_no_article(wrapper, heading):
    said = [f"Sentence {i}, and so on it goes, at length." for i in range(9)]
    page = (f"<html><body><div class=masthead><a href=/>Site</a></div><{wrapper}>{heading}" + "".join(f"<p>{t}</p>" for t in said)
            + f"<div class=ad>Buy now, it is cheap.</div></{wrapper.split()[0]}><div class=sidebar><p>Elsewhere, others write.</p></div></body></html>")
    assert tagpath_html.main_text(page) == "\n".join(["A headline", *said])


def test_sections_and_comments_of_an_article():
    said = [f"Sentence {i}, and so on it goes, at length." for i in range(3)]
    own = "".join(f"<div class={name}><p>The {name} part, as long as any of the others.</p></div>" for name in ("notice", "side", "related"))
    comments = "<div id=comments>" + "<article class=comment><p>I disagree, strongly, and at length, with all of it.</p></article>" * 20 + "</div>"
    share = "<div class=share><a href=1>Mail</a> <a href=2>Print</a></div>"
    page = "<body><article><h1>A headline</h1>" + "".join(f"<p>{t}</p>" for t in said) + own + share + "</article>" + comments + "</body>"
    want = ["A headline", *said, *[f"The {name} part, as long as any of the others." for name in ("notice", "side", "related")]]
    assert tagpath_html.main_text(page) == "\n".join(want)


def test_page_in_parts_has_a_threshold():
    parts = [[f"Sentence {i} of part {k}, and so on it goes, at length, as sentences do." for i in range(6)] for k in range(2)]
    made = "".join(f"<div class=part{k}><h2>Part {k}</h2>" + "".join(f"<p>{t}</p>" for t in part) + "</div>" for k, part in enumerate(parts))
    menu = "<div class=top>" + "".join(f"<div class=entry>Item {i}</div>" for i in range(8)) + "</div>"
    page = f"<html><body>{menu}{made}</body></html>"
    assert tagpath_html.main_text(page) == "\n".join(["Part 0", *parts[0], "Part 1", *parts[1]])


def test_main_text_of_given_pages(spark):
    import re
    import html
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in queries.op9_main_text(spark, SMALL).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_main_text_of_odd_rows(spark):
    rows = tagpath_html.extract(table(spark, [None, "", "<p>" * 3000 + "deep, text.", PAGE, PAGE]), "text", ["doc_id", "main_text"][:1]).collect()
    assert [r["main_text"] for r in rows][:3] == ["", "", "deep, text."] and rows[3]["main_text"] == rows[4]["main_text"]
