"""Token counts, BPE, language id, quality: against brute force, round trips and held-out accuracy."""

import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import bpe, langid, quality, token_counts, vocab
from quire.llm.common import table
from quire.llm.queries import PATTERN, VOCABULARY, bpe_digests, queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"
SF_01 = "/root/testdata/sf0.01"


def sums(lengths, limits):
    out = {}
    for at in {*lengths, *limits}:
        within = [x for x in lengths if x <= at]
        out[at] = (lengths.count(at), len(within), sum(within), len(lengths) - len(within), sum(lengths) - sum(within), sum(min(x, at) for x in lengths), len(within) / len(lengths) if lengths else None)
    return out


def test_token_counts_equal_brute_force(spark, odd, odd_rows):
    enc = brute.tokenizer()
    for df, texts in ((odd, [r[1] for r in odd_rows]), (table(spark, SF, "documents"), None)):
        texts = texts or [r["text"] for r in df.select("text").collect()]
        lengths = [len(enc.encode_ordinary(t or "")) for t in texts]
        got = {r[0]: tuple(r[1:]) for r in token_counts.token_counts(df.select("text"), VOCABULARY, PATTERN).collect()}
        assert got == sums(lengths, token_counts.LIMITS)


def test_token_counts_blocks_and_empty(spark, none):
    h = spark.createDataFrame([(0, 2), (3, 1), (4, 5), (9, 1), (17, 2)], "length long, n_docs long")
    lengths = [0, 0, 3, 4, 4, 4, 4, 4, 9, 17, 17]
    for block in (1, 4, 1000):
        assert {r[0]: tuple(r[1:]) for r in token_counts.suffix_sums(h, block).collect()} == sums(lengths, [])
    rows = token_counts.token_counts(none.select("text"), VOCABULARY, PATTERN).collect()
    assert {r["context_limit"] for r in rows} == set(token_counts.LIMITS) and all(r["docs_within"] == 0 and r["quantile"] is None for r in rows)


def test_vocabulary_maps_back():
    tokens = vocab.ranks(VOCABULARY)
    back = {c: b for b, c in enumerate(vocab.byte_alphabet())}
    assert len(back) == 256 and all(bytes(back[c] for c in vocab.mapped(t)) == t for t in tokens)


def test_bpe_equals_tiktoken_and_round_trips(spark, odd, odd_rows):
    enc = brute.tokenizer()
    got = odd.select("text", bpe.encode(F.col("text"), VOCABULARY, PATTERN).alias("i")).withColumn("d", bpe.decode(F.col("i"), VOCABULARY)).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert r["i"] == enc.encode_ordinary(r["text"] or ""), r["text"][:80]
        assert bytes(r["d"]) == (r["text"] or "").encode()


def test_bpe_query_digests(spark):
    enc = brute.tokenizer()
    rows = {r["doc_id"]: r for r in queries()["op3_byte_bpe"](spark, SF).collect()}
    for r in table(spark, SF, "documents").collect():
        ids, g = enc.encode_ordinary(r["text"] or ""), rows[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(r["text"] or ""))


def test_bpe_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    enc = brute.tokenizer()
    own = bpe._encoder(vocab.sentencepiece_model(VOCABULARY), vocab.ranks(VOCABULARY), PATTERN)
    for t in (" ".join(f"w{i}x{i * i}" for i in range(50)), "a" * 100 + " b", "again w1x1 " * 3, ""):
        assert own(t) == enc.encode_ordinary(t)


def test_bpe_empty_table(none):
    assert bpe_digests(none.select("doc_id", "text")).collect() == []


def test_language_held_out(spark):
    docs = table(spark, SF_01, "documents")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in got) / len(got)
    assert right >= 0.97, right
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(odd, odd_rows, none):
    got = langid.identify(odd).collect()
    assert len(got) == len(odd_rows)
    texts = dict((r[0], r[1]) for r in odd_rows if r[0] is not None and r[0] != 301)
    for r in got:
        if r["doc_id"] in texts:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]] or "")), r
        assert r["held_out"] is not None
    assert langid.identify(none).collect() == []


def test_language_nothing_to_learn_from(odd, odd_rows):
    got = langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(got) == len(odd_rows) and all(r["lang_pred"] == "und" and r["score"] == 0 for r in got)


def test_language_binding_is_order_sensitive():
    a, b = ord("a"), ord("b")
    pack = lambda *p: (p[0] << 42) | (p[1] << 21) | p[2]
    same = langid.bind(pack(a, b, a), 1024).astype(int) @ langid.bind(pack(a, b, a), 1024)
    other = langid.bind(pack(a, b, a), 1024).astype(int) @ langid.bind(pack(b, a, a), 1024)
    assert same == 1024 and abs(other) < 200


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the larger tables")
def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = quality.judge(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    for label in (0, 1):
        own = [r for r in got if r["quality"] == label]
        right = sum(r["predicted"] == label for r in own) / len(own)
        assert right >= 0.95, (label, right, len(own))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_quality_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (5, None, None), (5, 0, 1), (5, 1, 1), (999, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(odd, labels).collect()
    assert len(got) == len(odd_rows) and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got)
    empty = labels.where("false")
    assert all(r["score"] == 0.5 and r["predicted"] == 1 for r in quality.judge(odd, empty).collect())
    assert quality.judge(none, labels).collect() == []
    kept = quality.accept(odd, empty)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows)


def test_quality_cut_is_the_stated_quantile():
    cut, level = quality.quantile_cut([(-300, 5, 0), (-200, 4, 0), (200, 0, 9), (300, 0, 9)])
    assert cut == pytest.approx(0.0, abs=0.02) and level == 9 / 27
    assert quality.quantile_cut([(5, 0, 3)]) == (0.0, 0.0) and quality.quantile_cut([]) == (0.0, 0.0)
    # overlapping labels: as many lie below the cut as are rejected
    cut, level = quality.quantile_cut([(0, 2, 1), (1, 1, 1), (2, 1, 3)])
    assert 0.01 <= cut <= 0.02 and level == 4 / 9


def test_quality_equals_brute_force(spark):
    """Weights at which the pair loss has no slope, scores from plain arithmetic, the cut from sorted scores."""
    docs, labels = table(spark, SF_01, "documents"), table(spark, SF_01, "labels")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["doc_id"] in texts}
    ranking = quality.fit(docs.select("doc_id", "text"), labels)
    x = {i: quality.features_of(t) for i, t in texts.items()}
    few = np.array([x[i] for i in known])
    mean, scale = few.mean(0), few.std(0) + 1e-3
    assert np.allclose(mean, ranking.mean) and np.allclose(scale, ranking.scale)
    w = np.array(ranking.weights)
    z = {i: (v - mean) / scale for i, v in x.items()}
    # every pair of a preferred and a rejected document, not only those drawn
    good, bad = [np.array([z[i] for i, q in known.items() if q == k]) for k in (1, 0)]

    def loss(v):
        return np.log1p(np.exp(-((good @ v)[:, None] - (bad @ v)[None]))).mean() + quality.PENALTY / 2 * v @ v

    best = loss(w)
    rng = np.random.default_rng(2)
    assert all(loss(w + s * 0.3 * d / np.linalg.norm(d)) > best for d in rng.normal(size=(20, len(w))) for s in (1, -1))
    raw = {i: float(v @ w) for i, v in z.items()}
    ordered = sorted(raw[i] for i in known)
    rejected = sum(q == 0 for q in known.values())
    low, high = ordered[rejected - 1], ordered[rejected]
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    cut = quality.fit_cut(docs.select("doc_id", ranking.raw(F.col("text")).alias("raw")), labels, ranking)
    assert low - 0.02 <= cut.cut <= high + 0.02 and cut.quantile == rejected / len(known)
    for i, r in got.items():
        assert r["score"] == pytest.approx(1 / (1 + np.exp(cut.cut - raw[i])), abs=1e-9)
        assert r["predicted"] == (raw[i] >= cut.cut)


def test_language_equals_brute_force(spark):
    """Plain bundles of bound letters and their cosines with plain prototypes."""
    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.select("doc_id", "text", "lang").collect()]
    size = 256

    def bundle(text):
        low = "".join(c if c.isalpha() else " " for c in text.lower())
        framed = " " + " ".join(low.split()) + " "
        out = np.zeros(size)
        if not low.strip():
            return None
        for g, n in Counter(framed[i : i + 3] for i in range(len(framed) - 2)).items():
            v = np.ones(size)
            for place, c in enumerate(reversed(g)):
                v = v * np.roll(langid.letter_vector(ord(c), size), place)
            out += n * v
        return out

    sums = {}
    vectors = {i: bundle(t or "") for i, t, _ in rows}
    for i, _, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2 and vectors[i] is not None:
            sums[lang] = sums.get(lang, 0) + vectors[i]
    for r in langid.identify(docs, dimensions=size).collect():
        v = vectors[r["doc_id"]]
        if v is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        cosine = {k: p @ v / np.linalg.norm(p) / np.linalg.norm(v) for k, p in sums.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert r["score"] == pytest.approx(max(cosine[best], 0), abs=1e-5)
        assert r["lang_pred"] == best or cosine[best] - cosine[r["lang_pred"]] < 1e-5


def test_language_column_with_too_many_values_is_refused(spark, odd, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    with pytest.raises(ValueError, match="values of lang"):
        langid.identify(odd.withColumn("lang", F.col("doc_id").cast("string")))


def test_bpe_hands_rows_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(bpe, "PART_IDS", 50)
    enc = brute.tokenizer()
    docs = table(spark, SF, "documents").coalesce(1)
    both = docs.select("text", bpe.encode_and_decode(F.col("text"), VOCABULARY, PATTERN).alias("b")).select("text", "b.*").collect()
    assert all(r["ids"] == enc.encode_ordinary(r["text"]) and bytes(r["decoded"]) == r["text"].encode() for r in both)
    got = docs.select("text", bpe.encode(F.col("text"), VOCABULARY, PATTERN).alias("i")).withColumn("d", bpe.decode(F.col("i"), VOCABULARY)).collect()
    assert len(got) == docs.count() and all(r["i"] == enc.encode_ordinary(r["text"]) and bytes(r["d"]) == r["text"].encode() for r in got)


def test_token_counts_encode_each_text_once(spark):
    """One pass through Python for the histogram, none after it."""
    docs = table(spark, SF, "documents")
    lengths = docs.select(token_counts.encoded_length(docs["text"], VOCABULARY, PATTERN))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(token_counts.length_histogram(lengths)).count("ArrowEvalPython") == 1
    assert "Python" not in plan(token_counts.token_counts(docs, VOCABULARY, PATTERN))
