import hashlib
import json
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quire.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoders():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    keeps = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in keeps} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in keeps)}
    a_bytes = {i: bytes(byte_of[c] for c in w) for w, i in json.load(open(A))["model"]["vocab"].items()}
    b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
    return lambda x: t.encode(" " + x, add_special_tokens=False).ids, sp.encode, a_bytes, b_bytes


def groups_of(text, encoders):
    enc_a, enc_b, a_bytes, b_bytes = encoders
    if not text:
        return []
    ia, ib = enc_a(text), enc_b(text)
    raw = (" " + text).encode()
    if b"".join(a_bytes[i] for i in ia) != raw or b"".join(b_bytes[i] for i in ib) != raw:
        return []
    ea, eb = np.cumsum([len(a_bytes[i]) for i in ia]), np.cumsum([len(b_bytes[i]) for i in ib])
    out, p, q = [], 0, 0
    for e in sorted(set(ea.tolist()) & set(eb.tolist())):
        r, s = int(np.searchsorted(ea, e)) + 1, int(np.searchsorted(eb, e)) + 1
        out.append((ia[p:r], ib[q:s]))
        p, q = r, s
    return out


def brute(rows, encoders):
    docs = [(i, groups_of(t, encoders)) for i, t in rows]
    links = [Counter((a, b) for ga, gb in g for a in ga for b in gb) for _, g in docs]
    count = Counter(p for c in links for p in c)
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for (doc_id, g), c in zip(docs, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        n_best = sum(n for p, n in c.items() if count[p] == top[p[0]])
        out.append((doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), n_best, sum(n * count[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def run(df):
    return sorted((tuple(r) for r in alignment.align(df, A, B).collect()), key=str)


def test_odd_rows(odd, odd_rows, encoders):
    assert run(odd) == brute([(r[0], r[1]) for r in odd_rows], encoders)


def test_many_small_shards(spark, encoders, monkeypatch):
    texts = ["", None, " ", "  two  blanks ", "a▁b", "tab\tand\nlines\r\n", "naïve café übergrößen", "日本語のテキスト と 漢字", "<|endoftext|> <s> </s> <unk> <0x41>", "ﬁne ½ Å", "\U0001f600\U0001f601 ok", "don't we'll I'm", "x" * 999, "aaaa aaaa aaaa", "12345 67890", "\x00\x01 zero"]
    rows = [(i % 20, texts[i % len(texts)] if i % 3 else " ".join(str(t) for t in texts[i % 7 : i % 7 + i % 5])) for i in range(90)]
    monkeypatch.setattr(alignment, "SHARD_BYTES", 300)
    monkeypatch.setattr(alignment, "BUCKET_BYTES", 500)
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows, encoders)


def test_whole_table(spark, encoders):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], encoders)


def test_empty_table(none):
    assert run(none) == []


def test_fast_encoder_equals_the_library(encoders):
    a = alignment.byte_level(A)
    for t in ["it's 12½   naïve", " " * 3000 + "x", "<|endoftext|>", "\n\n a\t\tb", "漢字" * 50]:
        assert a.encode([t])[0] == encoders[0](t)


def test_long_groups_count_distinct_pairs(encoders):
    """A group without shared ends inside: its links are counted by distinct ids, not paired one by one."""
    a = alignment.Tokenizer(lambda t: None, [b" ", b"xx", b"x"])
    b = alignment.Tokenizer(lambda t: None, [b" x", b"xx", b"x"])
    n = 100_000
    w = alignment.Windows(a, b, [np.array([0] + [1] * n + [2], np.int32)], [np.array([0] + [1] * n, np.int32)])
    assert w.groups.tolist() == [1] and w.links.tolist() == [(n + 2) * (n + 1)] and len(w.link_key) == 6
