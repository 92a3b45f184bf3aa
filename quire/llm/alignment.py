"""Alignment of two tokenizers' ids over one text, by white-space token anchors.

A text is tokenised as a whole by both.  Byte offsets at which tokens of both end are shared ends;
a shared end before space-marked tokens of both is an anchor, and anchors cut the two id
sequences into windows (about a word each).  Windows with equal id tuples align alike, so a
window's groups, links and text are worked out once per id tuple of a shard and looked up for all
its other occurrences.  Within a group, ids are counted before they are paired, so that a group's
links cost its distinct id pairs, however often the ids repeat.

The corpus counts: documents are packed into shards of ``SHARD_BYTES``; a shard sends its distinct id
pairs, with the number of its documents that hold each, to buckets by pair; a bucket adds them up and
answers every shard.  A pair that all documents hold is one entry a shard.  The highest count of each
id of the first tokenizer is the only thing that goes through the driver: at most one number per
entry of that vocabulary.

Defined results: a null or empty text, and one that a tokenizer doesn't give back byte by byte, has
no tokens; repeated rows count as documents of their own; a null id is kept; a text longer than a
shard is a shard of its own; an empty table gives no rows; further columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrays import distinct, pack, ranges, runs, unpack
from quire.llm.common import pick, work_folder
from quire.llm.vocab import byte_alphabet
from quire.session import cut_lineage

#: Bytes of text that a shard holds (a longer text is a shard alone).
SHARD_BYTES = 4 << 20
#: Bytes of text whose id pairs are expected to fill one bucket.
BUCKET_BYTES = 64 << 20


# ---- tokenizers


class Tokenizer:
    """An encoder to whole texts' ids, and the bytes of each id."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], tokens: list[bytes]):
        self.encode = encode
        self.tokens = tokens
        self.lens = np.array([len(t) for t in tokens], np.int64)
        self.spaced = np.array([t[:1] == b" " for t in tokens], bool)
        digits = max(len(str(len(tokens))), 1)
        #: the decimal ids, filled up with zero bytes, and room for a separator
        self.text = np.zeros((len(tokens), digits + 1), np.uint8)
        for i in range(len(tokens)):
            d = str(i).encode()
            self.text[i, : len(d)] = np.frombuffer(d, np.uint8)

    def gives_back(self, ids: list[int], raw: bytes) -> bool:
        return b"".join(map(self.tokens.__getitem__, ids)) == raw


@lru_cache(maxsize=2)
def byte_level(path: str) -> Tokenizer:
    """A byte-level BPE file of the tokenizers library.

    Where its ids are in order of its merges and it cuts texts by the common pattern, tiktoken gives
    the same ids in a fifth of the time; otherwise, and for a text that tiktoken's pattern engine
    refuses, the library itself encodes.
    """
    import public_tokenizers
    import tiktoken
    import tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    vocab = spec["model"]["vocab"]
    entries = {**vocab, **{t["content"]: t["id"] for t in spec["added_tokens"]}}
    tokens = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        tokens[i] = bytes(byte_of[c] for c in entry) if entry in vocab else entry.encode("utf-8")
    whole = tokenizers.Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    pre = spec["pre_tokenizer"] or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"]
    ranked = merged == sorted(set(merged)) and sorted(vocab.values()) == list(range(len(vocab))) and len(vocab) == len(merged) + 256
    fast = None
    if plain and ranked and not spec["model"].get("ignore_merges"):
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={tokens[i]: i for i in vocab.values()}, special_tokens={})

    def one(text: str) -> list[int]:
        if fast is not None:
            try:
                return fast.encode_ordinary(text)
            except BaseException as e:  # the engine's panic is not an Exception
                if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                    raise
        return whole.encode(text, add_special_tokens=False).ids

    return Tokenizer(lambda texts: [one(" " + t) for t in texts], tokens)


@lru_cache(maxsize=2)
def pieces(path: str) -> Tokenizer:
    """A sentencepiece model that puts a space before a text itself."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        tokens.append(bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode("utf-8"))
    return Tokenizer(lambda texts: sp.encode(texts, num_threads=1), tokens)


# ---- one shard


class Windows:
    """The windows of texts that lie one behind the other, and the alignment of each distinct one."""

    def __init__(self, a: Tokenizer, b: Tokenizer, a_ids: list[np.ndarray], b_ids: list[np.ndarray]):
        """``a_ids`` and ``b_ids``: the ids of texts that both tokenizers give back."""
        self.a, self.b = a, b
        docs = len(a_ids)
        ia, ib = np.concatenate([*a_ids, np.zeros(0, np.int32)]), np.concatenate([*b_ids, np.zeros(0, np.int32)])
        ea, eb = np.cumsum(a.lens[ia]), np.cumsum(b.lens[ib])
        size = int(ea[-1]) if len(ea) else 0
        ends_a, ends_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        ends_a[ea], ends_b[eb] = True, True
        sa, sb = ends_b[ea], ends_a[eb]  # whether a token's end is shared
        ga, gb = np.cumsum(sa) - sa, np.cumsum(sb) - sb  # the group of each token
        last_a, last_b = np.flatnonzero(sa), np.flatnonzero(sb)  # the last tokens of each group
        next_a, next_b = np.append(ia[1:], 0)[last_a], np.append(ib[1:], 0)[last_b]
        cut = a.spaced[next_a] & b.spaced[next_b]
        stops = np.cumsum([len(x) for x in a_ids], dtype=np.int64)
        stops = np.unique(stops[stops > 0])
        cut[ga[stops - 1]] = True  # a text's end
        wa, wb = last_a[cut] + 1, last_b[cut] + 1  # the windows' ends, in tokens
        from_a, from_b = np.append(0, wa[:-1])[: len(wa)], np.append(0, wb[:-1])[: len(wb)]
        # windows by their id tuples: first tokenizer's ids, -1, the other's
        many_a, many_b, w = wa - from_a, wb - from_b, np.arange(len(wa))
        both = np.full(len(ia) + len(ib) + len(w), -1, np.int32)
        both[np.arange(len(ia)) + np.repeat(from_b + w, many_a)] = ia
        both[np.arange(len(ib)) + np.repeat(wa + w + 1, many_b)] = ib
        raw, cuts = both.tobytes(), (4 * (wa + wb + w + 1)).tolist()
        tuples = [raw[p:q] for p, q in zip([0, *cuts], cuts)]
        memo = dict(zip(dict.fromkeys(tuples), range(len(tuples))))
        self.number = np.fromiter(map(memo.__getitem__, tuples), np.int64, len(tuples))
        f = np.unique(self.number, return_index=True)[1]
        per_doc = np.searchsorted(wa, np.cumsum([len(x) for x in a_ids]), "right")
        self.doc = np.repeat(np.arange(docs), np.diff(per_doc, prepend=0))
        # the alignment of each distinct window, worked out at its first place
        na, nb = (wa - from_a)[f], (wb - from_b)[f]
        ta, tb = ranges(from_a[f], na), ranges(from_b[f], nb)
        first_group = ga[from_a[f]]
        self.groups = (ga[wa[f] - 1] if len(f) else f) - first_group + (1 if len(f) else 0)
        base = np.cumsum(self.groups) - self.groups  # groups of distinct windows, renumbered without gaps
        of_a, of_b = np.repeat(np.arange(len(f)), na), np.repeat(np.arange(len(f)), nb)
        xa, xb = base[of_a] + ga[ta] - first_group[of_a], base[of_b] + gb[tb] - first_group[of_b]
        self._texts(ia[ta], ib[tb], xa, xb, of_a, of_b, len(f))
        self._links(ia[ta], ib[tb], xa, xb, np.repeat(np.arange(len(f)), self.groups))

    def _texts(self, ia: np.ndarray, ib: np.ndarray, xa: np.ndarray, xb: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, many: int) -> None:
        """The text of each distinct window: ``a1,a2|b1;a3|b2,b3``."""
        width = max(self.a.text.shape[1], self.b.text.shape[1])
        cells = np.zeros((len(ia) + len(ib), width), np.uint8)
        # in order of group, the first tokenizer's ids before the other's
        at_a = np.arange(len(ia)) + np.searchsorted(xb, xa, "left")
        at_b = np.arange(len(ib)) + np.searchsorted(xa, xb, "right")
        cells[at_a, : self.a.text.shape[1]] = self.a.text[ia]
        cells[at_b, : self.b.text.shape[1]] = self.b.text[ib]
        mark = np.full(len(cells), ord(","), np.uint8)
        mark[at_a[np.append(xa[1:] != xa[:-1], True)[: len(xa)]]] = ord("|")
        mark[at_b[np.append(xb[1:] != xb[:-1], True)[: len(xb)]]] = ord(";")
        of = np.empty(len(cells), np.int64)
        of[at_a], of[at_b] = of_a, of_b
        cells[:, -1] = mark
        used = (cells > 0).sum(axis=1)
        ends = np.cumsum(np.bincount(of, weights=used, minlength=many).astype(np.int64)).tolist()
        data = cells[cells > 0].tobytes()
        self.texts = [data[p:q] for p, q in zip([0, *ends], ends)]

    def _links(self, ia: np.ndarray, ib: np.ndarray, xa: np.ndarray, xb: np.ndarray, window: np.ndarray) -> None:
        """The distinct id pairs of each distinct window's groups, and how often each is linked."""
        ka, ca = np.unique(xa * len(self.a.tokens) + ia, return_counts=True)
        kb, cb = np.unique(xb * len(self.b.tokens) + ib, return_counts=True)
        g, a = ka // len(self.a.tokens), ka % len(self.a.tokens)
        gb, b = kb // len(self.b.tokens), kb % len(self.b.tokens)
        many = np.bincount(gb, minlength=len(window))
        begin = np.cumsum(many) - many
        other = ranges(begin[g], many[g])
        own = np.repeat(np.arange(len(g)), many[g])
        self.link_key = (a[own].astype(np.uint64) << np.uint64(32)) | b[other].astype(np.uint64)
        self.link_times = ca[own] * cb[other]
        self.link_window = window[g[own]]
        self.links = np.bincount(self.link_window, weights=self.link_times, minlength=len(self.groups)).astype(np.int64)

    def digests(self, docs: int) -> list[str]:
        """The digest of each text's groups."""
        out = [""] * docs
        for d, s in runs(self.doc):
            out[d] = hashlib.sha256(b"".join(map(self.texts.__getitem__, self.number[s].tolist()))[:-1]).hexdigest()
        return out


def _stats(windows: Windows, docs: int, buckets: int) -> tuple[np.ndarray, ...]:
    """(distinct pairs in order of bucket, how many texts hold each, and of each text and pair: text,
    place of the pair, links)."""
    pairs, _, place = distinct(windows.link_key, buckets)
    kinds = max(len(windows.groups), 1)
    seen, times = np.unique(windows.doc * kinds + windows.number, return_counts=True)
    doc, window = seen // kinds, seen % kinds
    many = np.bincount(windows.link_window, minlength=kinds)
    begin = np.cumsum(many) - many
    link = ranges(begin[window], many[window])
    doc, times = np.repeat(doc, many[window]), np.repeat(times, many[window]) * windows.link_times[link]
    key = doc * max(len(pairs), 1) + place[link]
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    times = np.add.reduceat(times, new) if len(new) else times
    key = key[new]
    doc, place = key // max(len(pairs), 1), key % max(len(pairs), 1)
    return pairs, np.bincount(place, minlength=len(pairs)), doc, place, times


# ---- job

STATS = "shard long, bytes long, ids array<long>, stats binary, digests array<string>, pairs binary, held binary"


def _aligned(path_a: str, path_b: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = byte_level(path_a), pieces(path_b)
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def row() -> pa.RecordBatch:
            docs = len(texts)
            ia, ib = [], []
            for at in range(0, docs, 64):
                part = texts[at : at + 64]
                for text, x, y in zip(part, a.encode(part), b.encode(part)):
                    raw = (" " + text).encode("utf-8")
                    fits = bool(text) and a.gives_back(x, raw) and b.gives_back(y, raw)
                    ia.append(np.array(x if fits else [], np.int32))
                    ib.append(np.array(y if fits else [], np.int32))
            w = Windows(a, b, ia, ib)
            n_groups = np.bincount(w.doc, weights=w.groups[w.number], minlength=docs).astype(np.int64)
            n_links = np.bincount(w.doc, weights=w.links[w.number], minlength=docs).astype(np.int64)
            stats = pack(np.array([len(x) for x in ia], np.int64), np.array([len(x) for x in ib], np.int64), n_groups, n_links)
            pairs, holders, doc, place, times = _stats(w, docs, buckets)
            held = pack(np.bincount(doc, minlength=docs), np.diff(place, prepend=0).astype(np.int32), times.astype(np.int64))
            values = [number, size, ids, stats, w.digests(docs), pack(pairs, holders.astype(np.uint32)), held]
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], ["shard", "bytes", "ids", "stats", "digests", "pairs", "held"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                t = text.as_py() or ""
                n = len(t.encode("utf-8"))
                if texts and size + n > SHARD_BYTES:
                    yield row()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc_id.as_py())
                texts.append(t)
                size += n
        if texts:
            yield row()

    return run


def _pair_rows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's pairs, by bucket."""
        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("pairs")):
                pairs, holders = unpack(blob.as_py())
                rows = [(b, pack(np.diff(pairs[s], prepend=np.uint64(0)), holders[s])) for b, s in runs(pairs % np.uint64(buckets))]
                cols = [pa.array([b for b, _ in rows], pa.int64()), pa.array([shard] * len(rows), pa.int64()), pa.array([r for _, r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "shard", "blob"])

    return run


ANSWER = "shard long, bucket long, counts binary, a array<int>, highest array<long>"


def _totals(rows: pa.Table) -> pa.Table:
    """Of one bucket: the corpus-wide count of every shard's pairs, and once each first id's highest count here."""
    parts = [unpack(b.as_py()) for b in rows.column("blob")]
    pairs = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    keys, place = np.unique(pairs, return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, place, np.concatenate([p[1] for p in parts]).astype(np.int64))
    a = (keys >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    highest = np.maximum.reduceat(total, first)
    at = np.cumsum([0, *[len(p[0]) for p in parts]])
    counts = [pack(total[place[p:q]]) for p, q in zip(at, at[1:])]
    none = [None] * (len(parts) - 1)
    cols = [rows.column("shard"), rows.column("bucket"), pa.array(counts, pa.binary()), pa.array([a[first].tolist(), *none], pa.list_(pa.int32())), pa.array([highest.tolist(), *none], pa.list_(pa.int64()))]
    return pa.table(cols, names=["shard", "bucket", "counts", "a", "highest"])


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(highest: np.ndarray):
    def run(shards: pa.Table, answers: pa.Table) -> pa.Table:
        """Of one shard: its documents' links against the corpus-wide counts."""
        get = lambda name: shards.column(name)[0].as_py()
        n_a, n_b, n_groups, n_links = unpack(get("stats"))
        pairs, _ = unpack(get("pairs"))
        held, step, times = unpack(get("held"))
        doc, place = np.repeat(np.arange(len(held)), held), np.cumsum(step)
        by = np.argsort(answers.column("bucket").to_numpy())
        counts = np.concatenate([np.zeros(0, np.int64), *[unpack(answers.column("counts")[int(i)].as_py())[0] for i in by]])
        best = counts == highest[(pairs >> np.uint64(32)).astype(np.int64)]
        n_best, count_sum = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
        np.add.at(n_best, doc, times * best[place])
        np.add.at(count_sum, doc, times * counts[place])
        longs = [pa.array(x, pa.int64()) for x in (get("ids"), n_a, n_b, n_groups, n_links, n_best, count_sum)]
        return pa.table([*longs, pa.array(get("digests"), pa.string())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs``:
    the ids of a space and the text by the byte-level file ``path_a`` against those of the text by the
    sentencepiece model ``path_b``."""
    spark = docs.sparkSession
    rows = pick(docs, doc_id, text).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + size // BUCKET_BYTES
    path = work_folder(spark, "alignment-shards")
    rows.mapInArrow(_aligned(path_a, path_b, buckets), STATS).write.option("compression", "none").parquet(path)
    shards = spark.read.schema(STATS).parquet(path)
    sent = shards.select("shard", "pairs").mapInArrow(_pair_rows(buckets), "bucket long, shard long, blob binary")
    answers = cut_lineage(sent.groupBy("bucket").applyInArrow(_totals, ANSWER), "alignment-counts")
    found = answers.where("a is not null").select(F.explode(F.arrays_zip("a", "highest")).alias("h")).select("h.*").groupBy("a").agg(F.max("highest").alias("highest"))
    highest = np.zeros(len(byte_level(path_a).tokens), np.int64)
    for r in found.toLocalIterator():
        highest[r.a] = r.highest
    by_shard = shards.select("shard", "ids", "stats", "digests", "pairs", "held").groupBy("shard")
    return by_shard.cogroup(answers.select("shard", "bucket", "counts").groupBy("shard")).applyInArrow(_scored(highest), RESULT)
