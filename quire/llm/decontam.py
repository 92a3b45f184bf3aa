"""Benchmark decontamination with training suffix arrays.

The training documents of a batch are a shard.  Its words become numbers of the benchmark's
vocabulary (0: any other word), and a suffix array is built over the shard's words by prefix
doubling.  A stretch of benchmark words shorter than the shortest window can't hold a window, so
such stretches are left out of the array; everything else is in it.  The window that each test
suffix begins with is then binary-searched in every shard: its bounds are all places where it
occurs verbatim.  The longest verbatim match of a document, of one word or more, is found the other
way round, in the order of the test suffixes, from all its words.

A document lies whole in one shard, so nothing is shuffled: places are marked per document and
the documents go on.  Spark writes the benchmark to the shared folder in blocks of at most
``BLOCK_BYTES`` of text (a single larger item is a block of its own), which the tasks open by path,
one at a time, and search in each shard; one pass reads the texts, whatever the number of blocks.
The driver holds only the blocks' paths.  A block's words are one flat array, in which suffixes and
windows are places, so memory is linear in its words, however long an item is; ranks of 2, 4, 8, ...
words are added as far as a document matches.

A window is ``window`` consecutive words of an item; a shorter item that isn't empty is one window.

Defined results: null has no words; a document without words is clean; items without words match
nothing; repeated items with one item_id count once; a document that holds an item with a null
item_id is hit like any other (``null_ids``; else such items are ignored), and all of them together
are one null at the end of its items, which is counted but has no place in the joined ids; repeated
rows are judged alike; an empty benchmark leaves all clean; an empty table gives no rows; further
columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import file_system, marked, pick, unmarked, work_folder

WINDOW = 13
#: A document is contaminated if at least one in so many of its words is hit.
SHARE = 20
#: Benchmark text of a block, words of a shard, and places compared at a time.
BLOCK_BYTES = 16 << 20
SHARD_WORDS = 1 << 21
COMPARED = 1 << 16

#: Bytes of words in UTF-8: digits, letters (lower-cased) and all beyond ASCII; any other is a space.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).lower()

#: What is added to a row: words, pairs of first and last hit word, ids of found items, and the
#: longest verbatim match in words with its place and item.
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest", T.LongType()),
    T.StructField("longest_at", T.LongType()),
    T.StructField("longest_item", T.StringType()),
])
_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_at", pa.int64()), ("longest_item", pa.string())])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_WORD_BYTES).split()


class Benchmark:
    """The items of a block as one flat array of word numbers, a 0 after each item, with their windows.

    Everything is linear in the block's words: a suffix is a place in ``flat``, a window a place
    (``first_at``) and a length, and its items a slice of ``window_items``.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.ids: list[str | None] = []
        self.vocabulary: dict[bytes, int] = {}
        texts = []
        for item_id, text in items:
            w = words_of(text)
            if w:
                self.ids.append(item_id)
                texts.append(np.fromiter((self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w), np.int32, len(w)))
        size = np.array([len(w) for w in texts], np.int64)
        self.starts = np.cumsum(size + 1) - (size + 1)
        self.flat = np.zeros(int(size.sum()) + len(texts), np.int32)
        for w, at in zip(texts, self.starts):
            self.flat[at : at + len(w)] = w
        self._ranks = [self.flat + 1]
        self._pairs: list[tuple[np.ndarray, int]] = []
        self._order: tuple[int, np.ndarray] = (-1, np.zeros(0, np.int64))
        length = np.minimum(size, window)
        first_at, lengths, pairs = [], [], []
        n_windows = 0
        for n in np.unique(length):
            of = np.flatnonzero(length == n)
            many = size[of] - n + 1
            at = np.repeat(self.starts[of] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            # equal windows have equal first and last parts, of a power of two words each
            k = int(n).bit_length() - 1
            rank = self.rank(k).astype(np.int64)
            _, one, which = np.unique(rank[at] * (rank.max() + 1) + rank[at + n - (1 << k)], return_index=True, return_inverse=True)
            first_at.append(at[one])
            lengths.append(np.full(len(one), n, np.int64))
            pairs.append(np.unique((which.astype(np.int64) + n_windows) * len(texts) + np.repeat(of, many)))
            n_windows += len(one)
        none = np.zeros(0, np.int64)
        self.first_at = np.concatenate([none, *first_at])
        self.lengths = np.concatenate([none, *lengths])
        pair = np.concatenate([none, *pairs])
        self.window_items = pair % max(len(texts), 1)
        self.first = np.searchsorted(pair // max(len(texts), 1), np.arange(n_windows + 1))
        self.least = int(self.lengths.min(initial=window)) if n_windows else 0
        self.most = int(self.lengths.max(initial=0))

    def rank(self, k: int) -> np.ndarray:
        """The ranks, from 1, of the 2 ** k words from each place on; made when first needed."""
        while len(self._ranks) <= k:
            self.pairs(len(self._ranks) - 1)
        return self._ranks[k]

    def pairs(self, k: int) -> tuple[np.ndarray, int]:
        """The sorted pairs (rank * width + rank behind) of level ``k``, whose places are the ranks of the next."""
        while len(self._pairs) <= k:
            rank = self._ranks[len(self._pairs)].astype(np.int64)
            n = min(1 << len(self._pairs), len(rank))
            width = int(rank.max(initial=0)) + 1
            keys, which = np.unique(rank * width + np.concatenate([rank[n:], np.zeros(n, np.int64)]), return_inverse=True)
            self._ranks.append(which.astype(np.int32) + 1)
            self._pairs.append((keys, width))
        return self._pairs[k]

    def order(self, k: int) -> np.ndarray:
        """The places of ``flat`` in order of their suffixes, compared by 2 ** k words at least."""
        if self._order[0] < k:
            self._order = (k, np.argsort(self.rank(k), kind="stable"))
        return self._order[1]

    def items_of(self, windows: np.ndarray) -> np.ndarray:
        many = self.first[windows + 1] - self.first[windows]
        at = np.repeat(self.first[windows] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.unique(self.window_items[at])


def suffix_array(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The places ``starts`` in order of the suffixes of ``words`` there, compared by ``depth`` words at least.

    Prefix doubling: ranks by 1, 2, 4, ... words.  Past the end ranks are 0, below all words.
    """
    rank = words.astype(np.int64)
    known = 1
    while known < depth:
        after = np.concatenate([rank[known:], np.zeros(min(known, len(rank)), np.int64)])
        pair = rank * (int(rank.max(initial=0)) + 1) + after
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64) + 1
        known *= 2
    return starts[np.argsort(rank[starts], kind="stable")]


def stretches(words: np.ndarray, least: int) -> np.ndarray:
    """Whether a place lies in a stretch of at least ``least`` words of the vocabulary."""
    inside = np.concatenate([[0], (words != 0).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(inside))
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= least
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, begin[long], 1)
    np.add.at(change, end[long], -1)
    return np.cumsum(change[:-1]) > 0


def bounds(words: np.ndarray, order: np.ndarray, flat: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every key (``lengths`` numbers of ``flat`` from ``at`` on) the range of the suffix array whose
    suffixes begin with it, by binary search of all keys at once."""
    most = int(lengths.max())
    padded = np.concatenate([words, np.zeros(most, words.dtype)])
    padded_keys = np.concatenate([flat, np.zeros(most, flat.dtype)])
    column = np.arange(most)
    ends = []
    for upper in (False, True):
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
        while (open_ := lo < hi).any():
            left = np.flatnonzero(open_)
            for part in np.array_split(left, -(-len(left) // COMPARED)):
                mid = (lo[part] + hi[part]) // 2
                there, key = padded[order[mid][:, None] + column], padded_keys[at[part][:, None] + column]
                differs = (there != key) & (column < lengths[part][:, None])
                where = differs.argmax(1)
                row = np.arange(len(part))
                less = differs.any(1) & (there[row, where] < key[row, where])
                right = less | (~differs.any(1) if upper else False)
                lo[part] = np.where(right, mid + 1, lo[part])
                hi[part] = np.where(right, hi[part], mid)
        ends.append(lo)
    return ends[0], ends[1]


def search(texts: list[list[bytes]], bench: Benchmark) -> list[tuple[np.ndarray, set[int], int, int, int]]:
    """For each document of a shard: marks of hit words, found items, and the longest match
    (words, place, item)."""
    size = np.array([len(t) for t in texts], np.int64)
    if not len(bench.lengths) or not size.sum():
        return [(None, set(), 0, -1, -1) for _ in texts]
    get = bench.vocabulary.get
    # a 0 after each document keeps matches inside it
    words = np.zeros(int(size.sum()) + len(texts), np.int32)
    doc_start = np.cumsum(size + 1) - (size + 1)
    for t, s in zip(texts, doc_start):
        words[s : s + len(t)] = np.fromiter((get(w, 0) for w in t), np.int32, len(t))
    n, at, item = longest(words, doc_start, bench)
    clean = [(None, set(), *map(int, best)) for best in zip(n, at - doc_start, item)]
    keep = stretches(words, bench.least)
    if not keep.any():
        return clean
    # the kept stretches, each followed by a 0
    edge = np.concatenate([keep[1:] != keep[:-1], [True]]) & keep
    take = np.flatnonzero(keep | np.concatenate([[False], edge[:-1]]))
    short = np.concatenate([words[take], [0]])
    order = suffix_array(short, np.flatnonzero(short), bench.most)
    lo, hi = bounds(short, order, bench.flat, bench.first_at, bench.lengths)
    many = hi - lo
    which = np.repeat(np.arange(len(many)), many)
    if not len(which):
        return clean
    ends = np.cumsum(many)
    near = order[np.repeat(lo - (ends - many), many) + np.arange(ends[-1])]  # places in short
    place = take[near]
    doc = np.searchsorted(doc_start, place, side="right") - 1
    change = np.zeros(len(words) + 1, np.int32)
    np.add.at(change, place, 1)
    np.add.at(change, place + bench.lengths[which], -1)
    marks = np.cumsum(change[:-1]) > 0
    out = list(clean)
    by_doc = np.argsort(doc, kind="stable")
    cuts = np.flatnonzero(np.diff(doc[by_doc], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(by_doc)]):
        d = int(doc[by_doc[a]])
        items = set(bench.items_of(np.unique(which[by_doc[a:b]])).tolist())
        out[d] = (marks[doc_start[d] : doc_start[d] + size[d]], items, *clean[d][2:])
    return out


def longest(words: np.ndarray, doc_start: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document the longest verbatim match with an item: (words, place in ``words``, item),
    be it shorter than a window or longer.

    Places are ranked among the benchmark's stretches of 1, 2, 4, ... words as long as any is one.
    From a document's places of its highest level, the range of the benchmark's suffix array that
    begins alike is narrowed by half the words each time.
    """
    found, at, item = np.zeros(len(doc_start), np.int64), doc_start - 1, np.full(len(doc_start), -1)
    doc_of = lambda place: np.searchsorted(doc_start, place, side="right") - 1
    place = np.flatnonzero(words)
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    kind = words[place].astype(np.int64) + 1
    top = np.full(len(doc_start), -1)
    while len(place):
        top[doc_of(place)] = len(levels)
        levels.append((place, kind))
        keys, width = bench.pairs(len(levels) - 1)
        behind = rank_at(levels[-1], place + (1 << len(levels) - 1))
        key = kind * width + behind
        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        ok = (behind > 0) & (keys[k] == key)
        place, kind = place[ok], k[ok] + 1
    order = bench.order(len(levels))
    for level, (place, kind) in enumerate(levels):
        of = doc_of(place)
        sel = top[of] == level
        p, of = place[sel], of[sel]
        if not len(p):
            continue
        ranks = bench.rank(level)[order]
        lo, hi = (np.searchsorted(ranks, kind[sel].astype(ranks.dtype), side=side) for side in ("left", "right"))
        n = np.full(len(p), 1 << level, np.int64)
        for k in reversed(range(level)):
            rank = rank_at(levels[k], p + n)
            a, b = (narrow(bench.rank(k), order, n, lo, hi, rank, upper) for upper in (False, True))
            ok = (rank > 0) & (a < b)
            lo, hi, n = np.where(ok, a, lo), np.where(ok, b, hi), np.where(ok, n + (1 << k), n)
        best = np.lexsort((p, -n, of))
        best = best[np.flatnonzero(np.diff(of[best], prepend=-1))]
        found[of[best]], at[of[best]] = n[best], p[best]
        item[of[best]] = np.searchsorted(bench.starts, order[lo[best]], side="right") - 1
    return found, at, item


def rank_at(level: tuple[np.ndarray, np.ndarray], place: np.ndarray) -> np.ndarray:
    """The rank at each place, 0 where the level has none."""
    places, ranks = level
    i = np.minimum(np.searchsorted(places, place), len(places) - 1)
    return np.where(places[i] == place, ranks[i], 0)


def narrow(rank: np.ndarray, order: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, upper: bool) -> np.ndarray:
    """In each range of ``order`` the first (``upper``: behind the last) place whose rank ``n`` words on is ``wanted``."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        at = np.flatnonzero(open_)
        mid = (lo[at] + hi[at]) // 2
        there = rank[order[mid] + n[at]]
        right = there <= wanted[at] if upper else there < wanted[at]
        lo[at] = np.where(right, mid + 1, lo[at])
        hi[at] = np.where(right, hi[at], mid)
    return lo


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, null_ids: bool = False) -> list[str]:
    """The benchmark's items, written by Spark to the shared folder in files of bounded text (a single
    larger item is a file of its own): the files."""
    items = pick(benchmark, "item_id", "text").where("text is not null").where(F.lit(null_ids) | F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("id"), "text")
    total = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, size = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            block = []
            for text in batch.column("text"):
                more = 4 * len(text.as_py())
                if size and size + more > block_bytes:
                    n, size = n + 1, 0
                size += more
                block.append(f"{task}-{n}")
            yield pa.record_batch([pa.array(block, pa.string()), batch.column("id"), batch.column("text")], names=["block", "id", "text"])

    spark = benchmark.sparkSession
    path = work_folder(spark, "benchmark")
    parts = max(1, -(-4 * total // block_bytes))
    items.distinct().coalesce(parts).mapInArrow(cut, "block string, id string, text string").write.partitionBy("block").parquet(path)
    return sorted(spark.read.schema("id string, text string").parquet(path).inputFiles())


def opened(file: str, window: int) -> Benchmark:
    where, path = file_system(file)
    with where.open_input_file(path) as f:
        t = pq.read_table(f, columns=["id", "text"])
    items = zip(t.column("id").to_pylist(), t.column("text").to_pylist())
    return Benchmark(sorted(items, key=lambda i: (i[0] or "", i[1])), window)


def scan(text: Column, files: list[str], window: int) -> Column:
    """A row's findings.  Each shard is searched for one block after the other; only one is open at a time."""

    def joined(t: list[bytes], old: dict, bench: Benchmark, result: tuple[np.ndarray | None, set[int], int, int, int]) -> dict:
        marks, found, n, at, item = result
        best = (n, at, bench.ids[item]) if n > old["longest"] else (old["longest"], old["longest_at"], old["longest_item"])
        hit = np.zeros(len(t) + 2, bool)
        if marks is not None:
            hit[1:-1] = marks
        for a, b in zip(old["spans"][::2], old["spans"][1::2]):
            hit[a + 1 : b + 2] = True
        edges = np.flatnonzero(hit[1:] != hit[:-1])
        spans = np.column_stack([edges[::2], edges[1::2] - 1]).ravel()
        ids = {bench.ids[i] for i in found}.union(old["items"])
        return {"n_words": len(t), "spans": spans.tolist(), "items": sorted(ids, key=lambda i: (i is None, i or "")), "longest": best[0], "longest_at": best[1], "longest_item": best[2]}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        last: tuple[str, Benchmark] | None = None
        turn = list(files)

        def shard(texts: list[list[bytes]]) -> list[dict]:
            nonlocal last
            out = [{"n_words": len(t), "spans": [], "items": [], "longest": 0, "longest_at": -1, "longest_item": None} for t in texts]
            for file in turn if texts else ():
                if last is None or last[0] != file:
                    last = None  # given up before the next one is opened
                    last = file, opened(file, window)
                out = [joined(t, old, last[1], r) for t, old, r in zip(texts, out, search(texts, last[1]))]
            # the block that is open is the next shard's first
            turn.reverse()
            return out

        for batch in batches:
            rows, texts, n = [], [], 0
            for t in batch:
                texts.append(words_of(t.as_py()))
                n += len(texts[-1])
                if n >= SHARD_WORDS:
                    rows += shard(texts)
                    texts, n = [], 0
            yield pa.array(rows + shard(texts), _FOUND)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, FOUND)(text)


def find(docs: DataFrame, text: str, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, null_ids: bool = False) -> DataFrame:
    """``docs`` with a column ``found`` (see ``FOUND``): words, hit spans, items and the longest match."""
    return docs.withColumn("found", scan(F.col(text), blocks(benchmark, block_bytes, null_ids), window))


def n_hit(found: Column) -> Column:
    """Hit words, from the spans (first and last word, in turn)."""
    signed = F.transform(found["spans"], lambda x, i: F.when(i % 2 == 0, -x).otherwise(x + 1))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)


def is_contaminated(found: Column) -> Column:
    return (n_hit(found) > 0) & (SHARE * n_hit(found) >= found["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    hidden, at = marked(docs)
    return unmarked(find(hidden, at[text], benchmark, window, null_ids=True).where(~is_contaminated(F.col("found"))), docs)
