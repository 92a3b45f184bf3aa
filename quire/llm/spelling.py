"""Spelling variants: words one edit apart, found by search schemes over a bidirectional FM-index.

Two words are near if exactly one inserted, deleted or replaced code point separates them; then the
left or the right half of one stands unchanged at the same end of the other.  The scheme is therefore:
match one half exactly, then extend across the other half allowing one error, once from either end.
The index is a pair of FM-indexes over the delimited vocabulary, one to extend to the right (over
the reversed words, entered at the words' beginnings) and one to extend to the left (entered at
their ends).  A match is an interval of suffix ranks; extending it by a symbol maps both ends by one
search in the sorted (symbol, rank) pairs of the Burrows-Wheeler transform.  All words of a block
are searched together, an array operation a step.

At scale, a word meets only words that share one of its halves at the same end: the vocabulary is
dealt to tasks by that half (a word goes along under the two half lengths that a partner can have at
either end).  A task builds one index for about ``INDEX_WORDS`` words, whole halves together; a half
with more than that is cut into pieces, each with its own index, which all words of that half visit.
Pairs stay in their task: only counts and the best partner of a word leave it, and a pair that both
directions find is counted by the first.

Defined results: a null text has no words; a null id counts as empty text in the hash that plants
edits; rows of one id count each; words of any length are searched; an empty table, or one
without repeated words, gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import pick
from quire.session import cut_lineage

#: Fixed values of the contract: the letters, the shortest word, the fewest occurrences, one run in
#: ``EDITED`` loses a code point, and how many times as frequent a word's form is.
LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, FEWEST, EDITED, FACTOR = 7, 2, 31, 10
#: Distinct words that a task holds before it hands their counts on.
COUNTED_WORDS = 200_000
#: Words of one index, and of one search.
INDEX_WORDS = 50_000
SEARCHED_WORDS = 20_000


# ---- vocabulary


def edited(run: str, crc: int) -> str:
    """The run without one code point, if its hash says so."""
    if crc % EDITED:
        return run
    at = crc % len(run)
    return run[:at] + run[at + 1 :]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = re.compile(f"[{LETTERS}]{{{SHORTEST},}}").findall
    total: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            lower = (text.as_py() or "").encode("utf-8").lower().decode("utf-8")  # bytes: only A-Z change
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in Counter(runs(lower)).items():
                crc = zlib.crc32(run.encode("utf-8"), start)
                word = run if crc % EDITED else edited(run, crc)
                if len(word) >= SHORTEST:
                    total[word] += n
            if len(total) >= COUNTED_WORDS:
                yield out()
                total.clear()
    yield out()


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of all texts that occur often enough."""
    rows = pick(docs, doc_id, text).toDF("doc_id", "text").select(F.col("doc_id").cast("string"), "text")
    return rows.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= FEWEST)


# ---- index


class Words:
    """Strings as one array of symbols (from 1 on), and where each begins."""

    def __init__(self, words: list[str], alphabet: np.ndarray, backwards: bool):
        self.lens = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        codes = np.searchsorted(alphabet, points) + 1
        self.ends = np.cumsum(self.lens)
        self.begins = self.ends - self.lens
        if backwards:  # each word on its own
            codes = codes[np.repeat(self.begins + self.ends - 1, self.lens) - np.arange(len(codes))]
        self.codes = codes


class Index:
    """One direction of the FM-index: words extended symbol by symbol from their first one.

    The text is each word reversed, with a delimiter (0) behind; suffixes are compared up to their
    delimiter and then by word number.
    """

    def __init__(self, words: Words, symbols: int):
        many = len(words.lens)
        size = len(words.codes) + many
        text = np.zeros(size, np.int64)
        number = np.repeat(np.arange(many), words.lens)
        back = np.repeat(words.begins + words.ends - 1, words.lens) - np.arange(len(words.codes))
        text[np.arange(len(words.codes)) + number] = words.codes[back]
        ends = words.ends + np.arange(many)
        # prefix doubling; delimiters have ranks of their own, so every suffix ends up with one
        rank = text + many
        rank[ends] = np.arange(many)
        step = 1
        while True:
            order = np.argsort(rank, kind="stable")
            ranked = rank[order]
            new = np.append(False, ranked[1:] != ranked[:-1])
            dense = np.empty(size, np.int64)
            dense[order] = np.cumsum(new)
            if new[1:].all():
                break
            rank = dense * size + dense[np.minimum(np.arange(size) + step, size - 1)]
            step *= 2
        self.many, self.symbols, self.size = many, symbols, size
        before = text[order - 1]
        before[order == 0] = 0
        self.before = before
        self.word = np.searchsorted(ends, order)
        self.pairs = np.sort(before * (size + 1) + np.arange(size))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals after one more symbol."""
        at = symbol * (self.size + 1)
        return np.searchsorted(self.pairs, at + lo), np.searchsorted(self.pairs, at + hi)

    def children(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, symbol): the symbols by which each interval can be extended (and maybe others, for wide ones)."""
        wide = np.flatnonzero(hi - lo > 2 * self.symbols)
        thin = np.flatnonzero(hi - lo <= 2 * self.symbols)
        n = (hi - lo)[thin]
        ends = np.cumsum(n)
        rows = np.repeat(lo[thin] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        seen = np.unique(np.repeat(thin, n) * (self.symbols + 1) + self.before[rows])
        place, symbol = seen // (self.symbols + 1), seen % (self.symbols + 1)
        real = symbol > 0
        every = np.arange(1, self.symbols + 1)
        return np.concatenate([place[real], np.repeat(wide, self.symbols)]), np.concatenate([symbol[real], np.tile(every, len(wide))])

    def near(self, words: Words, exact: np.ndarray, lo_word: int, hi_word: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, word of the index), each pair once: those of ``words`` in a range whose first ``exact`` symbols
        match and whose others match with exactly one error."""
        q = np.arange(lo_word, hi_word)
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), self.many)

        def step(q, pos, lo, hi):
            return self.extend(words.codes[words.begins[q] + pos], lo, hi)

        for t in range(int(exact[q].max()) if len(q) else 0):
            on = exact[q] > t
            lo[on], hi[on] = step(q[on], t, lo[on], hi[on])
            alive = lo < hi
            q, lo, hi = q[alive], lo[alive], hi[alive]
        pos, one = exact[q].copy(), [np.zeros(0, np.int64)] * 4  # states without and with the error
        found = []
        while len(q) or len(one[0]):
            # states with the error: words that end here are found, the others go on exactly
            ends = one[1] == words.lens[one[0]]
            oq, _, olo, ohi = (x[ends] for x in one)
            n = ohi - olo
            stops = np.cumsum(n)
            rows = np.repeat(olo - (stops - n), n) + np.arange(stops[-1] if len(stops) else 0)
            whole = self.before[rows] == 0
            found.append(np.repeat(oq, n)[whole] * np.int64(self.many) + self.word[rows[whole]])
            oq, opos, olo, ohi = (x[~ends] for x in one)
            olo, ohi = step(oq, opos, olo, ohi)
            grown = [(oq, opos + 1, olo, ohi)]
            # states without: one symbol more in the index (inserted), another one (replaced), or one less (deleted)
            place, symbol = self.children(lo, hi)
            clo, chi = self.extend(symbol, lo[place], hi[place])
            cq, cpos = q[place], pos[place]
            grown.append((cq, cpos, clo, chi))
            inside = cpos < words.lens[cq]
            other = inside.copy()
            other[inside] = words.codes[words.begins[cq[inside]] + cpos[inside]] != symbol[inside]
            grown.append((cq[other], cpos[other] + 1, clo[other], chi[other]))
            inside = pos < words.lens[q]
            q, pos, lo, hi = q[inside], pos[inside], lo[inside], hi[inside]
            grown.append((q, pos + 1, lo, hi))
            one = [np.concatenate(c) for c in zip(*grown)]
            alive = one[2] < one[3]
            one = [x[alive] for x in one]
            lo, hi = step(q, pos, lo, hi)
            alive = lo < hi
            q, pos, lo, hi = q[alive], pos[alive] + 1, lo[alive], hi[alive]
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs // self.many, pairs % self.many


def near_words(words: list[str], asks: np.ndarray, answers: np.ndarray, left: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (places in ``words``) of one that asks and one that answers, near each other, with the left half
    of the first exact, or with ``left`` false its right half but not the left."""
    ask, answer = np.flatnonzero(asks), np.flatnonzero(answers)
    if not len(ask) or not len(answer):
        return
    asking, answering = [words[i] for i in ask], [words[i] for i in answer]
    alphabet = np.unique(np.frombuffer("".join(asking + answering).encode("utf-32-le"), np.uint32))
    q = Words(asking, alphabet, not left)
    exact = q.lens // 2 if left else q.lens - q.lens // 2
    for a in range(0, len(answering), INDEX_WORDS):
        index = Index(Words(answering[a : a + INDEX_WORDS], alphabet, not left), len(alphabet))
        for b in range(0, len(asking), SEARCHED_WORDS):
            one, two = index.near(q, exact, b, min(b + SEARCHED_WORDS, len(asking)))
            one, two = ask[one], answer[a + two]
            if not left:
                fresh = np.array([words[i][: len(words[i]) // 2] != words[j][: len(words[i]) // 2] for i, j in zip(one, two)], bool)
                one, two = one[fresh], two[fresh]
            yield one, two


# ---- job


def _half(word: Column, size: Column, left: bool) -> Column:
    return F.substring(word, F.lit(1), size) if left else F.substring(word, F.length(word) - size + 1, size)


def _dealt(words: DataFrame) -> DataFrame:
    """(key, left, word, n, asks, answers): a word under the halves by which it can meet others.

    A word asks under its own halves and answers under those of every length a partner can have.
    """
    w, m = F.col("word"), F.length("word")
    entries = []
    for left in (True, False):
        def size(length: Column, left: bool = left) -> Column:
            half = F.floor(length / 2).cast("int")
            return half if left else length - half

        own = size(m)
        for partner in (m - 1, m + 1):  # one of these has a half as long as the word's own
            s = size(partner)
            fits = (s == own) | (partner >= SHORTEST)
            entries.append(F.when(fits, F.struct(F.xxhash64(F.lit(left), _half(w, s, left)).alias("key"), F.lit(left).alias("left"), (s == own).alias("asks"))))
    rows = words.select("word", "n", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("word", "n", "e.*")
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > INDEX_WORDS).select("key", F.ceil(F.col("size") / INDEX_WORDS).cast("int").alias("pieces"))
    cut = rows.join(hot, "key", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("word"), F.col("pieces")))
    cut = cut.withColumn("piece", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(F.array(F.col("own").cast("int")))))
    return cut.select(F.when(F.col("pieces") > 1, F.xxhash64("key", "piece")).otherwise(F.col("key")).alias("key"), "left", "word", "n", "asks", (F.col("own") == F.col("piece")).alias("answers"))


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, best n, best word) of rows in order of key, about ``INDEX_WORDS`` at a time, whole keys."""

    def searched(part: pa.Table) -> Iterator[pa.RecordBatch]:
        for side in (True, False):
            rows = part.filter(pa.compute.equal(part.column("left"), side))
            words, n, asks, answers = (rows.column(c).to_pylist() for c in ("word", "n", "asks", "answers"))
            # a word may be here under several keys
            flags: dict[str, list] = {}
            for w, k, a, b in zip(words, n, asks, answers):
                f = flags.setdefault(w, [k, False, False])
                f[1] |= a
                f[2] |= b
            words = list(flags)
            counts = np.array([f[0] for f in flags.values()], np.int64)
            many = np.zeros(len(words), np.int64)
            best: list[tuple[int, str] | None] = [None] * len(words)
            for one, two in near_words(words, np.array([f[1] for f in flags.values()], bool), np.array([f[2] for f in flags.values()], bool), side):
                many += np.bincount(one, minlength=len(words))
                for i, j in zip(one.tolist(), two.tolist()):
                    other = (-int(counts[j]), words[j])
                    if best[i] is None or other < best[i]:
                        best[i] = other
            hit = np.flatnonzero(many).tolist()
            cols = [pa.array([words[i] for i in hit], pa.string()), pa.array(many[hit], pa.int64()), pa.array([best[i][0] for i in hit], pa.int64()), pa.array([best[i][1] for i in hit], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["word", "n_near", "minus", "partner"])

    held, rows = [], 0
    for batch in batches:
        keys = batch.column("key").to_numpy()
        if rows >= INDEX_WORDS and len(keys):  # cut before the first key that isn't the last one held
            last = held[-1].column("key")[-1].as_py()
            new = np.flatnonzero(keys != last)
            if len(new):
                held.append(batch.slice(0, int(new[0])))
                yield from searched(pa.Table.from_batches(held))
                held, rows, batch = [], 0, batch.slice(int(new[0]))
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield from searched(pa.Table.from_batches(held))


def partners(words: DataFrame) -> DataFrame:
    """(word, n_near, minus, partner): how many near words each word has, and of these the most frequent one
    (ties: the first in code-point order) with its negated count.  ``words``: (word, n), each word once."""
    tasks = 1 + words.count() // INDEX_WORDS  # tasks grow in number, not in size; a word is dealt four times
    spread = _dealt(words).repartition(tasks, "key").sortWithinPartitions("key")
    found = spread.mapInArrow(_partners, "word string, n_near long, minus long, partner string")
    best = F.min(F.struct("minus", "partner")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain of forms, by pointer jumping."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        next_ = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = cut_lineage(now.join(next_, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if joined.where("moved").isEmpty():
            return joined.select("word", "root")
        now = joined.select("word", "root")


def group_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of the texts."""
    words = cut_lineage(vocabulary(docs, doc_id, text), "spelling-words")
    found = words.join(partners(words), "word", "left")
    is_form = -F.col("minus") >= FACTOR * F.col("n")
    named = cut_lineage(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("partner")).alias("form"), F.when(is_form, -F.col("minus")).alias("form_n")), "spelling-forms")
    ends = roots(named.where("form is not null"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
