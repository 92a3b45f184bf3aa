"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A document's score is linear in features of its text.  In a pair of a preferred and a rejected
document the chance that the first is ranked higher is the logistic function of the difference of
their scores, so the weights are fitted by logistic loss on feature differences (no intercept; L2
penalty; Newton's method).  Documents are then accepted from a quantile of the scores of all
labelled training documents on: the quantile whose level is the share of rejected ones among them
(``Ranking.quantile``), so that as many are rejected as the labels reject.  It is read off an exact
histogram of their scores.

The weights are fitted on a bounded sample of labelled rows (``SAMPLE`` documents, chosen by the
hash of their id); the histogram covers every labelled training document.

Defined results: a null text is scored as an empty one; repeated label rows count once, and of
contradicting ones the lower counts; rows without id or label teach nothing; without documents of
both labels every score is 0.5, which accepts; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import id_bucket, marked, pick, stored, unmarked
from quire.session import cut_lineage

#: Labelled documents that the weights are fitted on at most (in expectation), preference pairs of
#: each document of the rarer label, the penalty, and steps of Newton's method.
SAMPLE = 12_000
PAIRS = 8
PENALTY = 1e-2
STEPS = 25
#: Scores are binned at this step and kept within these bounds in the histogram.
STEP, BOUND = 0.01, 100.0

_PUNCTUATION = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)


def features_of(text: str | None) -> np.ndarray:
    """Shares and sizes of one whole text, in fixed order; an empty text has zeros only."""
    data = (text or "").encode("utf-8")
    words = data.split()
    if not words:
        return np.zeros(_N, np.float64)
    n = len(words)
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
    lens = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in data.split(b"\n") if x]
    same = sum(a == b for a, b in zip(words, words[1:])) / n
    ends = np.fromiter((w[-1] for w in words), np.uint8, n)
    marks = np.isin(ends, _PUNCTUATION).mean()
    upper = byte[65:91].sum()
    lower = byte[97:123].sum() + byte[128:].sum()
    return np.concatenate([
        np.log1p([n, len(data), len(lines)]),
        [lens.mean() / 10, lens.std() / 10, (lens > 20).mean(), (lens == 1).mean()],
        [upper, lower, byte[48:58].sum(), byte[10], byte[32], byte[128:].sum(), upper / (upper + lower + 1e-9)],
        [same, len(set(words)) / n, len(set(lines)) / max(len(lines), 1), marks, n / max(len(lines), 1) / 100],
        np.minimum(10 * byte[_PUNCTUATION], 3.0),
        np.log1p(100 * np.array([same, marks, upper, 1 - len(set(lines)) / max(len(lines), 1)])),
    ])


_N = 3 + 4 + 7 + 5 + len(_PUNCTUATION) + 4


def features(text: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([features_of(t.as_py()) for t in batch], pa.list_(pa.float64()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<double>")(text)


@dataclass(frozen=True)
class Ranking:
    """Weights on standardised features, the score from which documents are accepted, and the level of the
    quantile that this score is."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    cut: float = 0.0
    quantile: float = 0.0

    def raw(self, text: Column) -> Column:
        """The ranking score of a text (any real number)."""
        mean, scale, w = (np.array(x) for x in (self.mean, self.scale, self.weights))

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array(np.fromiter((float((features_of(t.as_py()) - mean) / scale @ w) for t in batch), np.float64, len(batch)))

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, "double")(text)

    def probability(self, raw: Column) -> Column:
        """0 to 1; 0.5 at the cut."""
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(self.cut) - raw))


def fit_pairs(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Ranking:
    """Bradley-Terry weights of features and labels (1: preferred)."""
    if not len(x) or y.min() == y.max():
        return Ranking((0.0,) * _N, (1.0,) * _N, (0.0,) * _N)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / scale
    good, bad = z[y == 1], z[y == 0]
    few = min(len(good), len(bad))
    rng = np.random.default_rng(seed)
    a = good[rng.permutation(np.resize(np.arange(len(good)), max(len(good), few * PAIRS)))]
    b = bad[rng.permutation(np.resize(np.arange(len(bad)), len(a)))]
    d = a - b
    w = np.zeros(_N)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -35, 35)))
        g = d.T @ (p - 1) / len(d) + PENALTY * w
        h = (d * (p * (1 - p))[:, None]).T @ d / len(d) + PENALTY * np.eye(_N)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Ranking(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()))


def quantile_cut(bins: list[tuple[int, int, int]]) -> tuple[float, float]:
    """(cut, level) of bins (bin, rejected, preferred) of scores: the quantile whose level is the share of
    rejected documents, taken between bins (where the number below comes closest) in the middle of the gap."""
    bad, every = sum(b[1] for b in bins), sum(b[1] + b[2] for b in bins)
    if bad in (0, every):
        return 0.0, 0.0
    below, best = 0, (bad, bins[0][0], bins[0][0])
    for (at, b, g), after in zip(bins, [*bins[1:], None]):
        below += b + g
        best = min(best, (abs(below - bad), at + 1, at + 1 if after is None else after[0]), key=lambda x: x[0])
    return STEP * (best[1] + best[2]) / 2, bad / every


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) that may be learnt from: one row per id, quality 0 or 1."""
    known = pick(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)")
    return known.where(id_bucket(F.col("doc_id"), 3) != 1).groupBy("doc_id").agg(F.min("quality").alias("quality"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranking:
    """Weights from a bounded sample of labelled documents (docs: doc_id, text)."""
    known = training_labels(labels)
    n = known.count()
    few = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(n, 1))))
    rows = docs.join(few, "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("quality").alias("quality"))
    got = rows.select(features(F.col("text")).alias("x"), "quality").toArrow()
    x = np.array(got.column("x").combine_chunks().flatten()).reshape(-1, _N) if got.num_rows else np.zeros((0, _N))
    return fit_pairs(x, np.array(got.column("quality")))


def fit_cut(raw: DataFrame, labels: DataFrame, ranking: Ranking) -> Ranking:
    """The ranking with its cut, from the raw scores (doc_id, raw) of all labelled training documents."""
    b = F.floor(F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.col("raw"))) / STEP)
    bins = raw.join(training_labels(labels), "doc_id").groupBy(b.alias("b")).agg(F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("n0"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("n1"))
    found = sorted((r["b"], r["n0"], r["n1"]) for r in bins.collect())  # at most 2 * BOUND / STEP rows
    return Ranking(ranking.mean, ranking.scale, ranking.weights, *(quantile_cut(found) if any(ranking.weights) else (0.0, 0.0)))


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``."""
    d = pick(docs, "doc_id", "text")
    ranking = fit(d, labels, sample)
    raw = cut_lineage(d.select("doc_id", ranking.raw(F.col("text")).alias("raw")), "quality")
    ranking = fit_cut(raw, labels, ranking)
    score = ranking.probability(F.col("raw"))
    held_out = F.coalesce(id_bucket(F.col("doc_id"), 3) == 1, F.lit(False))
    return raw.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    hidden, at = marked(docs)
    ranking = fit(hidden.select(F.col(at[doc_id]).alias("doc_id"), F.col(at[text]).alias("text")), labels, sample)
    scored = stored(hidden.withColumn("raw", ranking.raw(F.col(at[text]))), "quality-docs")
    ranking = fit_cut(scored.select(F.col(at[doc_id]).alias("doc_id"), "raw"), labels, ranking)
    return unmarked(scored.where(ranking.probability(F.col("raw")) >= 0.5), docs)
