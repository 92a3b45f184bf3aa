"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1.  An n-gram's vector binds (multiplies) its
letters' vectors, each permuted (rotated) once per place that it stands before the last; a text's
vector bundles (adds) its n-grams' vectors, and a language's prototype those of its training texts.
A text has the language whose prototype has the largest cosine with its vector.

Letters are lower-cased; every run of other characters counts as one space.  A letter's vector
follows from its code point and the seed, so no alphabet is fixed.  N-grams are counted first, and
each distinct one is bound once per worker.

Prototypes are learnt from a bounded sample of labelled documents, ``SAMPLE`` of each language at
most in expectation, chosen by the hash of their id; their vectors are added up by Spark.

Defined results: ``und`` with score 0 if a text is null or has no letter, or if there is nothing to
learn from; ties go to the first language in order; repeated rows are judged alike (in training
they count each time); rows without id or language teach nothing; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import id_bucket, pick

#: Dimensions of the vectors, letters of an n-gram, the seed, and training documents of a language.
DIMENSIONS = 1024
GRAM = 3
SEED = 9
SAMPLE = 2_000
#: Languages that can be learnt; a column with more values isn't one of languages, and is refused.
LANGUAGES = 2_000
#: Bound n-grams that a worker keeps.
CACHE = 20_000
SPACE = 32
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1 << 16)
def letter_vector(code_point: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng([SEED, code_point]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1


def bind(gram: int, dimensions: int) -> np.ndarray:
    """The vector of an n-gram packed as 21 bits a letter, the last letter lowest."""
    out = np.ones(dimensions, np.int8)
    for place in range(GRAM):
        out = out * np.roll(letter_vector((gram >> (21 * place)) & 0x1FFFFF, dimensions), place)
    return out


class _Space:
    """A worker's bound n-grams, in one matrix."""

    def __init__(self, dimensions: int):
        self.dimensions, self.place = dimensions, {}
        self.matrix = np.zeros((CACHE, dimensions), np.float32)

    def vectors(self, grams: list[int]) -> np.ndarray:
        if len(self.place) + len(grams) > CACHE:
            self.place = {}
        if len(grams) > CACHE:
            return np.array([bind(g, self.dimensions) for g in grams], np.float32)
        for g in grams:
            if g not in self.place:
                at = self.place[g] = len(self.place)
                self.matrix[at] = bind(g, self.dimensions)
        return self.matrix[[self.place[g] for g in grams]]

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The vector of a text, or None if it has no letter."""
        grams, counts = ngrams(text)
        if not len(grams):
            return None
        out = np.zeros(self.dimensions, np.float64)
        for at in range(0, len(grams), 4096):
            out += counts[at : at + 4096].astype(np.float32) @ self.vectors(grams[at : at + 4096].tolist())
        return out


_SPACES: dict[int, _Space] = {}


def space(dimensions: int) -> _Space:
    """This worker's bound n-grams; made once."""
    if dimensions not in _SPACES:
        _SPACES[dimensions] = _Space(dimensions)
    return _SPACES[dimensions]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed n-grams of a text, framed by spaces, and their counts."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.concatenate([[SPACE], np.where(letter, points, SPACE), [SPACE]]).astype(np.int64)
    points = points[np.concatenate([[True], (points[1:] != SPACE) | (points[:-1] != SPACE)])]
    packed = np.zeros(len(points) - GRAM + 1, np.int64)
    for i in range(GRAM):
        packed = (packed << 21) | points[i : len(points) - GRAM + 1 + i]
    return np.unique(packed, return_counts=True)


def bundled(rows: DataFrame, dimensions: int) -> DataFrame:
    """(lang, vector) partial sums of a table (text, lang): one row for each language of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = space(dimensions), {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                v = own.bundle(text.as_py())
                if v is not None:
                    sums[lang.as_py()] = sums.get(lang.as_py(), 0) + v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "vector"])

    return rows.select("text", "lang").mapInArrow(run, "lang string, vector array<double>")


def learn(docs: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """The languages in order, and their prototypes (unit length, one a row).

    ``docs``: doc_id, text, lang.  Only (languages x dimensions) sums reach the driver, at most
    ``LANGUAGES`` of them.
    """
    known = docs.where("lang is not null and doc_id is not null").where(id_bucket(F.col("doc_id"), 4) != 2)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} values of lang")
    share = F.lit(None).cast("long")
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, int(1_000_000 * min(1.0, sample / n))).otherwise(share)
    few = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    parts = bundled(few, dimensions).select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    sums: dict[str, np.ndarray] = {}
    for r in parts.collect():
        sums.setdefault(r["lang"], np.zeros(dimensions))[r["at"]] = r["x"]
    langs = sorted(sums)
    m = np.array([sums[k] / max(np.linalg.norm(sums[k]), 1e-12) for k in langs]).reshape(-1, dimensions)
    return langs, m


def predict(text: Column, langs: list[str], prototypes: np.ndarray) -> Column:
    """struct(lang_pred, score): the language of the largest cosine, and that cosine (at least 0)."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = space(prototypes.shape[1]) if langs else None
        for batch in batches:
            out = []
            for t in batch:
                v = own.bundle(t.as_py()) if own else None
                if v is None:
                    out.append({"lang_pred": UNKNOWN, "score": 0.0})
                    continue
                cosines = prototypes @ v / max(np.linalg.norm(v), 1e-12)
                best = int(cosines.argmax())
                out.append({"lang_pred": langs[best], "score": float(min(max(cosines[best], 0.0), 1.0))})
            yield pa.array(out, kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<lang_pred:string,score:double>")(text)


def identify(docs: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of ``docs``."""
    d = pick(docs, "doc_id", "text", "lang")
    langs, prototypes = learn(d, sample, dimensions)
    held_out = F.coalesce(id_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    return d.select("doc_id", held_out.alias("held_out"), predict(F.col("text"), langs, prototypes).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
