"""Byte-level BPE encoding and decoding with a sentencepiece model serialised from the vocabulary.

A text is cut into pre-tokens by a pattern.  A pre-token that is itself a token has that id; any
other is mapped to the byte alphabet and merged by sentencepiece (see ``vocab``).  Decoding is the
inverse mapping, id to bytes.

Defined results: a null text counts as empty; an empty text has no ids and decodes to no bytes;
repeated rows are encoded alike; further columns stay.  The vocabulary (about 1 MB) travels with
the function; each Python worker builds its model once and keeps a bounded cache of pre-tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.llm import vocab

#: Entries at which a worker's pre-token cache is emptied, and the longest pre-token (characters) that stays in it.
CACHE_ENTRIES = 100_000
CACHE_CHARS = 32
#: Ids after which a worker hands its rows on, which bounds its memory (but for a single longer text).
PART_IDS = 1 << 17

_ENCODERS: dict[tuple[int, str], Callable[[str], list[int]]] = {}


def _encoder(model: bytes, tokens: tuple[bytes, ...], pattern: str) -> Callable[[str], list[int]]:
    """This worker's encoder of one text."""
    key = (hash(model), pattern)
    if key in _ENCODERS:
        return _ENCODERS[key]
    import regex
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    whole = {t: (i,) for i, t in enumerate(tokens)}
    cut, cache = regex.compile(pattern).findall, {}

    def fill(missing: list[str]) -> list[tuple[int, ...]]:
        raw = [m.encode("utf-8") for m in missing]
        out = [whole.get(b) for b in raw]
        at = [i for i, ids in enumerate(out) if ids is None]
        if at:
            for i, ids in zip(at, sp.encode([vocab.mapped(raw[i]) for i in at], out_type=int, num_threads=1)):
                out[i] = tuple(ids)
        return out

    def encode(text: str) -> list[int]:
        pieces = cut(text)
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        missing = list(set(pieces).difference(cache))
        if missing:
            cache.update(zip(missing, fill(missing)))
        ids = list(chain.from_iterable(map(cache.__getitem__, pieces)))
        for long in [m for m in missing if len(m) > CACHE_CHARS]:
            del cache[long]
        return ids

    _ENCODERS[key] = encode
    return encode


def encode(text: Column, vocabulary: str, pattern: str) -> Column:
    """The ids (ranks) of a text, an array<int> column."""
    model, tokens = vocab.sentencepiece_model(vocabulary), vocab.ranks(vocabulary)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = _encoder(model, tokens, pattern)
        for batch in batches:
            yield from map(_lists, _parts(_encoded(enc, batch)))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<int>")(text)


def _encoded(enc: Callable[[str], list[int]], batch: pa.Array) -> Iterator[np.ndarray]:
    return (np.array(enc(t.as_py() or ""), dtype=np.int32) for t in batch)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows), pa.int32()))


class _Decoder:
    """The vocabulary's bytes in one run, and where each token lies in it."""

    def __init__(self, tokens: tuple[bytes, ...]):
        self.joined = np.frombuffer(b"".join(tokens), np.uint8)
        self.lens = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens

    def rows(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each row of ids: every byte's place in the vocabulary is gathered at once."""
        flat = np.concatenate(ids)
        n = self.lens[flat]
        ends = np.cumsum(n)
        where = np.repeat(self.starts[flat] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        data = self.joined[where].tobytes()
        at = np.concatenate([[0], ends])[np.cumsum([0, *map(len, ids)])].tolist()
        return [data[a:b] for a, b in zip(at, at[1:])]


def _parts(rows: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Rows of ids in runs of about ``PART_IDS`` ids."""
    part, n = [], 0
    for ids in rows:
        part.append(ids)
        n += len(ids)
        if n >= PART_IDS:
            yield part
            part, n = [], 0
    if part:
        yield part


def _ids_of(row: pa.ListScalar) -> np.ndarray:
    return np.zeros(0, np.int64) if row.values is None else np.asarray(row.values, dtype=np.int64)


def decode(ids: Column, vocabulary: str) -> Column:
    """The bytes that ids stand for, a binary column (null ids: no bytes)."""
    tokens = vocab.ranks(vocabulary)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = _Decoder(tokens)
        for batch in batches:
            for part in _parts(map(_ids_of, batch)):
                yield pa.array(decoder.rows(part), pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")(ids)


def encode_and_decode(text: Column, vocabulary: str, pattern: str) -> Column:
    """struct(ids, decoded): ``encode`` and then ``decode`` of its ids, in one pass through Python."""
    model, tokens = vocab.sentencepiece_model(vocabulary), vocab.ranks(vocabulary)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc, decoder = _encoder(model, tokens, pattern), _Decoder(tokens)
        for batch in batches:
            for part in _parts(_encoded(enc, batch)):
                yield pa.StructArray.from_arrays([_lists(part), pa.array(decoder.rows(part), pa.binary())], ["ids", "decoded"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<ids:array<int>,decoded:binary>")(text)


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by one space."""
    return F.array_join(ids.cast("array<string>"), " ")
