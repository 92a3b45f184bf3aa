"""SimHash near-duplicates by anchor-point covering.

Fingerprints: a text's words (A-Z lower-cased, split at ASCII white space) in shingles, repeats
included; a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42).

Anchors: the fingerprint's low bits are cut into blocks, each with a perfect code (binary Golay
code on 23 bits with covering radius 3, Hamming code on 15 bits with radius 1).  An anchor is one
codeword per block.  Every fingerprint has a home, the anchor of its nearest codewords, at most the
covering radius away in each block.  A fingerprint at distance t from it lies within radius plus
the bits by which the two differ in that block, t over all blocks; so each fingerprint visits every
anchor within covering radius plus its part of the threshold.  All links are found where a visitor
meets a home, by comparing all 64 bits.  No pair within the threshold is missed, and none is
compared that shares no anchor.  Work is done on distinct fingerprints, so copies don't multiply.

Two Golay blocks make 2^24 anchors with 61 visits each; for very many fingerprints a third block
of the Hamming code divides the anchors by 2^11 more.  The choice changes the cost alone.

Defined results: a null text and one without words have the fingerprint 0 and are linked like
others; a shorter text than a shingle is one shingle; repeated rows share their component; a null
doc_id is never a component's id unless all its ids are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import marked, stored, unmarked
from quire.llm.components import connected_components
from quire.session import cut_lineage

#: Length, generator polynomial and covering radius of the perfect codes.
GOLAY = (23, 0b110001110101, 3)
HAMMING = (15, 0b10011, 1)
#: Distinct fingerprints above which the third block pays for its visits.
THIRD_BLOCK_FROM = 1 << 28
#: Fingerprints that one task turns into visits.
VISITS_PER_TASK = 1 << 15

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint_of(text: str | None, words: int) -> int:
    """The 64-bit fingerprint of one text, as a signed number."""
    import xxhash

    w = (text or "").encode("utf-8").lower().split()  # bytes: only ASCII letters and white space count
    if not w:
        return 0
    join, h = b" ".join, xxhash.xxh64_intdigest
    shingles = map(join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [join(w)]
    hashes = np.fromiter((h(s, 42) for s in shingles), np.uint64)
    places = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + (np.arange(8) << 8)
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(2 * counts.ravel() > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    """A text's fingerprint (long, its 64 bits)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.fromiter((fingerprint_of(t.as_py(), words) for t in batch), np.int64, len(batch)))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "long")(text)


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def syndromes(code: tuple[int, int, int]) -> np.ndarray:
    """The syndrome (remainder by the generator) of each single bit of a block."""
    n, g, _ = code
    out, x = [], 1
    for _ in range(n):
        out.append(x)
        x <<= 1
        if x >> (g.bit_length() - 1) & 1:
            x ^= g
    return np.array(out, np.int64)


@lru_cache(maxsize=8)
def patterns(code: tuple[int, int, int], threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For k = 0..threshold the error patterns that lead from a block to its codewords: at k = 0
    to the one within the covering radius, else to those at radius + k.

    Each as (offsets by syndrome, patterns in order of syndrome).
    """
    n, g, radius = code
    bits, size = syndromes(code), 1 << (g.bit_length() - 1)
    levels = []
    for k in range(threshold + 1):
        found = []
        for weight in range(0, radius + 1) if k == 0 else (radius + k,):
            for at in combinations(range(n), weight):
                found.append((int(np.bitwise_xor.reduce(bits[list(at)])) if at else 0, sum(1 << i for i in at)))
        found.sort()
        s, e = np.array([f[0] for f in found]), np.array([f[1] for f in found], np.int64)
        levels.append((np.searchsorted(s, np.arange(size + 1)), e))
    return levels


def anchors(fps: np.ndarray, codes: list[tuple[int, int, int]], threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(place in ``fps``, anchor, whether it is the home) of all visits, in parts: one part for each
    way to share the threshold among the blocks."""
    blocks, shift = [], 0
    for code in codes:
        value = (fps >> np.int64(shift)) & np.int64((1 << code[0]) - 1)
        syndrome = np.zeros(len(fps), np.int64)
        for i, s in enumerate(syndromes(code)):
            syndrome ^= np.where(value >> i & 1, s, 0)
        blocks.append((value, syndrome, patterns(code, threshold), code[0]))
        shift += code[0]
    for share in product(range(threshold + 1), repeat=len(codes)):
        if sum(share) > threshold:
            continue
        who, anchor = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        for (value, syndrome, levels, n), k in zip(blocks, share):
            at, errors = levels[k]
            s = syndrome[who]
            many = at[s + 1] - at[s]
            ends = np.cumsum(many)
            pick = np.repeat(at[s] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
            who, anchor = np.repeat(who, many), np.repeat(anchor, many)
            anchor = (anchor << np.int64(n)) | (value[who] ^ errors[pick])
        yield who, anchor, not any(share)


def visits(fps: DataFrame, codes: list[tuple[int, int, int]], threshold: int, home_only: bool) -> DataFrame:
    """(anchor, fp) of a one-column table of distinct fingerprints: homes, or all visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(all_fps), 2048):
                part = all_fps[start : start + 2048]
                for who, anchor, _ in anchors(part, codes, 0 if home_only else threshold):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[who])], ["anchor", "fp"])

    return fps.mapInArrow(run, "anchor long, fp long")


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """(a, b), a < b: all pairs of a one-column table of distinct fingerprints that differ in at most
    ``threshold`` bits."""
    n = fps.count()
    codes = [GOLAY, GOLAY] + [HAMMING] * (n > THIRD_BLOCK_FROM)
    spread = fps.toDF("fp").repartition(max(fps.sparkSession.sparkContext.defaultParallelism, -(-n // VISITS_PER_TASK)))
    v = visits(spread, codes, threshold, False).alias("v")
    h = visits(spread, codes, threshold, True).alias("h")
    near = F.bit_count(F.col("v.fp").bitwiseXOR(F.col("h.fp"))) <= threshold
    return v.join(h, (F.col("v.anchor") == F.col("h.anchor")) & (F.col("v.fp") < F.col("h.fp")) & near).select(F.col("v.fp").alias("a"), F.col("h.fp").alias("b")).distinct()


def classes(rows: DataFrame, threshold: int = 2) -> DataFrame:
    """(fp, component, component_id) of a table (doc_id, fp): the component's smallest fingerprint and
    the smallest doc_id that links reach."""
    least = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fp")
    found = cut_lineage(connected_components(links(least.select("fp"), threshold)), "simhash-components")
    named = least.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(ids, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, threshold: int = 2) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of ``docs``."""
    hidden, at = marked(docs)
    rows = cut_lineage(hidden.select(F.col(at[doc_id]).alias("doc_id"), fingerprint(F.col(at[text]), words).alias("fp")), "simhash")
    return rows.join(classes(rows, threshold), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, threshold: int = 2) -> DataFrame:
    """The rows of ``docs``, one of each component: that with the smallest doc_id (nulls last; of rows
    that share it, any one).  The rows are written once with their fingerprint and a number."""
    hidden, at = marked(docs)
    numbered = stored(hidden.select("*", fingerprint(F.col(at[text]), words).alias("fp"), F.monotonically_increasing_id().alias("row")), "simhash-docs")
    rows = numbered.select(F.col(at[doc_id]).alias("doc_id"), "fp", "row")
    known = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    named = cut_lineage(rows.join(classes(rows.select("doc_id", "fp"), threshold), "fp").select("component", "row", known.alias("known")), "simhash-rows")
    first = named.groupBy("component").agg(F.min("known").alias("first"))
    goes = named.join(first, "component").where(F.col("row") != F.col("first.row")).select("row")
    return unmarked(numbered.join(goes, "row", "left_anti"), docs)
