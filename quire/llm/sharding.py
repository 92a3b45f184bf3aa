"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups (rows of equal text, kept together) are placed one by one, larger ones first, each on the
shard where the dot product of its vector with the shard's residual capacity is highest.  All
components are shares of the whole corpus, so every one counts alike.  A shard's capacity in a
component is the level at which all that is still to be placed fills the shards evenly.  Bytes are
the law: where one group has more tokens or rows than an even share, that component can't be
balanced, and its capacities follow those in bytes, so that its shard is filled like any other; so
do the capacities that light groups meet.

Placing is sequential, so it is divided: groups above a ``1 / (HEAVY * shards)`` share of any
component are few by arithmetic (at most ``3 * HEAVY * shards``) and are placed first, by the driver.
The others are dealt by hash into parts of bounded size; each part places its groups against its
part of the residual capacity that the heavy ones leave.  Only a group with more bytes than a
shard can't be kept together: it is cut into pieces of about a ``PIECE`` part of a shard, by the
numbers that its rows got when they were measured, whatever their ids are.

Numbers within a shard come from counts of (shard, part) and a running number inside each part;
parts are dealt by row number, too.

Defined results: a null text has no bytes, and its rows form one group with empty texts; repeated
rows are rows of their own; null ids are allowed; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import pick
from quire.session import cut_lineage

SHARDS = 24
#: Bytes that a row takes besides its text.
ROW_BYTES = 8
#: A group is heavy from this part of a shard on; pieces of a cut group are at most this part of one.
HEAVY = 50
PIECE = 8
#: Groups that one task places, and rows that one running number covers.
GROUPS_PER_PART = 100_000
ROWS_PER_PART = 100_000

DIMS = ["bytes", "tokens", "rows"]


def tokens(text: Column) -> Column:
    """Words of a text: places where a run of other than ASCII white space ends.  Every byte of white
    space becomes a space, and words are the spaces' surplus over doubled ones."""
    flat = F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), "\t\n\u000b\u000c\r", "     "))
    return F.regexp_count(flat, F.lit(" [^ ]")).cast("long")


def place(groups: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """The shard of each group (vectors in the order of placing); ``residual`` is used up."""
    out = np.empty(len(groups), np.int64)
    for i, g in enumerate(groups):
        s = int((residual @ g).argmax())
        out[i] = s
        residual[s] -= g
    return out


def level(load: np.ndarray, todo: np.ndarray) -> np.ndarray:
    """The capacity that each shard has left in each component: up to the level to which ``todo`` fills the
    loads when poured over them; in proportion to bytes where a load is above that level already."""
    out = np.empty_like(load)
    for d in range(load.shape[1]):
        low = np.sort(load[:, d])
        # pouring over the k + 1 lowest shards gives these levels; the first one below the next shard holds
        tops = (np.cumsum(low) + todo[d]) / np.arange(1, len(low) + 1)
        room = tops[np.flatnonzero(tops <= np.append(low[1:], np.inf))[0]] - load[:, d]
        out[:, d] = np.maximum(room, 0)
        if d and (room < 0).any():
            out[:, d] = out[:, 0] * (todo[d] / max(out[:, 0].sum(), 1e-300))
    return out


def place_heavy(groups: np.ndarray, light: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shards, residual): the shard of each heavy group, with the capacities worked out anew for each, and
    the capacities left for the light ones, whose sum is ``light``."""
    load, todo = np.zeros((shards, len(DIMS))), light + groups.sum(0)
    out = np.empty(len(groups), np.int64)
    for i, g in enumerate(groups):
        out[i] = s = int((level(load, todo) @ g).argmax())
        load[s] += g
        todo = todo - g
    residual = level(load, np.maximum(todo, 0))
    # light groups fill the shards to equal bytes, and bring tokens and rows in the same proportion
    return out, np.outer(residual[:, 0] / max(residual[:, 0].sum(), 1e-300), light)


def measured(docs: DataFrame, token_count: Column | None = None) -> DataFrame:
    """(row, doc_id, size, text_crc32, digest, tokens), one numbered row per document, written once."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    count = tokens(F.col("text")) if token_count is None else token_count
    return cut_lineage(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (F.length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"), count.alias("tokens")), "shard-rows")


def groups_of(rows: DataFrame, shards: int) -> tuple[DataFrame, list[int], Column]:
    """Groups (digest, piece, bytes, tokens, rows), their totals, and the piece of a row."""
    by = lambda r, *k: r.groupBy(*k).agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    whole = cut_lineage(by(rows, "digest"), "shard-groups")
    total = [x or 0 for x in whole.agg(*[F.sum(d) for d in DIMS]).first()]
    share = F.col("bytes") / F.lit(float(max(total[0], 1)))
    oversized = whole.where((share > 1.0 / shards) & (F.col("rows") > 1)).select("digest", F.ceil(share * shards * PIECE).alias("pieces")).collect()  # fewer than shards rows
    piece = F.lit(0).cast("long")
    for r in oversized:
        piece = F.when(F.col("digest") == F.lit(bytes(r["digest"])), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(int(r["pieces"])))).otherwise(piece)
    if oversized:
        whole = cut_lineage(by(rows.withColumn("piece", piece), "digest", "piece"), "shard-groups")
    else:
        whole = whole.withColumn("piece", F.lit(0).cast("long"))
    return whole, total, piece


def pack(groups: DataFrame, total: list[int], shards: int, groups_per_part: int = GROUPS_PER_PART) -> DataFrame:
    """(digest, piece, shard) of a table of groups."""
    unit = np.array([max(t, 1) for t in total], np.float64)
    vector = [F.col(d).cast("double") / F.lit(float(u)) for d, u in zip(DIMS, unit)]
    g = groups.select("digest", "piece", F.array(*vector).alias("v")).withColumn("heavy", F.array_max("v") > 1.0 / (HEAVY * shards))
    heavy = g.where("heavy").select("digest", "piece", "v").orderBy(F.array_max("v").desc(), "digest", "piece").collect()
    light = g.where("not heavy")
    n, weight = light.agg(F.count(F.lit(1)), F.struct(*[F.sum(F.col("v")[i]) for i in range(len(DIMS))])).first()
    rest = np.array([x or 0.0 for x in weight])
    placed, residual = place_heavy(np.array([r["v"] for r in heavy]).reshape(-1, len(DIMS)), rest, shards)
    spark = groups.sparkSession
    first = spark.createDataFrame([(bytes(r["digest"]), r["piece"], int(s)) for r, s in zip(heavy, placed)], "digest binary, piece long, shard long")
    parts = max(1, -(-n // groups_per_part))

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        v = np.array(t.column("v").combine_chunks().flatten()).reshape(-1, len(DIMS))
        digests = t.column("digest").to_pylist()
        order = sorted(range(len(v)), key=lambda i: (-v[i].max(), digests[i]))
        # this part's share of what the heavy groups have left, scaled to what it has to place
        own = residual * (v.sum(0) / np.maximum(rest, 1e-300))
        shard = np.empty(len(v), np.int64)
        shard[order] = place(v[order], own)
        return pa.table([t.column("digest"), t.column("piece"), pa.array(shard)], names=["digest", "piece", "shard"])

    dealt = light.select("digest", "piece", "v", F.pmod(F.xxhash64("digest"), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInArrow(run, "digest binary, piece long, shard long").unionByName(first)


def numbered(rows: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """``rows`` (numbered, with ``shard``) with ``slot``: 0, 1, 2, ... within each shard without a gap."""
    n = rows.count()
    parts = max(1, -(-n // rows_per_part))
    r = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = r.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("row")
    return r.withColumn("at", F.row_number().over(inside)).join(offset, ["shard", "part"]).withColumn("slot", F.col("offset") + F.col("at") - 1).drop("part", "offset", "at")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per document.

    The law is ``bytes``: the shards' sizes are near equal; tokens and rows are balanced with them.
    """
    rows = measured(pick(docs, "doc_id", "text"))
    groups, total, piece = groups_of(rows, shards)
    packed = cut_lineage(pack(groups, total, shards), "shard-packed")
    placed = cut_lineage(rows.withColumn("piece", piece).join(packed, ["digest", "piece"]).select("row", "doc_id", "size", "text_crc32", "shard"), "shard-placed")
    return numbered(placed).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
