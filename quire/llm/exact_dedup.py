"""Exact deduplication as a stateful stream.

A stream reads the rows' digests and keeps, in a RocksDB state store keyed by digest and without
expiry, the largest identifier seen, the locator of its content (file and row of the table at
rest) and the number of rows.  The store is on disk, so the state may outgrow memory; a restarted
stream goes on from its checkpoint.  Rows of a task are combined before the shuffle, so a text
that holds a third of all rows reaches its key as one partial row per task.  Each micro-batch
writes the keys it changed to a folder of its own, replaced if the batch is run again.

Equal digests are hits, and hits are checked on full bytes: the content is read back and every hit
is compared with the row that its key retains.  A bit filter over the keys with hits, of fixed size,
is broadcast to the scan, so that only texts of hits (and of few others, more of them as the filter
fills) leave it.  Should texts differ (a collision), the rows of that key are grouped by their whole
text instead.

Defined results: a null text counts as empty; of equal texts the row with the largest doc_id stays
(a null id is smaller than any other), of rows that also share the id the one that lies last;
exactly one row of each group stays; an empty table gives no rows; further columns are ignored (a
table at rest must be one that Spark can read: not with two columns that differ in case alone,
unless the session is case-sensitive; ``deduplicate`` takes any DataFrame).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import marked, unmarked, work_folder

#: Input of one micro-batch, which bounds the keys that a batch changes; every later batch looks up the
#: state that the earlier ones left.
BATCH_BYTES = 128 << 20
#: Bits of the filter that keeps texts without a hit from being shuffled (2 MB, whatever the input).
FILTER_BITS = 1 << 24
_BITMAP = 1 << 15  # bits of one bitmap of Spark's bitmap functions
#: Rows are told apart by where they lie.
PLACE = ["file", "row"]

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # a batch's changes are written as a log; whole snapshots only now and then
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    # many small stores: no space taken ahead for logs that stay short
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8 (null: of no bytes), lowercase hex."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


@dataclass
class Table:
    """A Parquet table at rest: where it lies and which columns hold identifier and text."""

    path: str
    doc_id: str = "doc_id"
    text: str = "text"
    digest_bytes: int = 32

    def streamed(self) -> str:
        """The path as a pattern that fits only it: the file source takes one file by pattern alone."""
        head, _, name = self.path.rstrip("/").rpartition("/")
        return f"{head}/[{name[0]}]{name[1:]}" if head else self.path

    def rows(self, df: DataFrame, *more: Column) -> DataFrame:
        """(key, doc_id, file, row) and ``more`` of the table read by batch or stream."""
        key = F.substring(F.unhex(digest(F.col(self.text))), 1, self.digest_bytes)
        return df.select(key.alias("key"), F.col(self.doc_id).alias("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), *more)


def retained(spark: SparkSession, table: Table, work: str, **source: str) -> DataFrame:
    """Runs the stream over all files of the table; the state it ends with:
    (key, keep_id, keep_file, keep_row, n)."""
    schema = spark.read.parquet(table.path).schema
    reader = spark.readStream.schema(schema).options(**(source or {"maxBytesPerTrigger": str(BATCH_BYTES)}))
    state = table.rows(reader.parquet(table.streamed())).groupBy("key").agg(F.max(F.struct("doc_id", *PLACE)).alias("keep"), F.count(F.lit(1)).alias("n"))

    def changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/changed/batch={number}")

    with _conf(spark, _STATE):
        state.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", f"{work}/stream").trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([], state.schema).write.mode("overwrite").parquet(f"{work}/changed/batch=-1")
    last = spark.read.schema(state.schema.add("batch", "long")).parquet(f"{work}/changed").groupBy("key").agg(F.max_by(F.struct("keep", "n"), "batch").alias("s"))
    return last.select("key", F.col("s.keep.doc_id").alias("keep_id"), F.col("s.keep.file").alias("keep_file"), F.col("s.keep.row").alias("keep_row"), F.col("s.n").alias("n"))


def with_filter(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Those of ``rows`` whose ``key`` is in ``keys``, and maybe others: a bit filter of ``FILTER_BITS`` bits, made
    by Spark's bitmap aggregate and broadcast (at most ``FILTER_BITS / 8`` bytes)."""
    bit = F.pmod(F.xxhash64("key", F.lit(2)), F.lit(FILTER_BITS))
    place = F.col("bit") % _BITMAP
    part = F.floor(F.col("bit") / _BITMAP)
    maps = keys.select(bit.alias("bit")).groupBy(part.alias("part")).agg(F.bitmap_construct_agg(place).alias("map"))
    byte = F.conv(F.hex(F.substring("map", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked_rows = rows.withColumn("bit", bit).withColumn("part", part).join(F.broadcast(maps), "part")
    return marked_rows.where(F.getbit(byte, (place % 8).cast("int")) == 1).drop("bit", "part", "map")


def collisions(spark: SparkSession, table: Table, state: DataFrame, work: str) -> DataFrame:
    """The keys under which texts differ (one row for each row that does), after comparing the full
    bytes of all hits.

    Only rows of keys with several rows have their text compared, and only their texts leave the
    scan; the retained row's text meets them by key in an equi-join, whose large keys Spark splits.
    """
    stays = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    several = state.where("n > 1")
    rows = table.rows(spark.read.parquet(table.path), F.coalesce(F.col(table.text), F.lit("")).alias("text"))
    hits = with_filter(rows, several.select("key")).join(several, "key").select("key", "text", stays.alias("stays"))
    hits.write.option("compression", "zstd").parquet(f"{work}/hits")
    hits = spark.read.parquet(f"{work}/hits")
    kept = hits.where("stays").select("key", F.col("text").alias("kept_text"))
    differ = hits.where("not stays").join(kept, "key").where(F.col("text") != F.col("kept_text")).select("key")
    differ.write.parquet(f"{work}/collisions")
    return spark.read.parquet(f"{work}/collisions")


def decisions(spark: SparkSession, table: Table, **source: str) -> DataFrame:
    """One row per row of the table: (file, row, doc_id, text_sha256, keep_id, group_size, kept)."""
    work = work_folder(spark, "exact-dedup")
    state = retained(spark, table, work, **source)
    state.write.parquet(f"{work}/state")
    state = spark.read.parquet(f"{work}/state")
    wrong = collisions(spark, table, state, work)
    sha = digest(F.col(table.text)).alias("text_sha256")
    rows = table.rows(spark.read.parquet(table.path), sha)
    if wrong.isEmpty():
        found = rows.join(state, "key")
    else:
        text = F.coalesce(F.col(table.text), F.lit("")).alias("text")
        apart = table.rows(spark.read.parquet(table.path), sha, text).join(wrong, "key", "left_semi")
        by_text = apart.groupBy("key", "text").agg(F.max(F.struct("doc_id", *PLACE)).alias("keep"), F.count(F.lit(1)).alias("n"))
        by_text = by_text.select("key", "text", F.col("keep.doc_id").alias("keep_id"), F.col("keep.file").alias("keep_file"), F.col("keep.row").alias("keep_row"), "n")
        found = rows.join(wrong, "key", "left_anti").join(state, "key").unionByName(apart.join(by_text, ["key", "text"]).drop("text"))
    kept = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    return found.select(*PLACE, "doc_id", "text_sha256", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **source: str) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    ``docs`` may be any DataFrame: it is written once to the shared folder, and that table's files
    and rows are the content locators.
    """
    spark = docs.sparkSession
    hidden, at = marked(docs)
    path = work_folder(spark, "exact-dedup-content")
    hidden.write.option("compression", "zstd").parquet(path)
    d = decisions(spark, Table(path, at[doc_id], at[text]), **source)
    content = spark.read.schema(hidden.schema).parquet(path).withColumns({"file": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")})
    return unmarked(content.join(d.where("not kept").select(*PLACE), PLACE, "left_anti"), docs)
