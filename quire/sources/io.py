"""Readers and writers: corpus scan, datasets by name/config/split, prediction files,
and the results cache.

Layout of a dataset: ``<root>/<name>/config=<config>/split=<split>/part-*.parquet``.
Reading one split of one config is partition pruning (only that folder is
listed and read).  Every path is a shared file system path handed in by the
caller; nothing is written to a machine-local folder.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from functools import reduce
from typing import TYPE_CHECKING
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import cut_lineage
from quire.sources.list_file import RANGE_BYTES, read_lists

if TYPE_CHECKING:
    import pyarrow as pa

PREDICTIONS_SCHEMA = "row_id long, strategy string, candidates array<string>"


# Files that a task of a scan reads, and what it hands on at once: names, or bytes of text.
FILES_PER_TASK = 1 << 12
_NAMES_AT_ONCE = 1 << 12
_BYTES_AT_ONCE = 1 << 22


def corpus_scan(spark: SparkSession, root: str, suffix: str = ".thy") -> DataFrame:
    """Every ``*<suffix>`` file under ``root`` (recursively) as one row:
    ``(theory_file, text)`` where ``theory_file`` is the path relative to ``root``
    without the suffix.  An empty file gives no row, names that begin with ``_`` or ``.`` are hidden.

    Tasks list the folders, level by level, into tables of names in the checkpoint folder, and others read the files
    whole, so neither names nor files go through the driver: Spark's own reader keeps every file of a scan there.
    It still reads what pyarrow can't open and roots or suffixes that are patterns.
    """
    uri = _listed_by_tasks(spark, root, suffix)
    if uri is None:
        return _corpus_read(spark, root, suffix)
    files, n = _corpus_files(spark, uri, suffix)
    tasks = min(max(1, n), max(spark.sparkContext.defaultParallelism, -(-n // FILES_PER_TASK)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        where, base = _open(uri)
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["theory_file", "text"])
        for batch in batches:
            rows, size = [], 0
            for path in batch.column(0).to_pylist():
                with where.open_input_stream(f"{base}/{path}") as source:
                    text = source.read()
                if text:
                    rows.append((_escaped(path.removesuffix(suffix)), text))
                    size += len(text)
                if size >= _BYTES_AT_ONCE:
                    yield out(rows)
                    rows, size = [], 0
            yield out(rows)

    texts = files.repartition(tasks, "path").mapInArrow(read, "theory_file string, text binary")
    return texts.select("theory_file", F.col("text").cast("string").alias("text"))


def _corpus_read(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """``corpus_scan`` by Spark's reader, which keeps the list of all files on the driver."""
    df = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}")
          .text(root, wholetext=True))
    path = F.col("_metadata.file_path")
    marker = _marker(root)
    pos = F.locate(marker, path)
    rel = F.when(pos > 0, F.substring(path, pos + len(marker), F.lit(1 << 30))).otherwise(path)
    name = F.when(rel.endswith(suffix), F.substring(rel, F.lit(1), F.length(rel) - len(suffix))).otherwise(rel)
    return df.select(name.alias("theory_file"), F.col("value").alias("text"))


def _marker(root: str) -> str:
    return "/" + root.split("://", 1)[-1].strip("/") + "/"


def _listed_by_tasks(spark: SparkSession, root: str, suffix: str) -> str | None:
    """The full address of a folder that tasks can list, or None: no plain folder, or in no file system of pyarrow's."""
    from pyarrow import ArrowException, fs

    if re.search(r"[*?\[\]{}\\]", root + suffix) or suffix != _escaped(suffix):
        return None
    system, make = _fs(spark, root)
    uri = str(system.makeQualified(make(root)).toUri().toString())
    if f"{uri}/".partition(_marker(root))[1:] != (_marker(root), ""):
        return None
    try:
        where, base = _open(uri)
        return uri if where.get_file_info(base).type == fs.FileType.Directory else None
    except (ArrowException, OSError, ImportError):
        return None


def _open(uri: str):
    """(pyarrow's file system of an address, its path there)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def _escaped(path: str) -> str:
    """A path as Hadoop writes it in an address: other letters than ASCII's stay."""
    return "".join(c if ord(c) > 127 and not c.isspace() and c.isprintable() else quote(c, safe="/;:@&=+$,-_.!~*'()") for c in path)


def _entries(where, folder: str) -> Iterator[tuple[str, bool]]:
    """(name, is it a folder) of a folder's entries.  A local folder's come one by one; other systems give them at once."""
    from pyarrow import fs

    if isinstance(where, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            yield from ((e.name, e.is_dir()) for e in found)
    else:
        yield from ((i.base_name, i.type == fs.FileType.Directory) for i in where.get_file_info(fs.FileSelector(folder)))


def _corpus_files(spark: SparkSession, uri: str, suffix: str) -> tuple[DataFrame, int]:
    """(path) of every ``*<suffix>`` file below a folder, relative to it, and their number."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        where, base = _open(uri)
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], ["path", "folder"])
        for batch in batches:
            for above in batch.column(0).to_pylist():
                rows = []
                for name, folder in _entries(where, f"{base}/{above}".rstrip("/")):
                    # as Spark's reader: hidden names are left out
                    if name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name and not (
                            folder and name.startswith(("_metadata", "_common_metadata")))):
                        continue
                    if folder or name.endswith(suffix):
                        rows.append((f"{above}/{name}" if above else name, folder))
                    if len(rows) >= _NAMES_AT_ONCE:
                        yield out(rows)
                        rows = []
                yield out(rows)

    level, levels, n = spark.createDataFrame([("",)], "path string"), [], 0
    while level is not None:
        found = cut_lineage(level.mapInArrow(listed, "path string, folder boolean"), "listing")
        count = found.agg(F.count_if("folder").alias("folders"), F.count_if(~F.col("folder")).alias("files")).first()
        levels.append(found.where(~F.col("folder")).select("path"))
        n += count["files"]
        below = found.where("folder").select("path")
        level = below.repartition(min(count["folders"], 1 << 12), "path") if count["folders"] else None
    return reduce(DataFrame.union, levels), n


def corpus_write(theories: DataFrame, root: str, suffix: str = ".thy") -> int:
    """The inverse of S1: one file a row (theory_file, text) under ``root``, written by the tasks; the number
    of files.  A text is written to its place in one step, so a task that is run again repeats it."""
    import pyarrow as pa
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", root if "://" in root else f"file://{root}"))
        made = set()  # a folder is made once a task, not once a file
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = f"{base}/{name}{suffix}"
                if (folder := path.rpartition("/")[0]) not in made:
                    where.create_dir(folder, recursive=True)
                    made.add(folder)
                with where.open_output_stream(path) as out:
                    out.write((text or "").encode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return theories.select("theory_file", "text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def dataset_path(root: str, name: str, config: str) -> str:
    return f"{root.rstrip('/')}/{name}/config={config}"


def dataset_load(spark: SparkSession, root: str, name: str, config: str, split: str | None = None) -> DataFrame:
    """Load a dataset, by the label of a versioned save or by its config; ``split`` None or ``"all"`` reads every split (the
    ``split`` column stays), otherwise only that split's folder is read."""
    data = _read_text(spark, _pointer(root, name, config))
    df = spark.read.parquet(f"{root.rstrip('/')}/{name}/{data}" if data else dataset_path(root, name, config))
    if split is None or split == "all":
        return df
    return df.where(F.col("split") == split)


def dataset_save(df: DataFrame, root: str, name: str, config: str, mode: str = "overwrite") -> str:
    """S3: write a dataset with a ``split`` column, one folder per split.  Overwriting replaces
    the splits that ``df`` has and leaves the others."""
    path = dataset_path(root, name, config)
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(path)
    return path


def versioned_save(df: DataFrame, root: str, name: str, config: str, today: str | None = None) -> tuple[str, str]:
    """Save under the dated label ``<config>-<YYYY-MM-DD>`` and the moving label ``<config>``.

    The data is written once, to a new folder; a label is a small file that names it, replaced in one
    step when the data is complete.  So a label never shows half a save, readers of the former
    data go on reading it, and there is no second copy.  (The step is one rename; it is atomic on
    file systems whose renames are.)  Returns the paths that the two labels show, which are one.
    """
    label = f"{config}-{today or _dt.date.today().strftime('%Y-%m-%d')}"
    data = f"data/{uuid.uuid4().hex}/config={label}"
    base = f"{root.rstrip('/')}/{name}"
    df.write.partitionBy("split").parquet(f"{base}/{data}")
    for shown in (label, config):
        _replace_text(df.sparkSession, _pointer(root, name, shown), data)
    return f"{base}/{data}", f"{base}/{data}"


def prune_versions(spark: SparkSession, root: str, name: str) -> list[str]:
    """Deletes the data folders that no label names any more (saves of one day replace each other's)."""
    base = f"{root.rstrip('/')}/{name}"
    fs, path = _fs(spark, base)
    if not fs.exists(path(f"{base}/data")):
        return []
    named = {_read_text(spark, str(f.getPath())) for f in fs.listStatus(path(f"{base}/versions"))}
    kept = {n.split("/")[1] for n in named if n}
    gone = [g for g in (str(f.getPath().getName()) for f in fs.listStatus(path(f"{base}/data"))) if g not in kept]
    for g in gone:
        fs.delete(path(f"{base}/data/{g}"), True)
    return gone


def _pointer(root: str, name: str, label: str) -> str:
    return f"{root.rstrip('/')}/{name}/versions/{label}"


def _fs(spark: SparkSession, where: str):
    """(Hadoop file system of a path, its path constructor)."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(where).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _replace_text(spark: SparkSession, where: str, text: str) -> None:
    fs, make = _fs(spark, where)
    new = make(f"{where}.{uuid.uuid4().hex}")
    out = fs.create(new, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    option = jvm.org.apache.hadoop.fs.Options.Rename
    over = gateway.new_array(option, 1)
    over[0] = option.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(make(where).toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(new, make(where), over)


def _read_text(spark: SparkSession, where: str) -> str | None:
    fs, make = _fs(spark, where)
    if not fs.exists(make(where)):
        return None
    source = fs.open(make(where))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def predictions_json_save(preds: DataFrame, path: str, debug: bool = False) -> str:
    """K candidates per row as JSON lines, one folder per strategy
    (``-debug`` suffix for debug runs)."""
    out = f"{path.rstrip('/')}{'-debug' if debug else ''}"
    preds.write.mode("overwrite").partitionBy("strategy").json(out)
    return out


def predictions_json_load(spark: SparkSession, path: str, clean: bool = True) -> DataFrame:
    """Read saved prediction lines with a fixed schema; clean every candidate."""
    from quire.functions.text import clean_term

    df = spark.read.schema(PREDICTIONS_SCHEMA).option("mode", "FAILFAST").json(path)
    return df.withColumn("candidates", F.transform("candidates", clean_term)) if clean else df


def predictions_list_file_load(spark: SparkSession, path: str, strategy: str, clean: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """S6 (raw form): a file holding one JSON list of candidate lists, aligned by
    position: the place in the list is the ``row_id``.  One large file is read by many tasks
    (see ``list_file``).  Candidates are cleaned (E2); a malformed file fails."""
    from quire.functions.text import clean_term

    out = read_lists(spark, path, range_bytes).select("row_id", F.lit(strategy).alias("strategy"), "candidates")
    return out.withColumn("candidates", F.transform("candidates", clean_term)) if clean else out


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S7 (load): the results table at ``path``, or an empty one with ``schema``."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)  # an absent table is an empty one


def append_results(df: DataFrame, path: str) -> None:
    """S7 (save): add computed rows to the results table."""
    df.write.mode("append").parquet(path)


class ResultsCache:
    """Computed rows kept by ``key`` in buckets, the last good result of each key.

    Files are bucketed and sorted by key, so looking up what is missing (``missing``) moves only the
    asked rows; the cache's side has no exchange.  ``add`` appends a run; ``compact`` writes one row a
    key, the latest good one or else the latest, to a new folder and then moves the pointer to it,
    so readers see one state or the other.  ``order`` is added: the number of the run.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "fingerprint", buckets: int = 32):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).withColumn("order", F.lit(0).cast("long")).schema

    def _folder(self) -> str:
        return f"{self.root}/{_read_text(self.spark, f'{self.root}/current') or 'first'}"

    def _write(self, df: DataFrame, folder: str, mode: str) -> None:
        names = [f.name for f in self.schema.fields]
        spread = df.select(*names).repartition(self.buckets, self.key)  # a file a bucket
        spread.write.mode(mode).option("path", folder).bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(self._table(folder))

    def _table(self, folder: str) -> str:
        return "results_" + hashlib.md5(folder.encode()).hexdigest()

    def read(self) -> DataFrame:
        """All rows (several a key between compactions), in buckets."""
        folder, name = self._folder(), self._table(self._folder())
        if not self.spark.catalog.tableExists(name):
            cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
            self.spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{folder}'")
        return self.spark.table(name)

    def add(self, run: DataFrame) -> None:
        """Appends the rows of one run."""
        last = self.read().agg(F.max("order")).first()[0]
        self._write(run.withColumn("order", F.lit((last or 0) + 1).cast("long")), self._folder(), "append")
        self.spark.catalog.refreshTable(self._table(self._folder()))

    def good(self, ok: Column) -> DataFrame:
        return self.read().where(ok)

    def missing(self, todo: DataFrame, ok: Column) -> DataFrame:
        """The rows of ``todo`` that have no good result yet."""
        return todo.join(self.good(ok).select(self.key), self.key, "left_anti")

    def compact(self, ok: Column) -> None:
        """Leaves one row a key: the last good one, or the last one if none is good."""
        rows = self.read()
        rest = [f.name for f in self.schema.fields if f.name != self.key]
        best = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce(ok, F.lit(False)), "order")).alias("r")).select(self.key, "r.*")
        new = f"compacted-{uuid.uuid4().hex}"
        old = self._folder()
        self._write(best, f"{self.root}/{new}", "overwrite")
        _replace_text(self.spark, f"{self.root}/current", new)
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(old)}")
        fs, make = _fs(self.spark, old)
        fs.delete(make(old), True)
