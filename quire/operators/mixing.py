"""Mixing jobs: split, rank projects, keep top projects, union datasets by split.

A dataset is one DataFrame with a ``split`` column (train/test/valid) and a
``source`` column when several are mixed; it is written ``partitionBy("split")``
so that reading one split prunes the others.

Scale notes
-----------
* ``hash_split`` is a per-row expression (no shuffle); sizes are approximately
  80/10/10.  ``exact_split`` gives exact sizes with one range-partitioned sort and a
  per-partition offset table (one row per partition), never a global window.
* ``project_counts`` is a partially aggregated ``groupBy``; the top ``n`` rows meet the
  rows in a semi join whose strategy Spark chooses.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.session import cut_lineage

SPLITS = ("train", "test", "valid")


def hash_bucket(id_col, seed: str = "") -> Column:
    """A stable bucket in [0, 2^32) from the md5 of the (seeded) id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    key = F.concat(F.lit(seed), c.cast("string")) if seed else c.cast("string")
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def hash_split(df: DataFrame, id_col: str, seed: str = "", test_size: float = 0.1, valid_size: float = 0.1) -> DataFrame:
    """W3 (default): train / test / valid by a hash threshold per row.

    As in the original, only the held-out share (test + valid) matters; the test
    part is test/(test+valid) of the held-out rows.
    """
    held = test_size + valid_size
    u = hash_bucket(id_col, seed) % 10000
    held_cut = int(round(10000 * (1 - held)))
    test_cut = held_cut + int(round((10000 - held_cut) * test_size / held))
    split = F.when(u < held_cut, "train").when(u < test_cut, "test").otherwise("valid")
    return df.withColumn("split", split)


def _numbered(df: DataFrame, order_cols: list[str], partitions: int | None) -> tuple[DataFrame, DataFrame]:
    """The rows with partition ``_pid`` and place ``_local`` of one range-partitioned sort, and the
    partitions' offsets (``_pid``, ``_n``, ``_off``).  The sort is written once: rows and offsets
    come from the same files, whatever a second sort would have sampled."""
    # without a number, the session's shuffle partitions, which AQE merges to its advisory size
    tagged = df.repartitionByRange(*([partitions] if partitions else []), *order_cols).sortWithinPartitions(*order_cols).withColumn("_mid", F.monotonically_increasing_id())
    tagged = tagged.withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_local", F.col("_mid").bitwiseAND((1 << 33) - 1)).drop("_mid")
    written = cut_lineage(tagged, "dense_index")
    counts = written.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    return written, counts.withColumn("_off", F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n"))


def dense_index(df: DataFrame, order_cols: list[str], name: str = "idx", partitions: int | None = None) -> DataFrame:
    """A dense 0-based index in the order of ``order_cols`` (must be a total order).

    One range-partitioned sort, written once; the per-partition row counts (one row per
    partition) give each partition's offset.  No global window over the rows.
    """
    rows, offsets = _numbered(df, order_cols, partitions)
    return rows.join(offsets.drop("_n"), "_pid").withColumn(name, F.col("_off") + F.col("_local")).drop("_pid", "_local", "_off")


def exact_split(df: DataFrame, id_col: str, seed: str = "", test_size: float = 0.1, valid_size: float = 0.1,
                partitions: int | None = None) -> DataFrame:
    """W3 (exact sizes): shuffle by the seeded hash, then the first ceil(held * n) rows
    are held out, and the first ceil(test/(test+valid) * held) of those are test.
    ``n`` comes from the counts of the written sort."""
    rows, offsets = _numbered(df.withColumn("_h", hash_bucket(id_col, seed)), ["_h", id_col], partitions)
    n = offsets.agg(F.sum("_n")).first()[0] or 0
    held = test_size + valid_size
    n_held = math.ceil(round(held * n, 9))  # round away float noise before ceil
    n_test = math.ceil(round(test_size / held * n_held, 9))
    i = F.col("_off") + F.col("_local")
    split = F.when(i < n_test, "test").when(i < n_held, "valid").otherwise("train")
    return rows.join(offsets.drop("_n"), "_pid").withColumn("split", split).drop("_h", "_pid", "_local", "_off")


def project_counts(df: DataFrame, n: int | None, file_col: str = "theory_file", order_col: str = "row_id",
                   split: str | None = "train") -> DataFrame:
    """A1 + O1: the ``n`` most frequent projects (X8 of the file); ties go to the
    project met first.  Counts come from ``split`` when the data has splits."""
    src = df.where(F.col("split") == split) if split is not None and "split" in df.columns else df
    counts = src.groupBy(T.project_path(file_col).alias("project")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(order_col).alias("first_row"))
    ranked = counts.orderBy(F.desc("n_rows"), F.asc("first_row"))
    return ranked if n is None else ranked.limit(n)


def top_projects(df: DataFrame, n: int | None, file_col: str = "theory_file", order_col: str = "row_id") -> DataFrame:
    """Rows of the ``n`` most frequent projects, all splits kept; ``n=None`` keeps all."""
    if n is None:
        return df
    top = project_counts(df, n, file_col, order_col).select("project")
    return (df.withColumn("project", T.project_path(file_col))
            .join(top, "project", "left_semi").drop("project"))


def union_by_split(first: DataFrame, second: DataFrame) -> DataFrame:
    """O3: bag union of two datasets split by split; only splits of ``first`` are kept
    (the original walks the first dataset's splits); missing columns become NULL."""
    splits = first.select("split").distinct()
    return first.unionByName(second.join(splits, "split", "left_semi"), allowMissingColumns=True)


def dataset_sizes(df: DataFrame) -> DataFrame:
    """Rows per (source, split)."""
    return df.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n_rows"))
