"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import checkpoint_dir, delete_at_end

#: The ASCII letters that the contracts lower-case (no other letter is changed).
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def marked(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns renamed by position, and the new name of each old one.

    Whatever further columns are called, they can't clash with those that an operator adds.
    """
    marks = [f"__c{i}" for i in range(len(df.columns))]
    at = {}
    for name, mark in zip(df.columns, marks):
        at.setdefault(name, mark)
    return df.toDF(*marks), at


def unmarked(df: DataFrame, like: DataFrame) -> DataFrame:
    """The inverse of ``marked``: the columns of ``like`` alone, under their own names."""
    return df.select(*[f"__c{i}" for i in range(len(like.columns))]).toDF(*like.columns)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table has."""
    hidden, at = marked(df)
    return hidden.select(*[F.col(at[n]).alias(n) for n in names])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def id_bucket(doc_id: Column, n: int) -> Column:
    """The remainder of crc32 of the id's decimal text; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % n


def file_system(uri: str):
    """(pyarrow file system, path in it) of a place that Spark names; pyarrow knows ``s3a`` and ``s3n`` as ``s3``."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a write are deleted when it is done, not when the driver's garbage collector
    comes to them: its result is at rest, and nothing reads them again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, deleted when the application ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back; for tables with whole texts."""
    path = work_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
