"""Session helpers: a local session for tests and a shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "quire") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set (a shared file system); it is read from the
    session.  Only a local-mode session without it (tests) gets a fresh folder
    under the system temp directory, remembered for the application.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or _LOCAL.get(sc.applicationId)
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="quire-ckpt-")
    sc.setCheckpointDir(path)
    return path


#: Folders of local sessions without a checkpoint folder, by application.
_LOCAL: dict[str, str] = {}


def cut_lineage(df: DataFrame, name: str = "tbl") -> DataFrame:
    """Cut lineage with a table written to the shared checkpoint folder.

    The plan is computed once and written as Parquet under ``spark.checkpoint.dir``,
    then read back: downstream stages (and task retries after an executor loss)
    read the files instead of recomputing the plan.  ``DataFrame.checkpoint()``
    would compute an uncached plan twice (once to count, once to write).  The table
    is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def large_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the input, as a sort-merge join.

    Spark sizes a table by its files, which for repeated names or nested arrays are a small part of its rows,
    and would collect and broadcast it through the driver; the side that isn't broadcast would keep
    the few tasks of its scan.
    """
    return left.join(right.hint("merge"), on, how)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this application when its JVM ends, or when the ``scratch`` around it does."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    if _SCRATCH:
        _SCRATCH[-1].append(path)


def delete_now(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Folders made inside each open ``scratch``.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables made inside when the work inside is done (its results written)."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            delete_now(spark, path)
