"""Incremental scoring: score prediction files as they land, each file once.

The batch pipeline reruns only what is missing by anti-joining a results table
(J10, S7).  When predictions arrive as files over time, Structured Streaming does
the same bookkeeping natively: a file source remembers which files it has read
(in the checkpoint), each micro-batch is joined to the static examples table and
scored with the batch jobs, and ``foreachBatch`` writes the batch into its own
``batch_id=<n>`` folder with dynamic partition overwrite, so a retried batch
replaces its own output (exactly once) instead of appending twice.

There is no event time, watermark or state here: the original has none, and a
prediction's score depends on nothing but its own row and the example it names.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import scoring as S
from quire.session import checkpoint_dir
from quire.sources.io import PREDICTIONS_SCHEMA


def score_prediction_stream(spark: SparkSession, predictions_dir: str, examples: DataFrame, results_path: str,
                            train_config: str = "template", checkpoint: str | None = None,
                            available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start (and, with ``available_now``, finish) a query that scores every new JSON
    prediction file under ``predictions_dir`` against ``examples`` (E8 or E9 by
    ``train_config``) into ``results_path``.  Returns the StreamingQuery."""
    reader = spark.readStream.schema(PREDICTIONS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.json(predictions_dir)
    if S.evaluate(examples, spark.createDataFrame([], PREDICTIONS_SCHEMA), train_config) is None:
        raise ValueError(f"no evaluation for the training config {train_config!r}")
    ckpt = checkpoint or os.path.join(checkpoint_dir(spark), "stream-" + os.path.basename(results_path.rstrip("/")))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        scores = S.evaluate(examples, batch, train_config)
        (scores.withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(results_path))

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
