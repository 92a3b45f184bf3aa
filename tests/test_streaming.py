"""Incremental scoring: each prediction file is scored once, retries do not duplicate."""

import json
import os
import tempfile

from quire.streaming.incremental import score_prediction_stream


def _write(path, rows):
    with open(path, "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")


def test_incremental_scoring(spark):
    root = tempfile.mkdtemp(prefix="quire-stream-")
    inbox, out, ckpt = f"{root}/in", f"{root}/out", f"{root}/ckpt"
    os.makedirs(inbox)
    examples = spark.createDataFrame([(1, "f ?x"), (2, "g ?y"), (3, "h")], "row_id long, template string")
    _write(f"{inbox}/a.json", [{"row_id": 1, "strategy": "greedy", "candidates": ["f ?x###end"]},
                               {"row_id": 2, "strategy": "greedy", "candidates": ["g  ?z"]}])
    q = score_prediction_stream(spark, inbox, examples, out, checkpoint=ckpt)
    q.awaitTermination()
    first = spark.read.parquet(out)
    assert first.count() == 2
    assert {r["row_id"]: r["success"] for r in first.collect()} == {1: True, 2: False}

    _write(f"{inbox}/b.json", [{"row_id": 3, "strategy": "beam-search", "candidates": ["x", " h "]}])
    q = score_prediction_stream(spark, inbox, examples, out, checkpoint=ckpt)
    q.awaitTermination()
    allrows = spark.read.parquet(out)
    assert allrows.count() == 3  # the first file is not scored again
    assert allrows.where("row_id = 3").first()["distance"] == 0
