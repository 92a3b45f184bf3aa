"""The pipeline: each stage against brute force on its own input, and the registered queries."""

import corpus_pipeline
import __spark_entry__ as E
from quire.llm import quality
from quire.llm.common import table
from quire.llm.queries import queries
from tests.llm import brute

SF_01 = "/root/testdata/sf0.01"


def test_queries_are_registered():
    found = E.queries()
    assert set(queries()) | {"pipeline"} <= set(found)
    assert [sum(n.startswith(f"op{k}_") for n in found) for k in range(1, 14)] == [1] * 13


def test_stages_on_their_own_input(spark, tmp_path):
    docs = table(spark, SF_01, "documents")
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_01).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        steps.append(docs)
    first = {r["doc_id"]: r["text"] for r in table(spark, SF_01, "documents").collect()}
    columns = table(spark, SF_01, "documents").columns
    assert all(s.columns == columns for s in steps[:-1])
    texts = [{r["doc_id"]: r["text"] for r in s.collect()} for s in steps[:-1]]

    judged = {r["doc_id"]: r["predicted"] for r in quality.judge(table(spark, SF_01, "documents"), table(spark, SF_01, "labels")).collect()}
    assert texts[0] == {i: t for i, t in first.items() if judged[i] == 1}
    bad = {r["doc_id"] for r in table(spark, SF_01, "labels").collect() if r["quality"] == 0}
    assert len(bad & set(texts[0])) <= 0.1 * len(bad) and len(texts[0]) >= 0.8 * (len(first) - len(bad))

    last = {}
    for i, t in texts[0].items():
        last[t] = max(i, last.get(t, i))
    assert texts[1] == {i: t for t, i in last.items()}

    fps = [(i, brute.fingerprint(t)) for i, t in texts[1].items()]
    ids = brute.components(fps)
    assert texts[2] == {i: texts[1][i] for i, f in fps if ids[f] == i}

    items = [(r["item_id"], r["text"]) for r in table(spark, SF_01, "benchmark").collect()]
    hits = {i: brute.contamination(t, items) for i, t in texts[2].items()}
    assert texts[3] == {i: t for i, t in texts[2].items() if not (hits[i][1] > 0 and 20 * hits[i][1] >= hits[i][0])}

    enc = brute.tokenizer()
    rows = steps[-1].collect()
    assert {r["doc_id"] for r in rows} == set(texts[3])
    for r in rows:
        assert r["ids"] == enc.encode_ordinary(texts[3][r["doc_id"]])
        assert r["decoded_sha256"] == brute.sha(texts[3][r["doc_id"]])


def test_run_returns_the_last_stage(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and got.count() > 0


def test_run_on_odd_tables(spark, odd, odd_rows, tmp_path):
    """Nulls everywhere, repeated rows and clashing columns, with odd labels and items, and without any."""
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (5, None, None), (5, 0, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([("a", "one id"), (None, "two texts"), ("b", None), ("c", ""), ("c", "...")], "item_id string, text string")
    for name, some in (("some", True), ("none", False)):
        odd.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.where("true" if some else "false").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        items.where("true" if some else "false").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    texts = {r[1] or "" for r in odd_rows}
    got = corpus_pipeline.run(spark, f"{tmp_path}/none").collect()
    # nothing to learn from and nothing to hide: one document of each group of near copies stays
    ids = brute.components([(i, brute.fingerprint(t)) for i, t in enumerate(sorted(texts))])
    assert len(got) == len(set(ids.values()))
    assert len(corpus_pipeline.run(spark, f"{tmp_path}/some").collect()) <= len(got)


def test_run_on_empty_tables(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_run_leaves_only_its_last_table(spark, monkeypatch, tmp_path):
    """The stages' intermediate tables go as soon as their results are written."""
    from quire import session

    where = str(tmp_path / "work")
    monkeypatch.setattr(session, "checkpoint_dir", lambda spark: where)
    monkeypatch.setattr("quire.llm.common.checkpoint_dir", lambda spark: where)
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = sorted(p.name.rpartition("-")[0] for p in (tmp_path / "work").iterdir())
    assert left == ["pipeline-byte_bpe"] and got.count() > 0
