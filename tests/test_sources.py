"""Sources: splits are replaced one by one, strict prediction files, the results cache, files to lemmas."""

import json
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quire.operators import extract as X
from quire.operators import scoring as S
from quire.operators import statements as ST
from quire.operators import templates as TP
from quire.sources import io
from quire.streaming.incremental import score_prediction_stream


def test_saving_one_split_keeps_the_others(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test"), (3, "valid")], "row_id long, split string")
    io.dataset_save(df, str(tmp_path), "d", "c")
    io.dataset_save(spark.createDataFrame([(9, "test")], "row_id long, split string"), str(tmp_path), "d", "c")
    assert sorted(tuple(r) for r in io.dataset_load(spark, str(tmp_path), "d", "c").select("row_id", "split").collect()) == [(1, "train"), (3, "valid"), (9, "test")]


def test_prediction_files_are_strict_and_cleaned(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps([["f ( ?x###end junk", "g"], []]))
    rows = io.predictions_list_file_load(spark, str(tmp_path / "good.json"), "greedy").orderBy("row_id").collect()
    assert [(r["row_id"], r["candidates"]) for r in rows] == [(0, ["f ( ?x", "g"]), (1, [])]
    (tmp_path / "bad.json").write_text('[["f", ')
    with pytest.raises(Exception):
        io.predictions_list_file_load(spark, str(tmp_path / "bad.json"), "greedy").collect()
    (tmp_path / "lines.json").write_text('{"row_id": 1, "strategy": "greedy", "candidates": ["a"]}\n{"row_id": 2, "strat\n')
    with pytest.raises(Exception):
        io.predictions_json_load(spark, str(tmp_path / "lines.json")).collect()


def test_cache_is_empty_only_when_absent(spark, tmp_path):
    assert io.table_or_empty(spark, str(tmp_path / "none"), "a long").count() == 0
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        io.table_or_empty(spark, str(tmp_path / "broken"), "a long").count()


def test_files_to_lemmas(spark, tmp_path):
    """S1 -> X1 -> P5/X2/X3/X6 -> J6 -> S4 over a folder of theory files."""
    (tmp_path / "thy" / "A").mkdir(parents=True)
    (tmp_path / "thy" / "A" / "One.thy").write_text('theory One\nimports Main\nbegin\ndefinition f where "f x = x"\ndefinition f where "f x = x + 0"\nlift_definition g :: nat is 0\nlemma l1: "f x = x"\nlemma l1: "f y = y"\nend\n')
    (tmp_path / "thy" / "Two.thy").write_text('theory Two\nbegin\nfun h where "h x = x"\nlemma "h x = x"\nlemma l2: "h (h x) = x"\nend\n')
    theories = io.corpus_scan(spark, str(tmp_path / "thy"))
    assert sorted(r[0] for r in theories.select("theory_file").collect()) == ["A/One", "Two"]
    templates = spark.createDataFrame([
        ("A/One", "One.l1", "f ?y = ?y", ["One.f", "Two.h.simps"], "?H1 x_1\n= x_1"),
        ("A/One", "One.f.simps", "f ?x = ?x", ["One.f", "Other.c"], "?H1 x_1 = x_1"),
        ("Two", "Two.l2", "h (h ?x) = ?x", ["Two.h"], "t"), ("Two", "Two.l2", "another fact of the name", [], "t"),
    ], "theory_file string, lemma_name string, lemma_object string, symbols array<string>, template string")
    lemmas = X.lemmas_from_text(theories, templates)
    path, moving = io.versioned_save(lemmas.withColumn("split", TP.F.lit("train")), str(tmp_path / "data"), "lemmas", "small", today="2024-01-02")
    rows = {(r["lemma_name"], r["lemma_object"]): r for r in io.dataset_load(spark, str(tmp_path / "data"), "lemmas", "small-2024-01-02").collect()}
    assert len(rows) == 3  # the generated One.f.simps is dropped, two facts of one name stay apart
    one = rows["One.l1", "f ?y = ?y"]
    assert one["lemma_command"] == 'lemma l1: "f y = y"\n' and one["template"] == "?H1 x_1 = x_1"
    assert one["used_defs"] == ['definition f where "f x = x + 0"\n', 'fun h where "h x = x"\n']
    assert one["local_symbols"] == ["Other.c"]  # of a generated lemma, which counts for its file
    assert one["local_defs"] == ['definition f where "f x = x"\n', 'definition f where "f x = x + 0"\n']
    assert rows["Two.l2", "another fact of the name"]["used_defs"] == []
    only = X.lemmas_from_text(theories, templates, spark.createDataFrame([("A/One",), ("Two",), ("Two",)], "theory_file string"))
    assert [r["lemma_name"] for r in only.collect()] == ["One.l1"]


def test_single_result_guard_keeps_whole_rows(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", None)], "theory_file string, n long")
    assert sorted((r["theory_file"], r["n"]) for r in ST.single_result_guard(df).collect()) == [("a", 1), ("c", None)]


def test_success_rates_count_missing_predictions(spark):
    ex = spark.createDataFrame([(i, f"t{i}") for i in range(4)], "row_id long, template string")
    pr = spark.createDataFrame([(0, "greedy", ["t0"]), (1, "greedy", ["x"]), (9, "greedy", ["t9"])], "row_id long, strategy string, candidates array<string>")
    scores = S.evaluate(ex, pr, "template", strategies=["greedy", "beam-search"])
    assert sorted(tuple(r) for r in S.success_rate(scores).collect()) == [("beam-search", 0, 4, 0.0), ("greedy", 1, 4, 25.0)]
    assert tuple(S.any_strategy_report(scores).first()) == (1, 4, 25.0)
    assert sorted(tuple(r) for r in S.alignment_report(ex, pr, ["greedy", "beam-search"]).collect()) == [("beam-search", 4, 4, 0), ("greedy", 4, 2, 1)]
    assert S.evaluate(ex, pr, "other") is None
    assert S.evaluate(ex, pr, "template", "hol-full", ["greedy"], skip=2).count() == 2


def test_stream_refuses_a_config_without_evaluation(spark, tmp_path):
    ex = spark.createDataFrame([(1, "t")], "row_id long, template string")
    with pytest.raises(ValueError):
        score_prediction_stream(spark, str(tmp_path), ex, str(tmp_path / "out"), train_config="other", checkpoint=str(tmp_path / "c"))


@pytest.mark.parametrize("range_bytes", [1, 2, 5, 17, 1000])
def test_list_files_by_ranges_equal_the_whole_file(spark, tmp_path, range_bytes):
    """Strings with brackets, commas, quotes and backslash runs; nulls, empty lists, white space."""
    rnd = random.Random(range_bytes)
    atoms = ["a", "[", "]", ",", '"', "\\", "\\\\", '\\"', "é", "漢", "\n", "],[", " "]
    lists = [None if rnd.random() < 0.1 else [None if rnd.random() < 0.1 else "".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(0, 3))] for _ in range(25)]
    path = tmp_path / "lists.json"
    path.write_text(json.dumps(lists, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 1])))
    got = io.predictions_list_file_load(spark, str(path), "greedy", clean=False, range_bytes=range_bytes)
    assert [(r["row_id"], r["candidates"]) for r in got.orderBy("row_id").collect()] == list(enumerate(lists))


def test_list_files_of_odd_shapes(spark, tmp_path):
    for i, (text, want) in enumerate([("[]", []), (" [ ] \n", []), ("[[]]", [[]]), ('[ ["x"] ]', [["x"]]), ("[null]", [None])]):
        (tmp_path / f"{i}.json").write_text(text)
        got = io.predictions_list_file_load(spark, str(tmp_path / f"{i}.json"), "greedy", clean=False, range_bytes=3)
        assert [r["candidates"] for r in got.orderBy("row_id").collect()] == want, text
    for i, text in enumerate(['[["a"]', '["a"', "[[1]]", '[["a"]]]', '[["a",]]']):
        (tmp_path / f"bad{i}.json").write_text(text)
        with pytest.raises(Exception):
            io.predictions_list_file_load(spark, str(tmp_path / f"bad{i}.json"), "greedy", range_bytes=2).collect()


def test_one_large_list_file_is_many_tasks(spark, tmp_path):
    lists = [[f"candidate {i} of {j}" for j in range(4)] for i in range(5000)]
    (tmp_path / "big.json").write_text(json.dumps(lists))
    got = io.predictions_list_file_load(spark, str(tmp_path / "big.json"), "greedy", range_bytes=20_000)
    parts = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 10 and got.select("row_id").distinct().count() == 5000
    assert got.agg(F.min("row_id"), F.max("row_id")).first() == (0, 4999)


def test_labels_show_whole_saves_only(spark, tmp_path):
    def rows(n):
        return spark.range(n).select(F.col("id").alias("row_id"), F.lit("train").alias("split"))

    root = str(tmp_path)
    io.versioned_save(rows(3), root, "d", "c", today="2024-01-01")
    before = io.dataset_load(spark, root, "d", "c")
    broken = rows(2).withColumn("row_id", F.raise_error(F.lit("boom")))
    with pytest.raises(Exception):
        io.versioned_save(broken, root, "d", "c", today="2024-01-02")
    assert io.dataset_load(spark, root, "d", "c").count() == 3  # the failed save isn't seen
    io.versioned_save(rows(7), root, "d", "c", today="2024-01-02")
    assert io.dataset_load(spark, root, "d", "c").count() == 7 and before.count() == 3
    assert io.dataset_load(spark, root, "d", "c-2024-01-01", "train").count() == 3
    files = [f for f in (tmp_path / "d" / "data").rglob("*.parquet")]
    assert len({f.parts[-4] for f in files if "2024-01-02" in str(f)}) <= 2  # the failed one's folder and one copy
    io.versioned_save(rows(9), root, "d", "c", today="2024-01-02")
    gone = io.prune_versions(spark, root, "d")
    assert len(gone) >= 1 and io.dataset_load(spark, root, "d", "c").count() == 9 and io.dataset_load(spark, root, "d", "c-2024-01-01").count() == 3


def test_results_cache_keeps_the_last_good_result(spark, tmp_path):
    cache = io.ResultsCache(spark, str(tmp_path / "cache"), "fingerprint string, answer string, status string", buckets=4)
    ok = F.col("status") == "ok"
    todo = spark.createDataFrame([(f"k{i}",) for i in range(40)], "fingerprint string")
    assert cache.missing(todo, ok).count() == 40
    cache.add(todo.select("fingerprint", F.lit("one").alias("answer"), F.when(F.col("fingerprint").endswith("7"), "error").otherwise("ok").alias("status")))
    missing = cache.missing(todo, ok)
    assert sorted(r[0] for r in missing.collect()) == ["k17", "k27", "k37", "k7"]
    # the cache's side of the anti join has no exchange: one shuffle, of the asked rows
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = cache.missing(todo, ok)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    cache.add(missing.select("fingerprint", F.lit("two").alias("answer"), F.lit("ok").alias("status")))
    cache.add(todo.where("fingerprint = 'k3'").select("fingerprint", F.lit("three").alias("answer"), F.lit("error").alias("status")))
    assert cache.read().count() == 45
    cache.compact(ok)
    rows = {r["fingerprint"]: (r["answer"], r["status"]) for r in cache.read().collect()}
    assert cache.read().count() == len(rows) == 40
    assert rows["k7"] == ("two", "ok") and rows["k3"] == ("one", "ok") and rows["k1"] == ("one", "ok")
    again = io.ResultsCache(spark, str(tmp_path / "cache"), "fingerprint string, answer string, status string", buckets=4)
    assert again.missing(todo, ok).count() == 0


def test_measured_run_counts_while_it_writes(spark, tmp_path):
    from quire.operators import batch as B

    df = spark.createDataFrame([(i, "two words" if i % 5 else "") for i in range(50)], "row_id long, prompt string")
    preds = B.predict(df, B.stub_predictor, timed=True)
    m = B.measured(preds, lambda d: d.write.parquet(str(tmp_path / "p"))).first()
    assert (m["n_rows"], m["n_tokens"]) == (50, 40 * 2 * 3) and m["n_chars"] == 40 * len("Template for two" + "Template for words")
    assert m["wall_sec"] > 0 and m["task_sec"] > 0 and abs(m["chars_per_sec"] * m["wall_sec"] - m["n_chars"]) < 1e-6
    assert spark.read.parquet(str(tmp_path / "p")).count() == 50
    plain = B.measured(preds.drop("seconds"), lambda d: d.write.parquet(str(tmp_path / "q"))).first()
    assert plain["n_rows"] == 50 and plain["task_sec"] is None


def test_evaluation_over_configs_skips_what_fails(spark):
    ex = spark.createDataFrame([(i, f"t{i}", f"?x{i} = c") for i in range(4)], "row_id long, template string, lemma_object string")
    rows = [("template_a", 0, "greedy", ["t0"]), ("template_a", 1, "beam-search", ["x", "t1"]), ("lemma_object_b", 0, "greedy", ["?y0 = c"]), ("lemma_object_b", 2, "greedy", ["?z = c"]), ("nonsense", 3, "greedy", ["t3"])]
    pr = spark.createDataFrame(rows, "config string, row_id long, strategy string, candidates array<string>")
    scores = S.evaluate_configs(ex, pr, ["template_a", "lemma_object_b", "nonsense", "template_without_predictions"])
    assert scores.count() == 4 * 2 + 4
    got = {r["config"]: tuple(r)[1:] for r in S.config_report(scores).collect()}
    assert got == {"template_a": (2, 4, 50.0, 2), "lemma_object_b": (2, 4, 50.0, 2), None: (3, 4, 75.0, 4)}
    assert S.evaluate_configs(ex, pr, ["nonsense"]).count() == 0


def test_corpus_written_and_scanned(spark, tmp_path):
    df = spark.createDataFrame([("a/T1", "x\ny"), ("a/b/T2", " "), ("T3", "é\n")], "theory_file string, text string")
    assert io.corpus_write(df, str(tmp_path / "thys")) == 3
    assert sorted(map(tuple, io.corpus_scan(spark, str(tmp_path / "thys")).collect())) == sorted(map(tuple, df.collect()))


def test_scan_keeps_no_list_of_files_on_the_driver(spark, tmp_path, monkeypatch):
    """Tasks list and read: deep, empty, hidden and foreign files, odd names and bytes, as Spark's reader gives them."""
    monkeypatch.setattr(io, "FILES_PER_TASK", 10)
    monkeypatch.setattr(io, "_NAMES_AT_ONCE", 7)
    monkeypatch.setattr(io, "_BYTES_AT_ONCE", 50)
    root = tmp_path / "thys"
    for i in range(120):
        at = root / f"s{i % 7}" / ("" if i % 3 else f"deep/d{i % 5}") / f"T{i}.thy"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(f"theory T{i}\n" * (i % 4))  # every fourth is empty
    for name, text in (("a b%.thy", b"x"), ("é+ü#.thy", "é".encode()), ("_hidden.thy", b"x"), (".dot.thy", b"x"), ("_a=1.thy", b"p"), ("s1/other.txt", b"x"), ("bytes.thy", b"\xff\xfe\x00 y"), (".thy", b"x"), ("s2/x.thy.thy", b"\xef\xbb\xbfz")):
        (root / name).write_bytes(text)
    for folder in ("_no", ".no", "_k=1", "dir.thy"):
        (root / folder).mkdir()
        (root / folder / "In.thy").write_text("in")
    (root / "nothing").mkdir()
    rows = lambda df: sorted(map(tuple, df.select("theory_file", df["text"].cast("binary")).collect()))
    for where in (str(root), f"file://{root}/"):
        got = io.corpus_scan(spark, where)
        assert rows(got) == rows(io._corpus_read(spark, where, ".thy")) and len(rows(got)) == 90 + 7
        assert not [f for f in got.inputFiles() if f.endswith(".thy")] and "FileScan text" not in got._jdf.queryExecution().toString()
        assert got.rdd.getNumPartitions() >= 12
    assert rows(io.corpus_scan(spark, str(root), ".txt")) == [("s1/other", b"x")]
    assert rows(io.corpus_scan(spark, str(root / "s*"))) == rows(io._corpus_read(spark, str(root / "s*"), ".thy"))
    assert io.corpus_scan(spark, str(root / "nothing")).count() == 0
    with pytest.raises(AnalysisException):
        io.corpus_scan(spark, str(tmp_path / "absent"))
