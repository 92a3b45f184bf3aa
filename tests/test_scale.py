"""What keeps jobs within memory and time when their tables grow: joins that don't go through the driver, terms that
are evaluated once, and passes that are linear in a term."""

import time
from itertools import groupby

import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as E
from quire.functions import terms as TM
from quire.functions import text as T
from quire.operators import assemble as A
from quire.operators import batch as B
from quire.operators import templates as TP
from quire.plans.driver import MAX_SHARES, nation_symbols, part_terms, table, table_shares

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_does_not_broadcast_predictions(spark):
    for name in ("a7_all_configs", "e9_lemma_eval", "e10_best_of_two", "a7_row_results"):
        plan = _plan(E.queries()[name](spark, SF))
        assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan, name


def test_used_constants_do_not_broadcast_terms(spark):
    plan = _plan(E.queries()["x14_used_constants"](spark, SF))
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_fillings_do_not_broadcast_templates(spark):
    templates = TP.materialize(TP.make_templates(part_terms(spark, SF)))
    plan = _plan(TP.fill_holes(templates, nation_symbols(spark, SF)))
    broadcast = [line for line in plan.splitlines() if "BroadcastExchange" in line]
    assert all("input[0, string" in line for line in broadcast), plan  # the filler lists, by their class
    assert plan.count("SortMergeJoin") >= 2


def test_conjectures_do_not_broadcast(spark):
    c = TP.candidates(TP.make_templates(part_terms(spark, SF)), nation_symbols(spark, SF))
    bad = c.limit(1).select(TM.canon("candidate", "free", typed=False).alias("canonical"))
    assert "SortMergeJoin" in _plan(TP.conjectures(c.select("term_id", "candidate"), bad)).split("Generate")[0]


def _token(kind, name, typ=None):
    return (kind, name, typ)


def test_forms_are_those_of_built_candidates(spark):
    """Without building them: names that could run together, a null name, a hole that comes twice, Frees and binders."""
    app, eq, x = _token("app", None), _token("const", "HOL.eq", "b"), _token("var", "x", "nat")
    f, g, c = _token("const", "A.f", "nat => nat"), _token("const", "A.g", "nat => nat"), _token("const", "A.c", "nat")
    terms = spark.createDataFrame([
        (1, [app, app, eq, app, f, x, app, g, x]), (2, [app, app, eq, app, f, x, app, f, _token("var", "z", "nat")]), (3, [app, app, eq, c, c]),
        (4, [app, app, eq, x, _token("free", "q", "nat")]), (5, [app, _token("const", None, "t"), _token("abs", "u", "nat"), app, f, _token("bound", "0", "nat")]),
        (6, [app, app, eq, app, f, c, app, g, c]), (7, None), (8, [app, app, eq, app, f, _token("var", "other", "nat"), app, g, x]),
    ], f"term_id long, tokens {TM.TERM}")
    names = ["A.f", "1:A.g", "1:", "", "3:A.g1:", "é", "-"]
    symbols = spark.createDataFrame([(n, None, i % 2, i) for i, n in enumerate(names)], "symbol string, type string, arity int, sym_pos long")
    for poly in (False, True):
        templates = TP.make_templates(terms, poly=poly)
        made = TP.candidates(templates, symbols, poly=poly, forms=True)
        canonical = TM.canon("candidate", "free", typed=False)
        rows = made.select("form", TM.form(canonical).alias("built"), F.to_json(canonical).alias("tokens")).collect()
        assert len(rows) > 50 and all(r["form"] == r["built"] for r in rows)
        assert len({r["form"] for r in rows}) == len({r["tokens"] for r in rows})


def test_conjectures_read_forms_and_no_tokens(spark):
    """Either side of the anti join may bring its forms; the query writes candidates without their tokens."""
    nations = nation_symbols(spark, SF)
    made = TP.candidates(TP.make_templates(part_terms(spark, SF)), nations, forms=True)
    canonical = TM.canon("candidate", "free", typed=False)
    bad = made.where(F.array_contains(F.map_values("filling"), nations.where("sym_pos = 1").first()["symbol"]))
    assert bad.count() > 0
    tokens = TP.conjectures(made.select("term_id", "candidate"), bad.select(canonical.alias("canonical"))).groupBy("term_id").count()
    forms = TP.conjectures(made.select("term_id", "form"), bad.select("form")).groupBy("term_id").count()
    assert sorted(map(tuple, tokens.collect())) == sorted(map(tuple, forms.collect()))
    assert "to_json" not in _plan(forms) and "to_json" not in _plan(E.queries()["t10_conjectures"](spark, SF))


def test_search_evaluates_a_term_once(spark):
    terms = part_terms(spark, SF)
    plan = TP.theorem_search(terms, "widget", equations=True)._jdf.queryExecution().optimizedPlan().toString()
    condition = next(line for line in plan.splitlines() if "Filter" in line)
    assert condition.count("HOL.All") <= 1


def test_variables_of_a_text_are_found_once(spark):
    plan = spark.range(1).select(T.normalize_vars(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("###end") == 1


def test_long_terms_take_linear_time(spark):
    n = 1500  # binders and applications in turn; the constant before them is outside
    token = lambda kind, name: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit("t").alias("type"))
    body = F.flatten(F.array_repeat(F.array(token("app", "a"), token("const", "C.c"), token("abs", "x")), n))
    ts = F.concat(F.array(token("app", "a"), token("const", "HOL.eq")), body, F.array(token("const", "C.d")))
    begun = time.monotonic()
    row = spark.range(1).select(ts.alias("ts")).select(
        TM.leaf_constants("ts").alias("leaves"), TM.has_equality("ts").alias("eq"), TM.outside_abs("ts").alias("out")).first()
    assert row["leaves"] == ["HOL.eq", "C.c"] and row["eq"] is True
    assert row["out"] == [True] * 5 + [False] * (3 * n - 2)
    assert time.monotonic() - begun < 60


def test_user_functions_get_few_rows_at_once(spark):
    df = spark.range(2000, numPartitions=1)
    sizes = B.map_batches(df, lambda b: pd.DataFrame({"n": [len(b)]}), "n long").collect()
    assert sum(r["n"] for r in sizes) == 2000 and max(r["n"] for r in sizes) <= B.ROWS_AT_ONCE


def test_user_functions_see_few_texts_of_a_batch(spark):
    df = spark.range(2000, numPartitions=1).select("id", F.when(F.col("id") != 700, F.col("id").cast("string")).alias("text"))
    rows = B.map_rows(df, lambda s: s.fillna("") + f"/{len(s)}", "text", "seen").collect()
    assert [r["seen"].split("/")[0] for r in sorted(rows)] == ["" if i == 700 else str(i) for i in range(2000)]
    assert sum(1 / int(r["seen"].split("/")[1]) for r in rows) > 7 and max(int(r["seen"].split("/")[1]) for r in rows) <= B.ROWS_AT_ONCE
    for f in (B.map_rows(df, lambda s: s, "text", "out"), B.map_batches(df, lambda b: b, "id long, text string")):
        assert "MapInArrow" in _plan(f)  # no frame is made of a whole batch


def test_user_functions_of_other_types(spark):
    df = spark.sql("SELECT 1L AS id, array('a', 'b') AS words, 'x' AS text")
    assert B.map_rows(df, lambda s: s.str.upper(), "text", "out").first()["out"] == "X"
    assert B.map_rows(df.select("id", "text"), lambda s: s.str.upper(), "text", "text").first()["text"] == "X"
    assert B.map_batches(df, lambda b: b.assign(n=[len(w) for w in b["words"]]), "id long, words array<string>, text string, n long").first()["n"] == 2


def test_symbol_chunks_take_more_tasks_for_more_symbols(spark):
    rows = [(f"T{i % 7}" if i % 50 else None, [f"s{i % 97}", f"r{i % 11}"]) for i in range(500)] + [("T0", []), ("T0", None)]
    lemmas = spark.createDataFrame(rows, "theory_file string, used_symbols array<string>")
    got = A.symbol_chunks(lemmas, chunk=5, per_task=50)
    plan = _plan(got)
    assert plan.count("hashpartitioning") == plan.count(", 20)") == 2 and "Join" not in plan, plan  # 1,000 symbols, 50 to a task
    want = {}
    for f, names in rows:
        if f is not None:
            want.setdefault(f, set()).update(names or [])
    for f, chunks in groupby(sorted(got.collect()), lambda r: r["theory_file"]):
        chunks = list(chunks)
        assert all(c["file_symbols"] == sorted(set(c["file_symbols"])) for c in chunks)
        assert sorted(s for c in chunks for s in c["file_symbols"]) == sorted(want.pop(f))
        assert len({c["chunk"] for c in chunks}) == len(chunks) and max(c["chunk"] for c in chunks) < 22
    assert not want


def test_used_constants_of_one_text(spark):
    tokens = f"array({', '.join(f'named_struct({chr(39)}kind{chr(39)}, {k!r}, {chr(39)}name{chr(39)}, {n!r}, {chr(39)}type{chr(39)}, {chr(39)}t{chr(39)})' for k, n in (('app', 'a'), ('const', 'C.b'), ('const', 'C.b')))})"
    df = spark.range(1).select(F.expr(tokens).alias("tokens"), F.lit("nat list").alias("type"))
    used = lambda kind: TM.used_constants(F.struct(F.lit(kind).alias("kind"), "tokens", "type")).alias(f"of_{kind}")
    assert tuple(df.select(used("term"), used("type"), used("none")).first()) == (["C.b", "C.b"], ["list", "nat"], [])


def test_abstraction_has_many_tasks_without_a_shuffle(spark, tmp_path):
    n = 1000  # one row group, with null and repeated keys
    rows = [(None if i % 7 == 0 else i % 40, None if i % 11 == 0 else f"red w{i % 3} bolt", "Brand#1", "SMALL", i % 50, 1.0) for i in range(n)]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    df = E.queries()["t1_abstract"](spark, str(tmp_path))
    assert "Exchange" not in _plan(df)
    tasks = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    shares = min(spark.sparkContext.defaultParallelism, MAX_SHARES)
    assert sum(tasks) == n and max(tasks) <= -(-n // shares)
    whole, dealt = table(spark, str(tmp_path), "part"), table_shares(spark, str(tmp_path), "part")
    assert dealt.schema == whole.schema
    assert whole.exceptAll(dealt).isEmpty() and dealt.exceptAll(whole).isEmpty()
