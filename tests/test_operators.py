"""Operator tests on small hand-made fixtures: combinatorics, splits, order
invariance, error paths, I/O round trips."""

import hashlib
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quire.functions import terms as TM
from quire.operators import assemble as A
from quire.operators import batch as B
from quire.operators import mixing as M
from quire.operators import statements as ST
from quire.operators import templates as TP
from quire.sources import io as IO
from quire.sources.payload import function_payload, template_responses

TOKEN = TM.TOKEN


def _tokens(spark, rows):
    """rows: list of (term_id, [(kind, name, type), ...])"""
    return spark.createDataFrame(rows, f"term_id long, tokens array<{TOKEN}>")


def _two_hole_template(spark):
    # f (g x) with both f and g plain non-structural constants of arity 1
    toks = [("app", None, None), ("const", "A.f", "nat => nat"), ("app", None, None),
            ("const", "A.g", "nat => nat"), ("var", "x", "nat")]
    return _tokens(spark, [(1, toks)])


def _five_symbols(spark):
    rows = [(f"L.s{i}", "nat => nat", 1, i) for i in range(5)]
    return spark.createDataFrame(rows, "symbol string, type string, arity int, sym_pos long")


def test_fill_cross_counts(spark):
    tpl = TP.make_templates(_two_hole_template(spark))
    c = TP.candidates(tpl, _five_symbols(spark))
    assert c.count() == 25  # J13: 5 symbols, 2 holes, symbols may repeat


def test_fill_permutation_counts(spark):
    tpl = TP.make_templates(_two_hole_template(spark), poly=True)
    c = TP.candidates(tpl, _five_symbols(spark), poly=True)
    assert c.count() == 20  # J14: 5!/(5-2)!


def test_fill_infeasible_hole_gives_nothing(spark):
    tpl = TP.make_templates(_two_hole_template(spark))
    sy = spark.createDataFrame([("L.c", "nat", 0, 0)], "symbol string, type string, arity int, sym_pos long")
    assert TP.candidates(tpl, sy).count() == 0
    # the multi test lets a function symbol into a non-function hole, not the reverse
    assert TP.candidates(tpl, sy, multi=True).count() == 0


def test_fill_text_and_rediscovery(spark):
    terms = _two_hole_template(spark)
    tpl = TP.make_templates(terms)
    own = spark.createDataFrame([(1, "A.f", "nat => nat", 1, 0), (1, "A.g", "nat => nat", 1, 1)],
                                "term_id long, symbol string, type string, arity int, sym_pos long")
    c = TP.candidates(tpl, own, per_term=True)
    rendered = sorted(r[0] for r in c.select(TM.render("candidate")).collect())
    assert rendered == ["$ A.f $ A.f x_1", "$ A.f $ A.g x_1", "$ A.g $ A.f x_1", "$ A.g $ A.g x_1"]
    status = TP.rediscovered(terms, c).first()["status"]
    assert status == "true"


def test_abstract_typed_vs_poly(spark):
    # f:a f:b -> ?H1 ?H2 typed, ?H1 ?H1 poly
    toks = [("app", None, None), ("const", "A.f", "a"), ("const", "A.f", "b")]
    df = _tokens(spark, [(1, toks)])
    r = df.select(TM.render(TM.abstract("tokens")).alias("t"), TM.render(TM.abstract("tokens", poly=True)).alias("p")).first()
    assert r["t"] == "$ ?H1 ?H2" and r["p"] == "$ ?H1 ?H1"


def test_canon_idempotent_and_keep(spark):
    toks = [("app", None, None), ("const", "HOL.Not", "bool => bool"), ("abs", "z", "nat"), ("var", "q", "nat")]
    df = _tokens(spark, [(1, toks)])
    once = df.select(TM.canon("tokens").alias("c"))
    twice = once.select(TM.canon("c").alias("c2"), "c").first()
    assert twice["c"] == twice["c2"]  # T6 is idempotent
    r = df.select(TM.render(TM.abstract("tokens")).alias("t")).first()["t"]
    assert r == "$ HOL.Not %y_0. x_1"  # structural constant kept, binder renamed


def test_hash_split_disjoint_complete(spark):
    df = spark.range(0, 2000).withColumnRenamed("id", "row_id")
    s = M.hash_split(df, "row_id")
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert sum(counts.values()) == 2000 and set(counts) <= {"train", "test", "valid"}
    e = M.exact_split(df, "row_id")
    ec = {r["split"]: r["count"] for r in e.groupBy("split").count().collect()}
    assert ec == {"train": 1600, "test": 200, "valid": 200}
    assert e.select("row_id").distinct().count() == 2000


def test_dense_index_is_dense(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"))
    idx = M.dense_index(df, ["k"], "i", partitions=5)
    rows = idx.select("k", "i").collect()
    assert sorted(r["i"] for r in rows) == list(range(1000))
    assert all(r["i"] == r["k"] for r in rows)


def test_scale_invariance(spark):
    """Order-dependent jobs give the same result on 1 and 16 partitions."""
    rows = [("T1", f"n{i % 7}", i, f"s{i}") for i in range(200)]
    base = spark.createDataFrame(rows, "theory_file string, lemma_name string, pos int, stmt string")
    a = sorted(ST.last_wins(base.coalesce(1), ["theory_file", "lemma_name"], "stmt", "pos").collect())
    b = sorted(ST.last_wins(base.repartition(16), ["theory_file", "lemma_name"], "stmt", "pos").collect())
    assert a == b
    d = spark.createDataFrame([(f"p{i % 5}/f{i}", i) for i in range(100)], "theory_file string, row_id long")
    x = M.project_counts(d.coalesce(1), 3).collect()
    y = M.project_counts(d.repartition(16), 3).collect()
    assert x == y


def test_definition_lookup(spark):
    defs = spark.createDataFrame([("A.f", "def f"), ("B.c", "def c")], "def_key string, def_stmt string")
    lem = spark.createDataFrame([("T", "l1", ["A.f", "A.f.simps", "B.c_class.g", "f", "A.f.x.y"])],
                                "theory_file string, lemma_name string, used_symbols array<string>")
    r = A.dependent_definitions(lem, defs, ["theory_file", "lemma_name"]).first()["used_defs"]
    assert r == ["def f", "def f", "def c"]


def test_last_block_and_theorems(spark):
    th = spark.createDataFrame([("T", 1, 'lemma a: "s0"\n'), ("T", 2, 'lemma a: "s1"\nlemma a: "s2"\ntext x')],
                               "theory_file string, block long, text string")
    st = ST.last_block(ST.split_statements(th))
    r = ST.theorems(st).collect()
    assert [(x["lemma_name"], x["stmt"]) for x in r] == [("a", 'lemma a: "s2"\n')]


def test_predictor_errors_are_rows(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma"), (2, "   "), (3, "delta")], "row_id long, prompt string")
    out = {r["row_id"]: (r["candidates"], r["status"]) for r in B.predict(df, lambda: B.stub_predictor(2)).collect()}
    assert out[1] == (["Template for alpha", "Template for beta"], "ok")
    assert out[2] == ([], "error")
    assert out[3] == (["Template for delta"], "ok")


def _recursive_hash(value):
    """Independent Python statement of the fingerprint rule (md5 of child md5s)."""
    if value is None:
        return hashlib.md5(b"unknown").hexdigest()
    if isinstance(value, (list, tuple)):
        return hashlib.md5("".join(_recursive_hash(v) for v in value).encode()).hexdigest()
    if isinstance(value, dict):
        return hashlib.md5("".join(_recursive_hash(k) + _recursive_hash(v) for k, v in value.items()).encode()).hexdigest()
    return hashlib.md5(str(value).encode()).hexdigest()


def test_fingerprint_matches_rule(spark):
    df = spark.createDataFrame([(7, "abc", True, ["x", None]), (8, None, False, [])], "a long, b string, c boolean, d array<string>")
    got = [r[0] for r in df.select(B.fingerprint("a", "b", "c", "d", df=df)).collect()]
    want = [_recursive_hash({"a": 7, "b": "abc", "c": True, "d": ["x", None]}),
            _recursive_hash({"a": 8, "b": None, "c": False, "d": []})]
    assert got == want


def test_payload_roundtrip(spark):
    df = spark.createDataFrame([(["List.rev", "List.map"],), ([],)], "f array<string>")
    r = df.select(template_responses(function_payload("f")).alias("r")).collect()
    assert r[0]["r"]["responses"] == ["Template for List.rev", "Template for List.map"]
    bad = spark.createDataFrame([('{"function_names": "x"}',)], "p string").select(template_responses("p").alias("r")).first()
    assert bad["r"]["responses"] is None and bad["r"]["error"]


def test_sources_roundtrip(spark):
    root = tempfile.mkdtemp(prefix="quire-io-")
    os.makedirs(f"{root}/thys/Sub")
    with open(f"{root}/thys/A.thy", "w") as f:
        f.write('theory A imports Main begin\nlemma foo: "x = x"\n  by simp\nend\n')
    with open(f"{root}/thys/Sub/B.thy", "w") as f:
        f.write("theory B begin\ndefinition g where \"g = 1\"\nend\n")
    with open(f"{root}/thys/notes.txt", "w") as f:
        f.write("ignored")
    corpus = IO.corpus_scan(spark, f"{root}/thys")
    assert sorted(r["theory_file"] for r in corpus.collect()) == ["A", "Sub/B"]
    st = ST.split_statements(corpus)
    kinds = [r["kind"] for r in st.where(F.col("theory_file") == "A").orderBy("pos").collect()]
    assert kinds == ["theory", "lemma", "by", "end"]

    ds = spark.createDataFrame([(1, "train", "a"), (2, "test", "b"), (3, "valid", "c")], "row_id long, split string, v string")
    IO.dataset_save(ds, f"{root}/data", "lemmas", "hol")
    assert IO.dataset_load(spark, f"{root}/data", "lemmas", "hol", "test").count() == 1
    assert IO.dataset_load(spark, f"{root}/data", "lemmas", "hol", "all").count() == 3
    dated, moving = IO.versioned_save(ds, f"{root}/data", "lemmas", "v", today="2026-01-02")
    assert dated.endswith("config=v-2026-01-02") and spark.read.parquet(moving).count() == 3

    preds = spark.createDataFrame([(1, "greedy", ["  a ?x###end j"]), (2, "beam", ["b", "c"])], IO.PREDICTIONS_SCHEMA)
    out = IO.predictions_json_save(preds, f"{root}/preds")
    back = {r["row_id"]: r["candidates"] for r in IO.predictions_json_load(spark, out).collect()}
    assert back == {1: ["a ?x"], 2: ["b", "c"]}
    with open(f"{root}/raw.json", "w") as f:
        f.write('[["p1", "p2"], ["q1"]]')
    raw = IO.predictions_list_file_load(spark, f"{root}/raw.json", "greedy").orderBy("row_id").collect()
    assert [(r["row_id"], r["candidates"]) for r in raw] == [(0, ["p1", "p2"]), (1, ["q1"])]

    empty = IO.table_or_empty(spark, f"{root}/absent", "row_id long, status string")
    assert empty.count() == 0 and empty.columns == ["row_id", "status"]


def test_search_cap_and_filters(spark):
    app = ("app", None, None)
    tp = ("const", "HOL.Trueprop", "bool => prop")
    good = [app, tp, app, ("const", "P.f", "nat => bool"), ("var", "x", "nat")]
    novar = [app, tp, app, ("const", "P.f", "nat => bool"), ("free", "c", "nat")]
    rows = [(i, f"Thy.f{i:03d}", good) for i in range(30)] + [(100, "Thy.ATP_x", good), (101, "Thy.g", novar), (102, "Other.h", good)]
    df = spark.createDataFrame(rows, f"term_id long, name string, tokens array<{TOKEN}>")
    r = TP.theorem_search(df, "Thy", cap=5).collect()
    # all 30 good ones share one statement: duplicates removed, first name kept
    assert [(x["name"]) for x in r] == ["Thy.f000"]


def test_row_and_batch_functions(spark):
    import pandas as pd

    df = spark.createDataFrame([(1, "a b"), (2, "c")], "row_id long, text string")
    up = B.map_rows(df, lambda s: s.str.upper(), "text", "upper").orderBy("row_id").collect()
    assert [r["upper"] for r in up] == ["A B", "C"]

    def add_len(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(n=pdf["text"].str.len())

    bl = B.map_batches(df, add_len, "row_id long, text string, n long").orderBy("row_id").collect()
    assert [r["n"] for r in bl] == [3, 1]

    def make_tok():
        vocab = {}
        return lambda t: [vocab.setdefault(w, len(vocab)) for w in t.split()]

    enc = df.select(B.tokenizer_udf(make_tok)("text").alias("ids")).collect()
    assert all(isinstance(x, int) for r in enc for x in r["ids"]) and len(enc[0]["ids"]) == 2


def test_leaves_and_used_constants(spark):
    app, tp = ("app", None, None), ("const", "HOL.Trueprop", "bool => prop")
    term = [app, tp, app, ("const", "HOL.All", "t"), ("abs", "x", "nat"), app, ("const", "A.f", "nat => bool"), ("bound", "0", "nat")]
    df = spark.createDataFrame([(term,)], f"t array<{TOKEN}>")
    assert df.select(TM.leaf_constants("t")).first()[0] == ["HOL.Trueprop", "HOL.All"]  # A.f is under the binder
    inners = spark.createDataFrame(
        [([("term", term, None), ("type", None, "'a list => nat"), ("none", None, "??")],)],
        f"x array<struct<kind:string,tokens:array<{TOKEN}>,type:string>>")
    assert inners.select(TM.used_constants_many("x")).first()[0] == ["HOL.Trueprop", "HOL.All", "list", "nat"]
    sym = spark.createDataFrame([([app, ("const", "A.g", "a"), ("const", "A.f", "a")],)], f"t array<{TOKEN}>")
    assert sym.select(TM.symbols_of("t")).first()[0] == ["A.f", "A.g"]  # reverse first occurrence


def test_rows_basics(spark):
    from quire.operators import rows as R

    df = spark.createDataFrame([(i, f"t{i}", None if i % 2 else "v") for i in range(10)], "row_id long, a string, b string")
    assert R.head(df, 3).count() == 3
    assert R.skip_prefix(df, 4, when_config="hol-full").count() == 6
    assert R.skip_prefix(df, 4, when_config="hol").count() == 10
    assert R.not_null(df, "b").count() == 5
    other = spark.createDataFrame([(1, "x")], "row_id long, c string")
    out = R.ordered_projection(R.add_aligned_column(df, other, "c"), ["c", "row_id"])
    assert out.columns[:2] == ["c", "row_id"] and out.where("c = 'x'").count() == 1
    assert R.drop_columns(R.map_columns(df, {"d": F.upper("a")}), "a").columns == ["row_id", "b", "d"]


def test_fill_without_broadcast_same_result(spark):
    """A filler list too large to broadcast gives the same fillings."""
    tpl = TP.make_templates(_two_hole_template(spark))
    a = TP.fill_holes(tpl, _five_symbols(spark)).select(TP.F.to_json("filling").alias("f")).collect()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = TP.fill_holes(tpl, _five_symbols(spark)).select(TP.F.to_json("filling").alias("f")).collect()
        assert sorted(r["f"] for r in a) == sorted(r["f"] for r in b) and len(a) == 25
        assert TP.fill_holes(tpl, _five_symbols(spark), distinct_symbols=True, multi=True).count() == 20
        assert TP.feasible_options(tpl, _five_symbols(spark)).count() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_poly_template_that_is_not_well_typed_skips_feasibility(spark):
    """One constant at two types is one hole; the type check fails, so every symbol is tried."""
    app = ("app", None, None)
    toks = [app, app, ("const", "HOL.eq", "nat => nat => bool"), app, ("const", "Part.f", "nat => nat"), ("var", "x", "nat"), app, ("const", "Part.f", "int => int"), ("const", "Part.c", "nat")]
    terms = spark.createDataFrame([(1, "n", toks)], f"term_id long, name string, tokens array<{TOKEN}>")
    tpl = TP.make_templates(terms, poly=True)
    assert [h["hole"] for h in tpl.first()["holes"]] == ["?H1", "?H2"]
    assert len(TP.make_templates(terms).first()["holes"]) == 3
    sy = spark.createDataFrame([("L.f", "nat => nat", 1, 0), ("L.c", "nat", 0, 1), ("L.d", "nat", 0, 2)], "symbol string, type string, arity int, sym_pos long")
    got = TP.candidates(tpl, sy, poly=True).select("filling").collect()
    assert sorted(tuple(sorted(r["filling"].items())) for r in got) == sorted(
        (("?H1", a), ("?H2", b)) for a in ("L.f", "L.c", "L.d") for b in ("L.f", "L.c", "L.d") if a != b)


def test_arity_counts_outer_arrows_only(spark):
    types = ["nat", "nat => nat", "((nat => nat) => nat) => nat", "(a => b) => (c => (d => e)) => f", "(nat => nat) list => nat => bool", "((a))"]
    got = spark.createDataFrame([(t,) for t in types], "t string").coalesce(1).select(TM.type_arity("t")).collect()
    assert [r[0] for r in got] == [0, 1, 1, 2, 2, 0]


def test_search_patterns(spark):
    app, tp, eq = ("app", None, None), ("const", "HOL.Trueprop", "t"), ("const", "HOL.eq", "t")
    x, u, f = ("var", "x", "nat"), ("const", "HOL.undefined", "nat"), ("const", "A.f", "nat => nat")
    imp = [app, app, ("const", "Pure.imp", "t"), app, tp, ("var", "p", "bool"), app, tp]
    cases = {
        "T.plain": [app, tp, app, app, eq, x, x],
        "T.is_undefined": [app, tp, app, app, eq, app, f, x, u],
        "T.f_undefined": [app, tp, app, app, eq, app, f, u, x],
        "T.under_premise": imp + [app, app, eq, x, app, f, x],
        "T.premise_undefined": imp + [app, app, eq, x, u],
        "T.no_equation": [app, tp, ("var", "q", "bool")],
        "T.rhs_contains_undefined": [app, tp, app, app, eq, x, app, f, u],
        "T.no_vars": [app, tp, app, app, eq, f, f],
    }
    terms = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(cases.items())], f"term_id long, name string, tokens array<{TOKEN}>")
    assert {r["name"] for r in TP.theorem_search(terms, "T.").collect()} == {"T.plain", "T.f_undefined", "T.under_premise", "T.no_equation", "T.rhs_contains_undefined"}
    assert {r["name"] for r in TP.theorem_search(terms, ".", equations=True).collect()} == {"T.plain", "T.f_undefined", "T.under_premise", "T.rhs_contains_undefined"}
    assert len(TP.theorem_search(terms, "T.", cap=2).collect()) == 2


def test_render_filled_equals_render_of_fill(spark):
    app = ("app", None, None)
    toks = [app, app, ("const", "A.f", "a"), ("const", "A.g", "b"), ("const", "A.g", "b")]
    rows_in = [(toks, {"?H1": "S.x", "?H2": "S.y"}), (toks, {"?H1": "S.z"})]
    df = spark.createDataFrame(rows_in, f"tokens array<{TOKEN}>, filling map<string,string>")
    j = df.select(TM.abstract("tokens").alias("template"), "filling")
    rows = j.select(TM.render(TM.fill("template", "filling")).alias("a"),
                    TM.render_filled(TM.render("template"), "filling", 10).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and rows[0]["a"] == "$ $ S.x S.y S.y"
    h10 = spark.createDataFrame([("$ ?H1 ?H10 ?H1", {"?H1": "a", "?H10": "b"})], "r string, f map<string,string>")
    assert h10.select(TM.render_filled("r", "f", 10)).first()[0] == "$ a b a"


def test_feasible_options_and_strategy_table(spark):
    from quire.operators import scoring as S

    tpl = TP.make_templates(_two_hole_template(spark))
    sy = spark.createDataFrame([("L.f", "nat => nat", 1, 0), ("L.c", "nat", 0, 1), ("HOL.eq", "a => a => bool", 2, 2)],
                               "symbol string, type string, arity int, sym_pos long")
    exact = TP.feasible_options(tpl, sy).select("hole_idx", "symbol").collect()
    assert sorted((r[0], r[1]) for r in exact) == [(1, "L.f"), (2, "L.f")]
    st = S.strategy_table(spark).collect()
    assert len(st) == 12 and st[0]["strategy"] == "greedy" and st[0]["k"] == 1 and st[2]["temperature"] == 0.1


def test_predictor_row_timeout(spark):
    import time as _t

    def make():
        def slow(prompts):
            if prompts[0] == "slow":
                _t.sleep(5)
            return [["ok " + p] for p in prompts]
        return slow

    df = spark.createDataFrame([(1, "fast"), (2, "slow"), (3, "also fast")], "row_id long, prompt string")
    out = {r["row_id"]: r["status"] for r in B.predict(df, make, row_timeout=1.0).collect()}
    assert out == {1: "ok", 2: "timeout", 3: "ok"}


def test_run_extraction(spark):
    th = spark.createDataFrame([("A", 'lemma a: "x"\n'), ("B", "text nothing")], "theory_file string, text string")

    def extract(df):
        st = ST.split_statements(df)
        names = ST.kind_filter(st, ["lemma"]).groupBy("theory_file").agg(F.collect_list("stmt").alias("data"))
        return df.select("theory_file").join(names, "theory_file", "left")

    results, cov = ST.run_extraction(th, extract)
    r = cov.first()
    assert (r["n_with_data"], r["n_all"], r["ratio"]) == (1, 2, 0.5)


def test_scale_invariance_definition_order(spark):
    """J2 keeps symbol order through the explode / join / regroup shuffles."""
    defs = spark.createDataFrame([(f"T.f{i}", f"def {i}") for i in range(40)], "def_key string, def_stmt string")
    lem = spark.createDataFrame(
        [("T", f"l{j}", [f"T.f{(j * 7 + k) % 40}" + (".simps" if k % 2 else "") for k in range(12)]) for j in range(30)],
        "theory_file string, lemma_name string, used_symbols array<string>")
    ids = ["theory_file", "lemma_name"]
    one = sorted(A.dependent_definitions(lem.coalesce(1), defs.coalesce(1), ids).collect())
    many = sorted(A.dependent_definitions(lem.repartition(16), defs.repartition(16), ids).collect())
    assert one == many
    assert one[0]["used_defs"] == [f"def {(0 * 7 + k) % 40}" for k in range(12)]


def test_filling_text_matches_sorted_entries(spark):
    df = spark.createDataFrame([({"?H1": "a", "?H10": "b", "?H2": "c"},), ({},)], "f map<string,string>")
    sorted_entries = F.array_join(F.transform(F.array_sort(F.map_entries("f")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    rows = df.select(TM.filling_text("f", 10).alias("a"), sorted_entries.alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and rows[0]["a"] == "?H1=a,?H10=b,?H2=c"


def test_split_statements_edges(spark):
    text = ("(* header *)\n"
            "lemmas foo = bar\n"
            "  lemma baz: \"x\"\n"
            "inductive_set S where \"a : S\"\n"
            "inductive P where \"P 0\"\n"
            "lemmaX is not a command\n")
    th = spark.createDataFrame([("T", text)], "theory_file string, text string")
    rows = ST.split_statements(th).orderBy("pos").collect()
    assert [(r["pos"], r["kind"]) for r in rows] == [(0, None), (1, "lemmas"), (2, "lemma"), (3, "inductive_set"), (4, "inductive")]
    assert rows[4]["stmt"].endswith("lemmaX is not a command\n")  # not a command: stays in the previous span
    assert "".join(r["stmt"] for r in rows) == text  # spans cover the whole text


def test_dense_index_and_exact_split_on_a_million_rows(spark):
    """More partitions than input splits, a payload, and every id once."""
    from quire.operators import mixing as M

    n = 1_000_000
    df = spark.range(0, n, 1, 16).select((F.col("id") * 7919 % n).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    r = M.dense_index(df, ["id"], "i", partitions=50).agg(F.countDistinct("i").alias("d"), F.min("i").alias("a"), F.max("i").alias("b"), F.count_if(F.col("i") != F.col("id")).alias("wrong")).first()
    assert tuple(r) == (n, 0, n - 1, 0)
    sizes = {r["split"]: r["count"] for r in M.exact_split(df, "id", partitions=50).groupBy("split").count().collect()}
    assert sizes == {"train": 800_000, "test": 100_000, "valid": 100_000}


def test_bigram_model_equals_plain_counts(spark):
    """The most frequent follower (ties: the first word), the most frequent words, and continuations that stop."""
    from collections import Counter

    texts = ["a b a b a c", "b c  b d", "x", "", None, "é a\tb\nc d d d", "c a c a"]
    counts = Counter((p, q) for t in texts for w in [(t or "").split()] for p, q in zip(w, w[1:]))
    total = Counter()
    for (p, _), n in counts.items():
        total[p] += n
    known = sorted(total, key=lambda w: (-total[w], w))
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for size in (2, 50):
        want = {p: min((-n, q) for (x, q), n in counts.items() if x == p)[1] for p in known[:size]}
        assert B.train_bigrams(df, vocabulary=size) == want
    say = B.bigram_predictor({"a": "b", "b": "c", "c": "a"}, length=4, window=3)
    assert say(["x a", "nothing"]) == [["b c a b"], []]
    for bad in (" ", "one two three four"):
        with pytest.raises(ValueError):
            say([bad])
