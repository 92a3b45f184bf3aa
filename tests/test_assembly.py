"""J4-J6 with a file's lists stored once, and the template table with repeated names."""

import random

from pyspark.sql import functions as F

from quire.functions.terms import TOKEN
from quire.operators import assemble as A
from quire.operators import extract as X


def inputs(spark):
    rnd = random.Random(2)
    templates = [("Hot" if i % 3 else f"T{i % 5}", f"Hot.l{i}" if i % 7 else f"Hot.l{i}.simps", "x", [f"D.s{rnd.randrange(40)}" for _ in range(i % 4)], "t\nt") for i in range(120)]
    templates = [(a, b, c, list(dict.fromkeys(d)), e) for a, b, c, d, e in templates] + [("Hot", "Hot.l1", "again", ["D.s1"], "t"), ("No.defs", "No.l", "x", [], "t")]
    defs = [(f"D.s{i}", "Hot" if i % 2 else f"T{i % 5}", i * 3, f"s{i}", f"definition s{i}") for i in range(60)] + [("D.s9", "Only.defs", 4, "s9", "definition s9 again")]
    return (spark.createDataFrame(templates, "theory_file string, lemma_name string, lemma_object string, symbols array<string>, template string"),
            spark.createDataFrame([("Hot", "l1", "lemma l1")], "theory_file string, lemma_name string, stmt string"),
            spark.createDataFrame(defs, "def_key string, theory_file string, pos long, def_name string, def_stmt string"))


def test_references_rebuild_every_lemma_row(spark):
    t, th, d = inputs(spark)
    runs = t.select("theory_file").distinct()
    whole = A.assemble_lemmas(t, th, d, runs)
    lemmas, symbols, defs = A.lemma_references(t, th, d, runs, chunk=4)
    built = A.expand_references(lemmas, symbols, defs)
    assert built.columns == whole.columns
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(built.collect(), key=key) == sorted(whole.collect(), key=key)
    sizes = {(r["lemma_name"], r["lemma_object"]): (r["n_local_symbols"], r["n_local_defs"]) for r in lemmas.collect()}
    assert sizes == {(r["lemma_name"], r["lemma_object"]): (len(r["local_symbols"]), len(r["local_defs"])) for r in whole.collect()}


def test_a_hot_file_is_many_small_rows(spark):
    t, _, d = inputs(spark)
    chunks = A.definition_chunks(d, chunk=6)
    rows = chunks.where("theory_file = 'Hot'").orderBy("chunk").collect()
    assert len(rows) > 20 and max(len(r["local_defs"]) for r in rows) <= 6
    assert [r["first"] for r in rows] == [sum(len(x["local_defs"]) for x in rows[:i]) for i in range(len(rows))]
    names = A.symbol_chunks(t.withColumnRenamed("symbols", "used_symbols"), chunk=5).where("theory_file = 'Hot'")
    assert names.count() >= 6
    union = [s for r in names.collect() for s in r["file_symbols"]]
    assert len(union) == len(set(union))
    # the lists cross no shuffle with the lemmas: references cost n + m
    lemmas, _, _ = A.lemma_references(*inputs(spark))
    assert not {"local_symbols", "local_defs", "defs"} & set(lemmas.columns)


def test_two_statements_of_one_name_keep_their_types(spark):
    app, true = ("app", None, None), ("const", "HOL.Trueprop", "bool => prop")

    def fact(c):
        return [app, true, app, ("const", c, "nat => bool"), ("var", "x", "nat")]

    terms = spark.createDataFrame([("T", "T.a", fact("A.f")), ("T", "T.a", fact("A.g"))], f"theory_file string, name string, tokens array<{TOKEN}>")
    types = spark.createDataFrame([("A.f", "F"), ("A.g", "G")], "symbol string, type string")
    got = {tuple(r["symbols"]): r["types"] for r in X.template_table(terms, types).collect()}
    assert got == {("A.f",): ["F"], ("A.g",): ["G"]}
    assert X.template_table(terms, types).select(F.countDistinct("lemma_name")).first()[0] == 1
