"""Unit cases for the column functions, one per branch (hand-computed)."""

from pyspark.sql import functions as F

from quire.functions import distance as D
from quire.functions import text as T


def one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(expr(F.col("v")).alias("r")).first()["r"]


def test_theorem_name(spark):
    assert one(spark, T.theorem_name, 'lemma foo: "x = x"') == "foo"
    assert one(spark, T.theorem_name, 'lemma "x = x"') is None
    assert one(spark, T.theorem_name, 'theorem foo [simp]: "x"') == "foo"
    # greedy bracket group: the name is the word before the last colon that fits
    assert one(spark, T.theorem_name, 'lemma (in c) foo: "f (x) y: z"') == "y"
    assert one(spark, T.theorem_name, "lemma shows x") is None


def test_definition_name(spark):
    assert one(spark, T.definition_name, "definition foo :: nat") == "foo"
    assert one(spark, T.definition_name, "fun f where") == "f"
    assert one(spark, T.definition_name, "datatype 'a list = Nil") == "list"
    assert one(spark, T.definition_name, 'definition "bar x = y"') == "bar"
    assert one(spark, T.definition_name, "definition") is None


def test_split_lemma(spark):
    r = one(spark, T.split_lemma, 'lemma foo[simp]: "a"')
    assert (r["name"], r["body"]) == ("foo[simp]", "a")
    r = one(spark, T.split_lemma, 'lemma "a" by simp')
    assert (r["name"], r["body"]) == (None, 'a" by sim')
    r = one(spark, T.split_lemma, "theorem x")
    assert (r["name"], r["body"]) == (None, None)


def test_parse_generated(spark):
    r = one(spark, T.parse_generated, 'lemma name: "aval (plus a1 a2) s = aval a1 s + aval a2 s"')
    assert (r["name"], r["body"]) == (None, None)
    r = one(spark, T.parse_generated, 'lemma name: "a = b"{EOS} junk')
    assert (r["name"], r["body"]) == ("name", "a = b")


def test_keys_and_paths(spark):
    df = spark.createDataFrame([("A/B/C", "f"), ("B", "f")], "t string, n string")
    assert [r[0] for r in df.select(T.qualified_def_key("t", "n")).collect()] == ["B.f", "B.f"]
    assert one(spark, T.short_theorem_name, "Thy.foo(1)") == "foo"
    assert one(spark, T.short_theorem_name, "foo") == "foo"
    assert one(spark, T.project_path, "a/b/c.thy") == "a/b"
    assert one(spark, T.project_path, "c.thy") == "c.thy"
    assert one(spark, T.path_dir, "c") == ""
    assert one(spark, T.import_name, "Library/Sub/Foo") == "HOL-Library-Sub.Foo"
    assert one(spark, T.import_name, "Foo") == "HOL.Foo"
    assert one(spark, T.safe_name, "/a/-b.thy/") == "a_b_thy"
    assert one(spark, T.one_line, "a\nb") == "a b"


def test_clean_and_normalize(spark):
    assert one(spark, T.clean_term, "  f (?x  ?y)= g ?x###end zz") == "f (?x ?y)= g ?x"
    assert one(spark, T.clean_term, "a \\\\ b") == "a \\ b"
    assert one(spark, T.clean_prediction, "f ?a\nsecond line") == "f ?a"
    assert one(spark, T.normalize_vars, "f ?b ?a ?b") == "f ?x1 ?x2 ?x1"
    # the token "?y," is a different variable from "?y" and is replaced whole
    assert one(spark, T.normalize_vars, "g (?y, ?y)") == "g ( ?x1 ?x2 )"


def test_distances(spark):
    df = spark.createDataFrame(
        [("kitten", "sitting"), ("", ""), ("", "ab"), ("duck", "luck"), ("aab", "ab")], "a string, b string"
    )
    rows = df.select(D.levenshtein("a", "b"), D.hamming("a", "b"), D.jaccard("a", "b")).collect()
    assert [r[0] for r in rows] == [3, 0, 2, 1, 1]
    assert [r[1] for r in rows] == [3, 0, 2, 1, 2]
    jac = [r[2] for r in rows]
    assert jac[1] == 1.0 and jac[2] == 0.0
    assert abs(jac[3] - 3 / 5) < 1e-12  # {u,c,k} shared, union {d,l,u,c,k}
    assert abs(jac[4] - 2 / 3) < 1e-12  # multiset: min(a)=1,b=1 / max(a)=2,b=1


def test_run_id(spark):
    df = spark.createDataFrame([("org/model", "org/data", "cfg", ""), ("m", "d", "c", "x")], "m string, d string, c string, l string")
    assert [r[0] for r in df.select(T.run_id("m", "d", "c", "l")).collect()] == ["data-cfg-model", "d-c-m-x"]


def test_python_whitespace_semantics(spark):
    # Python treats \x1c-\x1f and U+00A0 as whitespace in strip/split/\s
    assert one(spark, T.clean_term, "\x1c a  b \x1f") == "a b"
    assert one(spark, T.normalize_vars, "f\x1e?a") == "f ?x1"
