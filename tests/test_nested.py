"""X14's type names against a recursive-descent parser, H1's hashes of nested values against the stated rule."""

import hashlib
import json
import random

from pyspark.sql import functions as F
from pyspark.sql import types as ST

from quire.functions import terms as TM
from quire.operators import batch as B


# --- types ---------------------------------------------------------------------

def parse(text):
    """Names of a type text, constructor first; None if it isn't a type.  (type ``a`` with postfix names, then *, +, =>.)"""
    import re

    lex = re.findall(r"'[\w.']+|=>|[A-Za-z_][\w.']*|[()\[\],*+]", re.sub(r"::\s*(?:\{[^}]*\}|[\w.]+)", "", text))
    at = [0]

    def peek():
        return lex[at[0]] if at[0] < len(lex) else None

    def take():
        at[0] += 1
        return lex[at[0] - 1]

    def many(close):
        out = [function()]
        while peek() == ",":
            take()
            out.append(function())
        assert take() == close
        return out

    def postfix():
        x = take()
        if x == "(":
            names = sum(many(")"), [])
        elif x[0] == "'":
            names = []
        else:
            names = [x]
        while peek() and (peek()[0].isalpha() or peek()[0] == "_"):
            names = [take(), *names]
        return names

    def infix(sub, mark, name):
        left = sub()
        if peek() == mark:
            take()
            return [name, *left, *infix(sub, mark, name)]
        return left

    def function():
        if peek() == "[":
            take()
            parts = many("]")
            assert take() == "=>"
            out = function()
            for p in reversed(parts):
                out = ["fun", *p, *out]
            return out
        left = infix(lambda: infix(postfix, "*", "prod"), "+", "sum")
        if peek() == "=>":
            take()
            return ["fun", *left, *function()]
        return left

    out = function()
    assert at[0] == len(lex)
    return out


def a_type(rnd, depth=0):
    k = rnd.random()
    if depth > 3 or k < 0.25:
        return rnd.choice(["nat", "'a", "int", "My.t'", "'b::{ord, plus}", "'c :: type", "bool"])
    one = lambda: a_type(rnd, depth + 1)
    bracket = lambda t: f"({t})"
    if k < 0.45:
        return f"{bracket(one())} {rnd.choice(['list', 'set', 'option'])}"
    if k < 0.55:
        return f"({one()}, {one()}) map list"
    if k < 0.65:
        return f"[{one()}, {one()}] => {one()}"
    return f"{bracket(one()) if rnd.random() < 0.6 else rnd.choice(['nat list', 'int'])}{rnd.choice([' => ', '*', ' + '])}{bracket(one()) if rnd.random() < 0.6 else rnd.choice(['nat => bool', 'int'])}"


def test_type_names_equal_a_parser(spark):
    rnd = random.Random(9)
    texts = [a_type(rnd) for _ in range(1500)] + ["nat list", "a => b => c", "a * b + c * d => e", "(a => b) list set", "((nat))", "'a"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(TM.type_names("t")).collect()]
    for t, g in zip(texts, got):
        assert g == parse(t), t
    assert got[1500:] == [["list", "nat"], ["fun", "a", "fun", "b", "c"], ["fun", "sum", "prod", "a", "b", "prod", "c", "d", "e"], ["set", "list", "fun", "a", "b"], ["nat"], []]


def test_type_names_of_other_texts(spark):
    texts = ["(nat", "nat)", "[a, b) => c", "(a, b] c", "a, b", "", "a \\<Rightarrow> b \\<times> c", "a ⇒ b × c"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(TM.type_names("t")).collect()]
    assert got == [[], [], [], [], [], [], ["fun", "a", "prod", "b", "c"], ["fun", "a", "prod", "b", "c"]]


# --- fingerprints ----------------------------------------------------------------

def rule(value, depth=0, ignore=()):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    if depth > 6:
        return md5("max_depth_reached")
    if value is None:
        return md5("unknown")
    if isinstance(value, list):
        return md5("".join(rule(v, depth + 1, ignore) for v in value))
    if isinstance(value, dict):
        return md5("".join(rule(k, depth + 1, ignore) + rule(v, depth + 1, ignore) for k, v in value.items() if k not in ignore))
    return md5(str(value))


def a_schema(rnd, depth):
    k = rnd.random()
    if depth == 0 or k < 0.2:
        return rnd.choice([ST.StringType(), ST.LongType(), ST.BooleanType()])
    if k < 0.45:
        return ST.ArrayType(a_schema(rnd, depth - 1))
    if k < 0.65:
        return ST.MapType(rnd.choice([ST.StringType(), ST.LongType()]), a_schema(rnd, depth - 1))
    return ST.StructType([ST.StructField(n, a_schema(rnd, depth - 1)) for n in rnd.sample(["a", "b", "skip", "d"], rnd.randint(1, 3))])


def a_value(rnd, t, top=False):
    if not top and rnd.random() < 0.12:
        return None
    if isinstance(t, ST.StringType):
        return rnd.choice(["", "x", "héllo"])
    if isinstance(t, ST.LongType):
        return rnd.randint(-5, 10 ** 12)
    if isinstance(t, ST.BooleanType):
        return rnd.random() < 0.5
    if isinstance(t, ST.ArrayType):
        return [a_value(rnd, t.elementType) for _ in range(rnd.randint(0, 3))]
    if isinstance(t, ST.MapType):
        keys = rnd.sample(["k", "skip", "m"], rnd.randint(0, 3)) if isinstance(t.keyType, ST.StringType) else rnd.sample(range(9), rnd.randint(0, 3))
        return {k: a_value(rnd, t.valueType) for k in keys}
    return {f.name: a_value(rnd, f.dataType) for f in t.fields}


def test_fingerprints_of_random_nested_schemas(spark):
    rnd = random.Random(21)
    for _ in range(12):
        schema = ST.StructType([ST.StructField(n, a_schema(rnd, rnd.randint(1, 9))) for n in ("u", "skip", "v")])
        rows = [a_value(rnd, schema, top=True) for _ in range(8)]
        df = spark.createDataFrame([tuple(r.values()) for r in rows], schema).coalesce(1)
        # as JSON, which has maps in the order that Spark holds them in (collected rows have not)
        rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
        for ignore in ((), ("skip",)):
            got = [r[0] for r in df.select(B.fingerprint("u", "skip", "v", df=df, ignore=ignore)).collect()]
            assert got == [rule(r, 0, ignore) for r in rows]
