"""Property tests: many generated cases checked in one Spark job each."""

import math
import random

from pyspark.sql import functions as F

from quire.functions import distance as D
from quire.functions import terms as TM
from quire.functions import text as T
from quire.operators import templates as TP

ALPHABET = ["a", "b", "?x", "?y", "(", ")", " ", "  ", "f", "=", "\\\\", "###end"]


def _texts(n, seed=7):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def test_normalize_vars_idempotent(spark):
    # cleaning halves double backslashes every time it runs, so texts with
    # backslashes are not fixed points of the rule itself
    df = spark.createDataFrame([(t,) for t in _texts(300) if "\\" not in t], "t string")
    once = df.select(T.normalize_vars("t").alias("n"))
    bad = once.where(T.normalize_vars("n") != F.col("n")).count()
    assert bad == 0


def test_clean_term_idempotent_without_marks(spark):
    texts = [t for t in _texts(300, seed=3) if "###end" not in t and "\\" not in t]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    once = df.select(T.clean_term("t").alias("c"))
    assert once.where(T.clean_term("c") != F.col("c")).count() == 0


def test_distance_laws(spark):
    ts = _texts(120, seed=11)
    rows = [(a, b) for a, b in zip(ts, reversed(ts))] + [(t, t) for t in ts[:40]]
    df = spark.createDataFrame(rows, "a string, b string")
    r = df.select(
        ((D.levenshtein("a", "b") == 0) == (F.col("a") == F.col("b"))).alias("lev_zero_iff_equal"),
        (D.levenshtein("a", "b") == D.levenshtein("b", "a")).alias("lev_sym"),
        (D.hamming("a", "b") == D.hamming("b", "a")).alias("ham_sym"),
        (D.hamming("a", "b") >= D.levenshtein("a", "b")).alias("ham_ge_lev"),
        (D.jaccard("a", "b") == D.jaccard("b", "a")).alias("jac_sym"),
        ((D.jaccard("a", "b") >= 0) & (D.jaccard("a", "b") <= 1)).alias("jac_range"),
    )
    for c in r.columns:
        assert r.where(~F.col(c)).count() == 0, c


def _random_terms(n, seed=5):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        leaves = rnd.randint(1, 5)
        toks = [("app", None, None)] * (leaves - 1)
        for _ in range(leaves):
            k = rnd.choice(["const", "var", "free"])
            toks.append((k, rnd.choice(["A.f", "A.g", "x", "y"]), rnd.choice(["nat", "nat => nat"])))
        out.append((i, toks))
    return out


def test_canon_idempotent(spark):
    df = spark.createDataFrame(_random_terms(200), f"term_id long, tokens array<{TM.TOKEN}>")
    c = df.select(TM.canon("tokens").alias("c"))
    assert c.where(TM.canon("c") != F.col("c")).count() == 0


def test_fill_counts_are_products(spark):
    """J13 count = product of feasible counts per hole; J14 = n!/(n-h)! with equal arities."""
    for holes in (1, 2, 3):
        toks = [("app", None, None)] * holes + [("const", f"A.c{i}", "nat => nat") for i in range(holes)] + [("var", "x", "nat")]
        # a left-nested application chain: holes applications, holes+1 leaves
        tpl = TP.make_templates(spark.createDataFrame([(1, toks)], f"term_id long, tokens array<{TM.TOKEN}>"))
        for n in (2, 4):
            sy = spark.createDataFrame([(f"L.s{i}", "nat => nat", 1, i) for i in range(n)],
                                       "symbol string, type string, arity int, sym_pos long")
            assert TP.candidates(tpl, sy).count() == n ** holes
            want = math.perm(n, holes) if n >= holes else 0
            assert TP.candidates(tpl, sy, poly=True).count() == want


def _longest_first_loop(la, lb, max_len):
    """Remove one token at a time from the longer sequence (the second on ties)."""
    while la + lb > max_len:
        if la > lb:
            la -= 1
        else:
            lb -= 1
    return la, lb


def test_longest_first_closed_form(spark):
    from quire.functions import prompts as P

    cases = [(la, lb, m) for la in range(0, 13) for lb in range(0, 13) for m in (0, 1, 5, 8, 13, 30)]
    df = spark.createDataFrame(cases, "la int, lb int, m int")
    got = {}
    for m in (0, 1, 5, 8, 13, 30):
        fa, fb = P.longest_first_sizes(F.col("la"), F.col("lb"), m)
        for r in df.where(F.col("m") == m).select("la", "lb", fa.alias("fa"), fb.alias("fb")).collect():
            got[(r["la"], r["lb"], m)] = (r["fa"], r["fb"])
    bad = [(c, got[c], _longest_first_loop(*c)) for c in cases if got[c] != _longest_first_loop(*c)]
    assert not bad, bad[:5]


def _lookup_rule(symbol, defs):
    """J1 as stated: one dot -> exact key; two dots -> without the last segment,
    else (ending in _class) without those 6 characters; other dot counts -> none."""
    n = symbol.count(".")
    if n == 1:
        return defs.get(symbol)
    if n == 2:
        head = symbol.rsplit(".", 1)[0]
        if head in defs:
            return defs[head]
        if head.endswith("_class") and head[:-6] in defs:
            return defs[head[:-6]]
    return None


def test_definition_lookup_rule(spark):
    from quire.operators import assemble as A

    rnd = random.Random(13)
    defs = {f"T{i}.f{j}": ("" if (i + j) % 9 == 0 else f"def {i}.{j}") for i in range(4) for j in range(6)}
    forms = [lambda i, j: f"T{i}.f{j}", lambda i, j: f"T{i}.f{j}.simps", lambda i, j: f"T{i}.f{j}_class.x",
             lambda i, j: f"f{j}", lambda i, j: f"T{i}.f{j}.a.b", lambda i, j: f"T{i}.g{j}"]
    lemmas = []
    for n in range(60):
        syms = [rnd.choice(forms)(rnd.randrange(5), rnd.randrange(7)) for _ in range(rnd.randint(0, 8))]
        lemmas.append(("T", f"l{n}", syms))
    ldf = spark.createDataFrame(lemmas, "theory_file string, lemma_name string, used_symbols array<string>")
    ddf = spark.createDataFrame(list(defs.items()), "def_key string, def_stmt string")
    got = {r["lemma_name"]: r["used_defs"] for r in A.dependent_definitions(ldf, ddf, ["theory_file", "lemma_name"]).collect()}
    for _, name, syms in lemmas:
        want = [d for d in (_lookup_rule(s, defs) for s in syms) if d]
        assert got[name] == want, (name, syms, got[name], want)


def test_distances_equal_stated_rules(spark):
    from collections import Counter
    from itertools import zip_longest

    def ham(a, b):
        return sum(x != y for x, y in zip_longest(a, b))

    def jac(a, b):
        if a == b:
            return 1.0
        if not a or not b:
            return 0.0
        ca, cb = Counter(a), Counter(b)
        return sum((ca & cb).values()) / sum((ca | cb).values())

    rnd = random.Random(21)
    pairs = [("".join(rnd.choice("abc ?x") for _ in range(rnd.randint(0, 9))),
              "".join(rnd.choice("abc ?x") for _ in range(rnd.randint(0, 9)))) for _ in range(250)]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", D.hamming("a", "b").alias("h"), D.jaccard("a", "b").alias("j")).collect()
    for r in rows:
        assert r["h"] == ham(r["a"], r["b"]), (r["a"], r["b"])
        assert abs(r["j"] - jac(r["a"], r["b"])) < 1e-12, (r["a"], r["b"])
