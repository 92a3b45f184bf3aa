"""Fillings by number, their exact counts, and runs within a limit of work."""

import itertools
import random

import pytest

from quire.functions import terms as TM
from quire.functions.terms import TOKEN
from quire.operators import templates as TP

TYPES = ["nat", "nat => nat", "nat => nat => nat"]
SYMBOLS = "symbol string, type string, arity int, sym_pos long"


def term(arities):
    """An application chain over one constant per hole, with these arities."""
    consts = [("const", f"A.c{i}", TYPES[a]) for i, a in enumerate(arities)]
    return [("app", None, None)] * len(consts) + consts + [("var", "x", "nat")]


def fits(hole, symbol, multi):
    return (hole == 0 or symbol > 0) if multi else hole == symbol


def brute(arities, symbols, multi, distinct):
    """All fillings as tuples of symbols, tried one by one."""
    out = []
    for pick in itertools.product(range(len(symbols)), repeat=len(arities)):
        if distinct and len(set(pick)) < len(pick):
            continue
        if all(fits(h, symbols[i][2], multi) for h, i in zip(arities, pick)):
            out.append(tuple(symbols[i][0] for i in pick))
    return sorted(out)


@pytest.mark.parametrize("multi,distinct", [(False, False), (True, False), (True, True), (False, True)])
def test_numbers_give_every_filling_once(spark, monkeypatch, multi, distinct):
    """In small ranges and tasks, over mixed arities, a symbol listed twice and templates without fillings or holes."""
    monkeypatch.setattr(TP, "RANGE", 3)
    monkeypatch.setattr(TP, "_RANGES_AT_ONCE", 4)
    monkeypatch.setattr(TP, "FILLINGS_PER_TASK", 10)
    rnd = random.Random(7)
    symbols = [(f"L.s{i % 4}", TYPES[a], a, 10 - i) for i, a in enumerate([0, 1, 2, 1, 0, 1])]
    cases = [[]] + [[rnd.randrange(3) for _ in range(rnd.randint(1, 4))] for _ in range(25)] + [[2, 2, 2], [1, 1, 1, 1]]
    terms = spark.createDataFrame([(i, term(c)) for i, c in enumerate(cases)], f"term_id long, tokens array<{TOKEN}>")
    tpl = TP.make_templates(terms, printed=False)
    sy = spark.createDataFrame(symbols, SYMBOLS)
    got = {i: [] for i in range(len(cases))}
    for r in TP.fill_holes(tpl, sy, multi=multi, distinct_symbols=distinct).collect():
        got[r["term_id"]].append(tuple(r["filling"][f"?H{k + 1}"] for k in range(len(cases[r["term_id"]]))))
    want = {i: brute(c, symbols, multi, distinct) for i, c in enumerate(cases)}
    assert {i: sorted(f) for i, f in got.items()} == want
    counts = {r["term_id"]: int(r["n_fillings"]) for r in TP.filling_counts(tpl, sy, multi, distinct).collect()}
    assert counts == {i: len(f) for i, f in want.items()}


def test_one_hot_template_is_many_even_tasks(spark, monkeypatch):
    monkeypatch.setattr(TP, "FILLINGS_PER_TASK", 5_000)
    terms = spark.createDataFrame([(1, term([1, 1, 1]))], f"term_id long, tokens array<{TOKEN}>")
    sy = spark.createDataFrame([(f"L.s{i}", TYPES[1], 1, i) for i in range(50)], SYMBOLS)
    monkeypatch.setattr(TP, "RANGE", 500)
    filled = TP.fill_holes(TP.make_templates(terms, printed=False), sy)
    sizes = [r["count"] for r in filled.groupBy(TM.F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 50 ** 3 and len(sizes) > 15 and max(sizes) < 50 ** 3 / 5


def test_counts_beyond_any_filling(spark):
    """Counting makes nothing: 200^12 fillings are a number."""
    terms = spark.createDataFrame([(1, term([1] * 12))], f"term_id long, tokens array<{TOKEN}>")
    sy = spark.createDataFrame([(f"L.s{i}", TYPES[1], 1, i) for i in range(200)], SYMBOLS)
    tpl = TP.make_templates(terms, printed=False)
    assert int(TP.filling_counts(tpl, sy).first()["n_fillings"]) == 200 ** 12
    assert TP.limited_runs(tpl, sy, budget=1_000_000).first()["status"] == "timeout"


def test_explore_outcomes(spark):
    """true, false, empty, timeout and error, each from its data."""
    eq = ("const", "HOL.eq", "nat => nat => bool")
    app = ("app", None, None)
    x = ("var", "x", "nat")

    def statement(f, rhs):
        return [app, app, eq, app, ("const", f, "nat => nat"), x, rhs]

    two = [app, app, eq, app, ("const", "A.f", "nat => nat"), x, app, ("const", "A.f", "int => int"), ("const", "A.c", "nat")]
    terms = spark.createDataFrame([
        (1, statement("A.f", x)), (2, statement("A.f", x)), (3, statement("A.f", x)), (4, statement("A.f", x)), (5, two), (6, statement("A.f", x)),
    ], f"term_id long, tokens array<{TOKEN}>")
    own = [(1, "A.f", 1)] + [(2, "A.g", 1)] + [(3, "A.c", 0)] + [(4, f"A.f{i}", 1) for i in range(4)] + [(5, "A.f", 1), (5, "A.c", 0)]
    sy = spark.createDataFrame([(t, s, TYPES[a], a, i) for i, (t, s, a) in enumerate(own)], "term_id long, " + SYMBOLS)
    got = {r["term_id"]: r["status"] for r in TP.explore(terms, sy, budget=3, poly=True, per_term=True).collect()}
    assert got == {1: "true", 2: "false", 3: "empty", 4: "timeout", 5: "error", 6: "empty"}
