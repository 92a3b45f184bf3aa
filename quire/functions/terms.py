"""Terms as preorder token arrays, and template functions on them.

A term is ``array<struct<kind string, name string, type string>>`` in preorder.
``kind`` is one of ``app`` (two children), ``abs`` (one child; ``name`` is the
bound name), ``const``, ``var``, ``free`` and ``bound`` (``name`` is the 0-based
preorder number of its binder).  Two arrays are equal exactly when the trees are
equal, so equality up to renaming becomes an equi-join on a canonical array.

Every function here is a built-in higher-order expression (``transform``,
``filter``, ``aggregate``, ``array_position``).  An expression that a function uses more than
once is bound by ``let``: Spark evaluates it again wherever it stands, and inside a lambda again
for every element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
# Constant-name prefixes kept in templates (structural, never holes or fillers).
KEEP_PREFIXES = [
    "HOL.", "Pure.", "Set.Ball", "Set.Bex",
    "Orderings.ord_class.less", "Orderings.ord_class.less_eq",
    "Orderings.ord_class.greater", "Orderings.ord_class.greater_eq",
    "Set.member", "Product_Type.Pair",
]
# Theorem-name patterns the search leaves out (wildcards match anywhere in the name).
BAD_NAME_PATTERNS = [
    "*nitpick*", "*Nitpick*", "*full_exhaustive*", "*_def*", "Enum.finite*",
    "*Quickcheck*", "ATP*", "*Nunchaku*", "*Code*", "*BNF*", "*SMT*",
]
# Type constructors never counted as used symbols.
UNIVERSAL_TYPES = ["fun", "prop", "itself", "dummy", "proof", "Pure.proof"]
# Constant marking a type constraint (not a symbol).
TYPE_CONSTRAINT = "_type_constraint_"
# ---------------------------------------------------------------------------

TOKEN = "struct<kind:string,name:string,type:string>"
TERM = f"array<{TOKEN}>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tok(kind, name, typ=None) -> Column:
    """One token; arguments are Columns or Python literals."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(kind).cast("string").alias("kind"), lit(name).cast("string").alias("name"),
                    lit(typ).cast("string").alias("type"))


def keep_constant(name) -> Column:
    """Is the constant structural (kept in templates)?"""
    n = _col(name)
    out = F.lit(False)
    for p in KEEP_PREFIXES:
        out = out | n.startswith(p)
    return out


def type_arity(typ) -> Column:
    """Number of top-level argument types of ``a => b => c`` (0 for non-functions): the arrows
    outside all brackets."""
    marks = F.regexp_extract_all(_col(typ), F.lit(r"(\(|\)|=>)"), 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"))
    step = lambda a, m: F.struct(
        (a["depth"] + F.when(m == "(", 1).when(m == ")", -1).otherwise(0)).alias("depth"),
        (a["n"] + F.when((m == "=>") & (a["depth"] == 0), 1).otherwise(0)).alias("n"))
    return F.aggregate(marks, start, step, lambda a: a["n"])


def _is_hole_const(t: Column) -> Column:
    return (t["kind"] == "const") & ~keep_constant(t["name"])


def _distinct_keys(keys: Column) -> Column:
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (a one-element transform)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _binder_no(tokens: Column, i: Column) -> Column:
    """Preorder number of the binder at index ``i``: number of ``abs`` tokens before it."""
    return F.size(F.filter(F.slice(tokens, 1, i), lambda x: x["kind"] == "abs"))


def abstract(tokens, poly: bool = False) -> Column:
    """Non-structural constants -> holes ``?H1, ?H2 ...`` (a Var named ``?Hk``)
    numbered by first occurrence of (name, type) - or name only when ``poly``; Vars
    -> Frees ``x_1 ...`` with their own counter; binders -> ``y_k`` by preorder."""
    hkey = lambda t: F.when(_is_hole_const(t), t["name"] if poly else F.concat_ws("::", t["name"], t["type"]))
    vkey = lambda t: F.when(t["kind"] == "var", F.concat_ws("::", t["name"], t["type"]))

    def renamed(k):
        # each token's keys (NULL for a token of another kind) and the distinct ones are made once
        both = F.struct(_distinct_keys(k["h"]).alias("h"), _distinct_keys(k["v"]).alias("v"))
        return let(both, lambda d: F.transform(k["ts"], lambda t, i: (
            F.when(F.get(k["h"], i).isNotNull(), tok("var", F.concat(F.lit("?H"), F.array_position(d["h"], F.get(k["h"], i)).cast("string")), t["type"]))
            .when(t["kind"] == "var", tok("free", F.concat(F.lit("x_"), F.array_position(d["v"], F.get(k["v"], i)).cast("string")), t["type"]))
            .when(t["kind"] == "abs", tok("abs", F.concat(F.lit("y_"), _binder_no(k["ts"], i).cast("string")), t["type"]))
            .otherwise(t))))

    return let(_col(tokens), lambda ts: let(F.struct(ts.alias("ts"), F.transform(ts, hkey).alias("h"), F.transform(ts, vkey).alias("v")), renamed))


def canon(tokens, kind: str = "var", typed: bool = True) -> Column:
    """T6 (``kind='var'``) / T7 (``kind='free'``): rename that kind to Frees ``x_1 ...``
    by first occurrence and binders to ``y_k``; ``typed=False`` drops all types
    (the untyped comparison)."""
    key = lambda t: F.when(t["kind"] == kind, F.concat_ws("::", t["name"], t["type"]))
    none = F.lit(None).cast("string")
    typ = lambda t: t["type"] if typed else none

    def renamed(ts, d):
        return F.transform(ts, lambda t, i: (
            F.when(t["kind"] == kind, tok("free", F.concat(F.lit("x_"), F.array_position(d, key(t)).cast("string")), typ(t)))
            .when(t["kind"] == "abs", tok("abs", F.concat(F.lit("y_"), _binder_no(ts, i).cast("string")), typ(t)))
            .otherwise(t if typed else tok(t["kind"], t["name"], none))))

    return let(_col(tokens), lambda ts: let(_distinct_keys(F.transform(ts, key)), lambda d: renamed(ts, d)))


def render(tokens) -> Column:
    """Prefix rendering, one word per token: ``$`` application, ``%y.`` binder,
    ``B<k>`` bound variable, names otherwise (no infix notation)."""
    return F.array_join(F.transform(_col(tokens), lambda t: (
        F.when(t["kind"] == "app", F.lit("$"))
        .when(t["kind"] == "abs", F.concat(F.lit("%"), t["name"], F.lit(".")))
        .when(t["kind"] == "bound", F.concat(F.lit("B"), t["name"]))
        .otherwise(t["name"]))), " ")


def render_filled(rendered_template, filling, max_holes: int) -> Column:
    """T3 of T8 without building the filled tokens: substitute every hole word
    ``?Hk`` (k <= ``max_holes``) of a rendered template by its filling.  Equal to
    ``render(fill(template, filling))``: a rendered hole is its name and a filled
    hole renders as the symbol.  Plain (codegen) string replaces on a space-padded
    text, done twice so that adjacent occurrences are both replaced."""
    m = _col(filling)
    x = F.concat(F.lit(" "), _col(rendered_template), F.lit(" "))
    for k in range(1, max_holes + 1):
        hole = f"?H{k}"
        sym = F.coalesce(F.try_element_at(m, F.lit(hole)), F.lit(hole))
        for _ in range(2):
            x = F.replace(x, F.lit(f" {hole} "), F.concat(F.lit(" "), sym, F.lit(" ")))
    return F.substring(x, F.lit(2), F.length(x) - 2)


def filling_text(filling, max_holes: int) -> Column:
    """A filling as ``?H1=sym,?H2=sym`` in sorted key order (as ``array_sort`` of its
    entries would give), from plain map lookups for holes 1..``max_holes``."""
    m = _col(filling)
    keys = sorted(f"?H{k}" for k in range(1, max_holes + 1))
    parts = [F.when(F.map_contains_key(m, F.lit(h)), F.concat(F.lit(h + "="), F.element_at(m, F.lit(h)))) for h in keys]
    return F.concat_ws(",", *parts) if parts else F.lit("")


def _hole_vars(template) -> Column:
    return F.filter(_col(template), lambda t: (t["kind"] == "var") & t["name"].startswith("?H"))


def holes(template) -> Column:
    """T4: distinct holes of a template, by first occurrence, with the type and arity met there.

    A hole is its name: with one hole per (name, type) it has one type; with one hole per name
    (poly) the types of its occurrences may differ, see ``well_typed``."""
    named = lambda hs: F.struct(hs.alias("hs"), F.transform(hs, lambda h: h["name"]).alias("names"))
    return let(_hole_vars(template), lambda hs: let(named(hs), lambda x: F.transform(
        F.filter(x["hs"], lambda t, i: F.array_position(x["names"], t["name"]) == i + 1),
        lambda t: F.struct(t["name"].alias("hole"), t["type"].alias("type"), type_arity(t["type"]).alias("arity")))))


def well_typed(template) -> Column:
    """Does every hole have one type wherever it occurs?  A template in which one doesn't is not
    accepted by the type check."""
    return let(_hole_vars(template), lambda hs: F.size(F.array_distinct(F.transform(hs, lambda t: t["name"])))
                == F.size(F.array_distinct(F.transform(hs, lambda t: F.struct(t["name"], t["type"])))))


def unvarify(template) -> Column:
    """T5: every Var becomes a Free; a hole ``?Hk`` becomes ``Hk``."""
    return F.transform(_col(template), lambda t: F.when(
        t["kind"] == "var", tok("free", F.regexp_replace(t["name"], r"^\?", ""), t["type"])).otherwise(t))


def fill(template, filling) -> Column:
    """Replace every hole by the constant its filling (``map<hole, symbol>``) names;
    the constant takes the hole's type.  Holes without a filling stay."""
    m = _col(filling)
    return F.transform(_col(template), lambda t: F.when(
        (t["kind"] == "var") & F.map_contains_key(m, t["name"]),
        tok("const", F.element_at(m, t["name"]), t["type"])).otherwise(t))


def form_word(name) -> Column:
    """A constant's name as a word that says where it ends: words set one behind another are read in one way only."""
    n = _col(name)
    return F.coalesce(F.concat(F.length(n).cast("string"), F.lit(":"), n), F.lit("-"))


def form_parts(canonical, holes=None) -> Column:
    """A canonical form as an array of words, ``word`` or ``hole``: first a digest of all but the constants' names, then
    the word of every constant in order.  A Var that ``holes`` names counts as the constant that will fill it."""
    name_of = lambda t: F.when(t["kind"] == "var", t["name"])
    hole = (lambda t: F.coalesce(F.array_contains(holes, name_of(t)), F.lit(False))) if holes is not None else (lambda t: F.lit(False))
    none = F.lit(None).cast("string")
    part = lambda word, h: F.struct(word.alias("word"), h.alias("hole"))

    def parts(ts):
        blank = F.transform(ts, lambda t: F.when((t["kind"] == "const") | hole(t), tok("const", none, t["type"])).otherwise(t))
        names = F.transform(F.filter(ts, lambda t: (t["kind"] == "const") | hole(t)), lambda t: part(
            F.when(~hole(t), form_word(t["name"])), F.when(hole(t), t["name"])))
        return F.concat(F.array(part(F.sha2(F.to_json(blank), 256), none)), names)

    return let(_col(canonical), parts)


def filled_parts(parts, names, symbols) -> Column:
    """The text of a form's parts with the word of its symbol in place of every hole, or NULL if it isn't among
    ``names``: as pieces, with that hole between them."""
    word = lambda p: F.coalesce(p["word"], F.when(F.array_contains(names, p["hole"]), form_word(F.get(symbols, (F.array_position(names, p["hole"]) - 1).cast("int")))))
    on = lambda pieces, w: F.concat(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.array(F.concat(F.element_at(pieces, -1), w)))
    return F.aggregate(F.transform(_col(parts), word), F.array(F.lit("")), lambda pieces, w: F.when(w.isNull(), F.array_append(pieces, F.lit(""))).otherwise(on(pieces, w)))


def form_digest(text) -> Column:
    """128 bits of SHA-256 of a form's text."""
    return F.unhex(F.substring(F.sha2(_col(text), 256), 1, 32))


def form(canonical) -> Column:
    """The digest by which canonical forms are told apart: equal when the token arrays are."""
    return form_digest(F.array_join(F.transform(form_parts(canonical), lambda p: p["word"]), ""))


def symbols_of(tokens) -> Column:
    """Distinct non-structural constant names (binders included).  The prover
    collects names by prepending each new one, so the list is in *reverse* order of
    first occurrence."""
    return F.reverse(F.array_distinct(F.transform(F.filter(_col(tokens), _is_hole_const), lambda t: t["name"])))


def leaf_constants(tokens) -> Column:
    """Constant leaves reached through applications only (a binder is a leaf
    that is not a constant, so nothing under it counts), in order with duplicates;
    type-constraint marks are dropped.  ``array_distinct`` gives the distinct form
    (first occurrence kept)."""
    names = F.array().cast("array<string>")

    def step(a, t):
        counts = (a["open"] == 0) & (t["kind"] == "const") & (t["name"] != TYPE_CONSTRAINT)
        return F.struct(_open_after(a["open"], t).alias("open"), F.when(counts, F.array_append(a["names"], t["name"])).otherwise(a["names"]).alias("names"))

    return F.aggregate(_col(tokens), F.struct(F.lit(0).alias("open"), names.alias("names")), step, lambda a: a["names"])


# The type operators, from the one that binds least, with the names of their constructors.
TYPE_OPERATORS = [("fun", ["=>", "⇒", "\\<Rightarrow>"]), ("sum", ["+"]), ("prod", ["*", "×", "\\<times>"])]
# The lexemes of a type text; a sort constraint (``::`` and a sort) says nothing about names.
TYPE_LEXEME = r"::\s*(?:\{[^}]*\}|[\w.]+)|\??'[\w.']+|=>|⇒|\\<Rightarrow>|×|\\<times>|[A-Za-z_][\w.']*|[()\[\],*+]"


def type_names(typ) -> Column:
    """Type constructor names of a type text in the order of its tree, a constructor before its arguments:
    ``nat list`` gives ``list, nat``; ``(a, b) map => [c, d * e] => f`` gives ``fun, map, a, b, fun, c, fun,
    prod, d, e, f``.

    ``=>``, ``+`` and ``*`` bind in this order, least first, all to the right; constructors are postfix.
    Type variables and sort constraints give nothing; a text with unbalanced brackets gives
    nothing at all.  One pass over the lexemes from the right: the names found so far, which operators stand
    to the right of the operand being read, the constructors that wait for it, and a stack of these for the
    brackets around it.
    """
    lex = F.filter(F.regexp_extract_all(_col(typ), F.lit(TYPE_LEXEME), F.lit(0)), lambda x: ~x.startswith("::"))
    # each lexeme with the one on its left, from the right
    pairs = F.reverse(F.transform(lex, lambda x, i: F.struct(x.alias("x"), F.when(i > 0, F.get(lex, i - 1)).alias("left"))))
    names = "array<string>"
    level = "struct<fun:boolean,sum:boolean,prod:boolean,wait:array<string>,square:boolean>"
    none = F.array().cast(names)
    fresh = lambda square: F.struct(F.lit(False).alias("fun"), F.lit(False).alias("sum"), F.lit(False).alias("prod"), none.alias("wait"), square.alias("square"))
    start = F.struct(none.alias("out"), fresh(F.lit(False)).cast(level).alias("at"), F.array().cast(f"array<{level}>").alias("around"), F.lit(True).alias("ok"))

    def ended(out, at, upto: int):
        """Names in front of an operand that ends here, for the operators that bind from ``upto`` on."""
        for name, _ in TYPE_OPERATORS[:upto - 1 if upto else None:-1]:
            out = F.when(at[name], F.concat(F.array(F.lit(name)), out)).otherwise(out)
        return out

    def step(s, p):
        x, at, out = p["x"], s["at"], s["out"]
        mark = lambda fun, sum_, prod, wait=at["wait"], square=at["square"]: F.struct(
            fun.alias("fun"), sum_.alias("sum"), prod.alias("prod"), wait.alias("wait"), square.alias("square"))
        yes, no = F.lit(True), F.lit(False)
        is_name, is_var = x.rlike("^[A-Za-z_]"), x.rlike(r"^\??'")
        after_operand = F.coalesce(p["left"].rlike(r"^[A-Za-z_']|^\?'|^\)$"), no)
        opens, closes = x.isin("(", "["), x.isin(")", "]")
        whole = lambda o: ended(o, at, 0)
        back = F.element_at(s["around"], -1)  # read only where there is one
        has = F.size(s["around"]) > 0
        fits = has & (at["square"] == (x == "["))
        outer = F.when(has, back)
        state = lambda out, at, around=s["around"], ok=s["ok"]: F.struct(out.alias("out"), at.cast(level).alias("at"), around.alias("around"), ok.alias("ok"))
        waiting = lambda atom: F.concat(at["wait"], atom, out)
        settled = mark(at["fun"], at["sum"], at["prod"], none)
        popped = F.struct(outer["fun"].alias("fun"), outer["sum"].alias("sum"), outer["prod"].alias("prod"), none.alias("wait"), outer["square"].alias("square"))
        ops = dict(TYPE_OPERATORS)
        return (
            F.when(is_name & after_operand, state(out, mark(at["fun"], at["sum"], at["prod"], F.concat(at["wait"], F.array(x)))))
            .when(is_name, state(waiting(F.array(x)), settled))
            .when(is_var, state(waiting(none), settled))
            .when(closes, state(out, fresh(x == "]"), F.array_append(s["around"], at)))
            .when(opens & ~fits, state(out, at, s["around"], no))
            .when(opens, state(F.concat(outer["wait"], whole(out)), popped, F.slice(s["around"], F.lit(1), F.size(s["around"]) - 1)))
            .when(x == ",", state(F.when(at["square"], F.concat(F.array(F.lit("fun")), whole(out))).otherwise(whole(out)), fresh(at["square"]), s["around"], s["ok"] & has))
            .when(x.isin(*ops["prod"]), state(ended(out, at, 2), mark(at["fun"], at["sum"], yes)))
            .when(x.isin(*ops["sum"]), state(ended(out, at, 1), mark(at["fun"], yes, no)))
            .otherwise(state(whole(out), mark(yes, no, no))))

    return F.aggregate(pairs, start, step, lambda s: F.when(s["ok"] & (F.size(s["around"]) == 0), ended(s["out"], s["at"], 0)).otherwise(none))


def used_constants_many(inners) -> Column:
    """Constants over several texts of a row, distinct, first occurrence kept.
    ``inners`` is ``array<struct<kind, tokens, type>>``: a ``term`` gives its leaf
    constants (X13); a ``type`` its constructor names minus the universal ones; any
    other kind (text that parses as neither) gives nothing."""
    return F.array_distinct(F.flatten(F.transform(_col(inners), used_constants)))


def used_constants(inner) -> Column:
    """X14 of one text, with duplicates: for texts that several rows hold, taken once before these meet them."""
    x = _col(inner)
    return (F.when(x["kind"] == "term", leaf_constants(x["tokens"]))
            .when(x["kind"] == "type", F.filter(type_names(x["type"]), lambda n: ~n.isin(UNIVERSAL_TYPES)))
            .otherwise(F.array().cast("array<string>")))


def has_vars(tokens) -> Column:
    """Does the term contain a schematic variable?"""
    return F.exists(_col(tokens), lambda t: t["kind"] == "var")


def _open_after(open_: Column, t: Column) -> Column:
    """How many children of the outermost abstraction are still to come behind a token, from how many were
    before it (0: it is outside every one).  In preorder, app opens one more and a leaf closes one."""
    inside = open_ + F.when(t["kind"] == "app", 1).when(t["kind"] == "abs", 0).otherwise(-1)
    return F.when(open_ > 0, inside).otherwise(F.when(t["kind"] == "abs", 1).otherwise(0))


def outside_abs(tokens) -> Column:
    """For every token: is it outside every abstraction?  One pass over the tokens."""
    step = lambda a, t: F.struct(
        _open_after(a["open"], t).alias("open"), F.array_append(a["flags"], a["open"] == 0).alias("flags"))
    start = F.struct(F.lit(0).alias("open"), F.array().cast("array<boolean>").alias("flags"))
    return F.aggregate(_col(tokens), start, step, lambda a: a["flags"])


def has_equality(tokens) -> Column:
    """P10: does the term contain ``HOL.eq`` outside abstractions?"""
    step = lambda a, t: F.struct(
        _open_after(a["open"], t).alias("open"),
        (a["found"] | ((a["open"] == 0) & (t["kind"] == "const") & (t["name"] == "HOL.eq"))).alias("found"))
    return F.aggregate(_col(tokens), F.struct(F.lit(0).alias("open"), F.lit(False).alias("found")), step, lambda a: a["found"])


def strip_trueprop(tokens) -> Column:
    """Drop an outer ``HOL.Trueprop`` application (``app``, ``const HOL.Trueprop``)."""
    def stripped(ts):
        top = (F.size(ts) >= 2) & (ts[0]["kind"] == "app") & (ts[1]["kind"] == "const") & (ts[1]["name"] == "HOL.Trueprop")
        return F.when(top, F.slice(ts, 3, F.size(ts))).otherwise(ts)

    return let(_col(tokens), stripped)


def bad_name(name) -> Column:
    """Does the name match a left-out pattern (wildcards match anywhere)?"""
    n = _col(name)
    out = F.lit(False)
    for p in BAD_NAME_PATTERNS:
        out = out | n.contains(p.replace("*", ""))
    return out
