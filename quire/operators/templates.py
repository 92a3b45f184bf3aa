"""Template jobs: abstraction, hole filling by joins, candidate matching, theorem search.

terms      (term_id long, name string, tokens array<token>)
templates  (term_id long, template array<token>, holes array<struct<hole,type,arity>>)
symbols    (symbol string, type string, arity int [, term_id long])   -- fillers
candidates (term_id long, filling map<string,string>, candidate array<token>)

Filling is unranking: a template with n fillings has them numbered 0 .. n - 1, and the filling of
a number is computed from it, digit by digit, without a join per hole.  The numbers are cut into
ranges that are dealt to tasks, so one template with very many fillings is many even tasks.  The
number of fillings is known before any is made (``filling_counts``), which is what a limit of
work is tested against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import terms as TM
from quire.session import cut_lineage, large_join

def make_templates(terms: DataFrame, poly: bool = False, printed: bool = True) -> DataFrame:
    """T1/T2 + T4: a template per term with its holes.  ``printed`` drops an outer
    Trueprop, as printing and re-reading the template does."""
    t = TM.abstract("tokens", poly=poly)
    if printed:
        t = TM.strip_trueprop(t)
    return terms.select("term_id", t.alias("template")).withColumn("holes", TM.holes("template"))


def _feasibility_class(arity: Column, multi: bool, side: str) -> Column:
    """Join keys that turn feasibility into equality.

    exact (J11): the arity itself.  multi (J12): a function hole ('f') needs a
    function symbol; a non-function hole ('any') takes every symbol, so a function
    symbol carries both classes.
    """
    if not multi:
        return F.array(arity.cast("string"))
    if side == "hole":
        return F.array(F.when(arity > 0, F.lit("f")).otherwise(F.lit("any")))
    return F.when(arity > 0, F.array(F.lit("f"), F.lit("any"))).otherwise(F.array(F.lit("any")))


def feasible_options(templates: DataFrame, symbols: DataFrame, multi: bool = False, per_term: bool = False) -> DataFrame:
    """J11/J12 as a table: every (term, hole index, hole) with each feasible filler
    (structural constants removed, P9).  ``fill_holes`` has the same test in its
    filler lists; this lists the options themselves."""
    hs = templates.select("term_id", F.posexplode("holes").alias("hole_idx", "h")).select(
        "term_id", (F.col("hole_idx") + 1).alias("hole_idx"), F.col("h.hole").alias("hole"),
        _feasibility_class(F.col("h.arity"), multi, "hole")[0].alias("fclass"))
    sy = _symbol_side(symbols, multi, per_term)
    return hs.join(sy, [*(["term_id"] if per_term else []), "fclass"]).drop("fclass")


def _symbol_side(symbols: DataFrame, multi: bool, per_term: bool) -> DataFrame:
    sy = symbols.where(~TM.keep_constant("symbol"))
    return sy.select(*(["term_id"] if per_term else []), "symbol", F.col("sym_pos").cast("long").alias("sym_pos"),
                     F.explode(_feasibility_class(F.col("arity"), multi, "symbol")).alias("fclass"))


# The class of a hole that takes every symbol.
_FREE = "free"
# Numbers of one range (a range of a template with longer filler lists has as many as those have
# entries, so that the lists it carries never outweigh its fillings), and of one task.
RANGE = 1 << 13
FILLINGS_PER_TASK = 1 << 17
_RANGES_AT_ONCE = 1 << 12


def _filler_lists(symbols: DataFrame, multi: bool, per_term: bool) -> DataFrame:
    """([term_id,] fclass, options): the fillers of every class in list order, each with its place in
    the whole list.  A list is one array: it holds the functions known to one theory."""
    scope = ["term_id"] if per_term else []
    entry = F.struct(F.col("sym_pos").cast("long").alias("sym_pos"), "symbol", F.col("arity").cast("int").alias("arity"))
    whole = symbols.where(~TM.keep_constant("symbol")).groupBy(*scope).agg(F.array_sort(F.collect_list(entry)).alias("all"))
    placed = F.transform("all", lambda x, i: F.struct(x["symbol"].alias("symbol"), i.alias("at"), x["arity"].alias("arity")))
    keys = F.array_distinct(F.flatten(F.transform("placed", lambda x: F.concat(_feasibility_class(x["arity"], multi, "symbol"), F.array(F.lit(_FREE))))))
    classes = F.transform(keys, lambda k: F.struct(k.alias("fclass"), F.filter("placed", lambda x: (
        (k == _FREE) | F.array_contains(_feasibility_class(x["arity"], multi, "symbol"), k))).alias("options")))
    rows = whole.select(*scope, placed.alias("placed")).select(*scope, F.explode(classes).alias("c"))
    return rows.select(*scope, "c.fclass", F.transform("c.options", lambda x: F.struct(x["symbol"].alias("symbol"), x["at"].alias("at"))).alias("options"))


def _hole_classes(templates: DataFrame, multi: bool, distinct_symbols: bool) -> DataFrame:
    """(term_id, k, hole, fclass) of every hole.  Under J14 a template that isn't well typed skips
    feasibility: its holes take every symbol."""
    skip = ~TM.well_typed("template") if distinct_symbols else F.lit(False)
    hs = templates.select("term_id", skip.alias("skip"), F.posexplode("holes").alias("k", "h"))
    fclass = F.when(F.col("skip"), _FREE).otherwise(_feasibility_class(F.col("h.arity"), multi, "hole")[0])
    return hs.select("term_id", "k", F.col("h.hole").alias("hole"), fclass.alias("fclass"))


def _choices(holes: Column, distinct_symbols: bool) -> Column:
    """How many fillers each hole of an ordered list has left when those before it are filled."""
    if not distinct_symbols:
        return F.transform(holes, lambda h: h["n"])
    # classes are disjoint, but for those that take every symbol, whose holes come last
    before = lambda h, i: F.size(F.filter(F.slice(holes, 1, i), lambda b: (b["fclass"] == h["fclass"]) | h["whole"]))
    return F.transform(holes, lambda h, i: F.greatest(h["n"] - before(h, i), F.lit(0)))


def _sized_holes(templates: DataFrame, lists: DataFrame, multi: bool, distinct_symbols: bool, per_term: bool) -> DataFrame:
    """(term_id, hs, choices, n_fillings): the holes in the order in which they are filled, with their list's
    size, how many choices each leaves, and the exact number of fillings."""
    sizes = lists.select(*(["term_id"] if per_term else []), "fclass", F.size("options").alias("n"))
    on = [*(["term_id"] if per_term else []), "fclass"]
    classes = _hole_classes(templates, multi, distinct_symbols)
    # one row a class, unless every term has lists of its own
    found = large_join(classes, sizes, on, "left") if per_term else classes.join(F.broadcast(sizes), on, "left")
    whole = F.col("fclass").isin("any", _FREE)
    hole = F.struct(whole.alias("whole"), "k", "hole", "fclass", F.coalesce("n", F.lit(0)).alias("n"))
    per = found.groupBy("term_id").agg(F.array_sort(F.collect_list(hole)).alias("hs"))
    every = large_join(templates.select("term_id"), per, "term_id", "left")
    none = F.array().cast(per.schema["hs"].dataType)
    sized = every.select("term_id", F.coalesce("hs", none).alias("hs")).withColumn("choices", _choices(F.col("hs"), distinct_symbols))
    total = F.aggregate("choices", F.lit(1).cast("decimal(38,0)"), lambda p, n: (p * n.cast("decimal(10,0)")).cast("decimal(38,0)"))
    return sized.withColumn("n_fillings", total)


def filling_counts(templates: DataFrame, symbols: DataFrame, multi: bool = False, distinct_symbols: bool = False,
                   per_term: bool = False) -> DataFrame:
    """(term_id, n_fillings): the exact number of fillings of every template, before any is made: the
    product of the choices per hole; under J14 each hole loses those that the holes before it took."""
    lists = _filler_lists(symbols, multi, per_term)
    return _sized_holes(templates, lists, multi, distinct_symbols, per_term).select("term_id", "n_fillings")


def materialize(templates: DataFrame) -> DataFrame:
    """Write the template table once to the shared checkpoint folder and read it
    back (every step reads it instead of recomputing it)."""
    return cut_lineage(templates, "templates")


def _distinct_fillings(rows: DataFrame, parts: str | None) -> DataFrame:
    """The fillings numbered ``start`` up to ``end`` of every row, as the holes' ``names`` and their ``symbols``.  A filling's
    symbols, in the order of ``hs``, come from its number: a digit per hole, the last hole's counting fastest.
    ``hs`` carries the options, ``rest`` how many fillings the holes behind each one have, ``choices`` how many
    choices it leaves."""
    each = rows.withColumn("number", F.explode(F.sequence("start", F.col("end") - 1)))
    digits = F.transform("rest", lambda r, i: (_div(F.col("number"), r) % F.get("choices", i)).cast("int"))
    # the d-th filler that no hole before took: d, moved on past every taken place up to it
    start = F.array().cast("array<struct<fclass:string,place:int,at:int,symbol:string>>")

    def pick(taken, x):
        h = x["hs"]
        places = F.array_sort(F.transform(F.filter(taken, lambda t: h["whole"] | (t["fclass"] == h["fclass"])), lambda t: F.when(h["whole"], t["at"]).otherwise(t["place"])))
        place = F.aggregate(places, x["digits"], lambda p, t: p + F.when(t <= p, 1).otherwise(0))
        option = F.get(h["options"], place)
        return F.array_append(taken, F.struct(h["fclass"].alias("fclass"), place.alias("place"), option["at"].alias("at"), option["symbol"].alias("symbol")))

    taken = F.aggregate(F.arrays_zip(F.col("hs").alias("hs"), digits.alias("digits")), start, pick)
    each = each.withColumn("names", F.transform("hs", lambda h: h["hole"])).withColumn("symbols", F.transform(taken, lambda t: t["symbol"]))
    return each.withColumn(parts, F.array_join(TM.filled_parts(parts, F.col("names"), F.col("symbols")), "")) if parts else each


def _free_fillings(rows: DataFrame, parts: str | None) -> DataFrame:
    """The same where symbols may repeat.  The symbols of all holes but the last are worked out once for the
    fillings that share them; the last hole's fillers, which count fastest, are listed behind these."""
    last = F.element_at("hs", -1)
    rows = rows.withColumn("names", F.transform("hs", lambda h: h["hole"])).withColumn(
        "lasts", F.when(F.size("hs") > 0, F.transform(last["options"], lambda o: o["symbol"])).otherwise(F.array(F.lit("")))).withColumn("n_last", F.size("lasts").cast("long"))
    each = rows.withColumn("outer", F.explode(F.sequence(_div(F.col("start"), F.col("n_last")), _div(F.col("end") - 1, F.col("n_last")))))
    before = lambda c: F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))
    digits = F.transform(before(F.col("rest")), lambda r, i: (_div(F.col("outer"), _div(r, F.col("n_last"))) % F.get("choices", i)).cast("int"))
    first = F.zip_with(before(F.col("hs")), digits, lambda h, d: F.get(h["options"], d)["symbol"])
    base = F.col("outer") * F.col("n_last")
    lo, hi = F.greatest(F.col("start") - base, F.lit(0)), F.least(F.col("end") - base, F.col("n_last"))
    each = each.withColumn("first", first)
    if parts:
        each = each.withColumn(parts, TM.filled_parts(parts, before(F.col("names")), F.col("first")))
    each = each.withColumn("last", F.explode(F.slice("lasts", (lo + 1).cast("int"), (hi - lo).cast("int"))))
    if parts:
        each = each.withColumn(parts, F.call_function("array_join", F.col(parts), TM.form_word("last")))
    return each.withColumn("symbols", F.when(F.size("names") > 0, F.array_append("first", F.col("last"))).otherwise(F.col("first")))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def fill_holes(templates: DataFrame, symbols: DataFrame, multi: bool = False, distinct_symbols: bool = False,
               per_term: bool = False, carry: list[str] | None = None, parts: str | None = None) -> DataFrame:
    """J13 (one feasible symbol per hole, all combinations, symbols may repeat) or
    J14 (``distinct_symbols``: distinct list positions across holes): (term_id, template, ..., filling).

    Feasibility (J11, or J12 when ``multi``) is in the filler lists, which meet their templates in one
    join over all holes.  Each template's numbers 0 .. n - 1 are cut into ranges, and ranges are
    dealt over as many tasks as there are ``FILLINGS_PER_TASK`` in all; a task turns each number into
    its filling.  A template with no holes has one empty filling; a hole with no feasible filler
    leaves its template without fillings.  ``carry`` names extra per-template columns to keep on
    every filling; ``parts`` one of ``terms.form_parts``, which comes back filled, as text.
    """
    carry = [*(carry or []), *([parts] if parts else [])]
    on = [*(["term_id"] if per_term else []), "fclass"]
    lists = cut_lineage(_filler_lists(symbols, multi, per_term), "fillers")
    sized = cut_lineage(_sized_holes(templates, lists, multi, distinct_symbols, per_term).where("n_fillings > 0"), "holes")
    all_numbers = sized.agg(F.sum(F.col("n_fillings").cast("double"))).first()[0] or 0
    tasks = int(min(1 + all_numbers // FILLINGS_PER_TASK, 1 << 20))
    # how many fillings the holes behind each one have
    rest = F.transform("hs", lambda _, i: F.aggregate(F.slice("choices", i + 2, F.size("choices")), F.lit(1).cast("long"), lambda p, n: p * n))
    size = F.greatest(F.lit(RANGE), F.aggregate("hs", F.lit(0).cast("long"), lambda p, h: p + h["n"])).cast("long")
    cut = sized.select("term_id", "hs", "choices", rest.alias("rest"), F.col("n_fillings").cast("long").alias("n"), size.alias("size"))
    ranges = cut.withColumn("last", _div(F.col("n") - 1, F.col("size")))
    ranges = ranges.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col("last"), F.lit(_RANGES_AT_ONCE)))))
    first = F.col("block") * _RANGES_AT_ONCE
    ranges = ranges.withColumn("range", F.explode(F.sequence(first, F.least(first + (_RANGES_AT_ONCE - 1), F.col("last")))))
    # the filler lists meet the ranges that use them: one join over all holes, then one group a range
    hole = ranges.select("term_id", "range", F.posexplode("hs").alias("i", "h")).select("term_id", "range", "i", "h.*")
    met = large_join(hole, lists, on) if per_term else hole.join(lists, on)
    listed = met.groupBy("term_id", "range").agg(F.array_sort(F.collect_list(F.struct("i", "whole", "hole", "fclass", "options"))).alias("hs"))
    none = F.array().cast(listed.schema["hs"].dataType)
    rows = large_join(ranges.drop("hs"), listed, ["term_id", "range"], "left").withColumn("hs", F.coalesce("hs", none))
    rows = large_join(rows, templates.select("term_id", "template", *carry), "term_id").repartition(tasks, "term_id", "range")
    start = F.col("range") * F.col("size")
    rows = rows.withColumn("start", start).withColumn("end", F.least(start + F.col("size"), F.col("n")))
    each = _distinct_fillings(rows, parts) if distinct_symbols else _free_fillings(rows, parts)
    return each.select("term_id", "template", *carry, F.map_from_arrays("names", "symbols").cast("map<string,string>").alias("filling"))


def fill_shapes(templates: DataFrame, symbols: DataFrame, multi: bool = False) -> DataFrame:
    """T9 as text (term_id, filling, candidate): every template is rendered once, and a filling
    substitutes its hole words."""
    t = cut_lineage(templates.select("term_id", "template", "holes", TM.render("template").alias("rendered")), "templates")
    max_h = t.agg(F.max(F.size("holes"))).first()[0] or 0
    filled = fill_holes(t, symbols, multi=multi, carry=["rendered"])
    return filled.select("term_id", TM.filling_text("filling", max_h).alias("filling"), TM.render_filled("rendered", "filling", max_h).alias("candidate"))


def fillings(templates: DataFrame, symbols: DataFrame, distinct_symbols: bool = False, multi: bool = False,
             per_term: bool = False) -> DataFrame:
    """J13/J14 fillings (term_id, filling) without the template column."""
    return fill_holes(templates, symbols, multi=multi, distinct_symbols=distinct_symbols,
                      per_term=per_term).select("term_id", "filling")


def candidates(templates: DataFrame, symbols: DataFrame, multi: bool = False, poly: bool = False,
               per_term: bool = False, materialize: bool = True, forms: bool = False) -> DataFrame:
    """Structural symbols dropped, feasible fillers per hole (J11, or J12 when
    ``multi`` or ``poly``), fillings (J13, or J14 when ``poly``), holes filled (T8).
    ``forms`` adds ``form``, the digest of each candidate's canonical form (T7, untyped).  A filling puts constants into holes and renames no Free or binder, so templates are made canonical once
    and a filling adds its names: reading ``form`` doesn't build a candidate's tokens.

    The templates are read for their holes and again for their tokens; with
    ``materialize`` they are written once to the shared checkpoint folder, so the
    abstraction is computed once and a lost executor recomputes nothing upstream of it.
    """
    parts = TM.form_parts(TM.canon("template", "free", typed=False), F.transform("holes", lambda h: h["hole"])).alias("parts")
    templates = templates.select("term_id", "template", "holes", *([parts] if forms else []))
    if materialize:
        templates = cut_lineage(templates, "templates")
    fl = fill_holes(templates, symbols, multi=multi or poly, distinct_symbols=poly, per_term=per_term, parts="parts" if forms else None)
    return fl.select("term_id", "filling", TM.fill("template", "filling").alias("candidate"), *([TM.form_digest("parts").alias("form")] if forms else []))


def conjectures(cands: DataFrame, refuted: DataFrame) -> DataFrame:
    """Candidates without a counterexample (``refuted`` holds ``canonical`` arrays found false by a
    tester).  The anti join is on the digest of the canonical form, so the refuted side moves 16
    bytes a form and the candidates' forms don't move at all.  Either side may have the digest already, as ``form``."""
    form = lambda df, canonical: (F.col("form") if "form" in df.columns else TM.form(canonical)).alias("__form")
    c = cands.withColumn("__form", form(cands, TM.canon("candidate", "free", typed=False)))
    return large_join(c, refuted.select(form(refuted, "canonical")).distinct(), "__form", "left_anti").drop("__form")


def rediscovered(terms: DataFrame, cands: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Per term, does any candidate match the original?  The original loses an
    outer Trueprop and has its Vars renamed; candidates have their Frees renamed;
    both untyped.  No candidate at all gives ``empty``.  With ``runs`` (term_id, status),
    the guarded runs (U6) that made the candidates, only an ``ok`` run is judged; another's
    status (``timeout``, ``error``) is the outcome, and a term without a run has none."""
    orig = terms.select("term_id", TM.canon(TM.strip_trueprop("tokens"), "var", typed=False).alias("o"))
    c = cands.select("term_id", TM.canon("candidate", "free", typed=False).alias("c"))
    per = large_join(c, orig, "term_id").groupBy("term_id").agg(F.bool_or(F.col("c") == F.col("o")).alias("hit"))
    outcome = F.when(F.col("hit").isNull(), "empty").when(F.col("hit"), "true").otherwise("false")
    if runs is None:
        return large_join(terms.select("term_id"), per, "term_id", "left").select("term_id", outcome.alias("status"))
    judged = large_join(runs.select("term_id", F.col("status").alias("run")), per, "term_id", "left")
    return judged.select("term_id", F.when(F.col("run") == "ok", outcome).otherwise(F.col("run")).alias("status"))


def limited_runs(templates: DataFrame, symbols: DataFrame, budget: int, poly: bool = False, per_term: bool = False) -> DataFrame:
    """U6 for filling: (term_id, n_fillings, status) of the run of every template, known before it is made.

    ``error``: the template isn't accepted by the type check; ``timeout``: it has more than
    ``budget`` fillings, the limit of work (a clock's limit, but the same on every machine);
    otherwise ``ok``.
    """
    counts = filling_counts(templates, symbols, multi=poly, distinct_symbols=poly, per_term=per_term)
    checked = large_join(templates.select("term_id", TM.well_typed("template").alias("typed")), counts, "term_id")
    status = F.when(~F.col("typed"), "error").when(F.col("n_fillings") > budget, "timeout").otherwise("ok")
    return checked.select("term_id", "n_fillings", status.alias("status"))


def explore(terms: DataFrame, symbols: DataFrame, budget: int, poly: bool = False, per_term: bool = False) -> DataFrame:
    """J15 under U6's guard: (term_id, status) of every term: ``true`` or ``false`` (is one of its candidates
    the original?), ``empty`` (it has none), ``timeout`` or ``error``.  Only runs within the limit are made."""
    templates = materialize(make_templates(terms, poly=poly))
    runs = cut_lineage(limited_runs(templates, symbols, budget, poly, per_term), "runs")
    made = large_join(templates, runs.where("status = 'ok' and n_fillings > 0"), "term_id", "left_semi")
    found = candidates(made, symbols, poly=poly, per_term=per_term, materialize=False)
    return rediscovered(terms, found, runs)


def failed_default(rows: DataFrame, outcomes: DataFrame, key: str = "term_id") -> DataFrame:
    """A row without an outcome gets ``failed``."""
    return large_join(rows.select(key), outcomes, key, "left").withColumn("status", F.coalesce("status", F.lit("failed")))


def outcome_tally(outcomes: DataFrame) -> DataFrame:
    """Rows per outcome status."""
    return outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("n_rows"))


def alpha_equal(left: DataFrame, right: DataFrame, on: str = "term_id") -> DataFrame:
    """Are two terms equal up to variable names, typed and untyped?  Rows are
    paired by key once; equality is on the canonical arrays (usable as a join key)."""
    canons = [TM.canon("tokens", "var", typed=typed).alias(n) for n, typed in (("typed", True), ("untyped", False))]
    pairs = large_join(left.select(on, *canons).alias("l"), right.select(on, *canons).alias("r"), on)
    return pairs.select(on, *[(F.col(f"l.{n}") == F.col(f"r.{n}")).alias(f"same_{n}") for n in ("typed", "untyped")])


def _equations(ts: Column) -> Column:
    """(place, undefined) of every ``Trueprop (_ = _)`` of a term, under premises and binders too.  ``undefined``
    is whether the right side is that constant."""
    at = F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: (
        (F.get(ts, i)["name"] == "HOL.Trueprop") & (F.get(ts, i)["kind"] == "const") & (F.get(ts, i + 1)["kind"] == "app")
        & (F.get(ts, i + 2)["kind"] == "app") & (F.get(ts, i + 3)["kind"] == "const") & (F.get(ts, i + 3)["name"] == "HOL.eq")))
    # the right side begins where the left side's subtree ends
    right = lambda i, body: TM.let(F.get(ts, _after(ts, i + 4)), body)
    return F.transform(at, lambda i: F.struct(i.alias("place"), right(i, lambda r: F.coalesce(
        (r["kind"] == "const") & (r["name"] == "HOL.undefined"), F.lit(False))).alias("undefined")))


def _after(ts: Column, i: Column) -> Column:
    """The place behind the subtree at ``i``: where its open children run out."""
    done = F.aggregate(F.slice(ts, i + 1, F.size(ts)), F.struct(F.lit(1).alias("open"), F.lit(0).alias("n")), lambda a, t: (
        F.when(a["open"] == 0, a).otherwise(F.struct(
            (a["open"] + F.when(t["kind"] == "app", 1).when(t["kind"] == "abs", 0).otherwise(-1)).alias("open"), (a["n"] + 1).alias("n")))),
        lambda a: a["n"])
    return i + done


def searchable(ts: Column, equations: bool = False) -> Column:
    """P7's shape: a Trueprop, no meta-equality, no ``_ = undefined``, a schematic variable; with ``equations``
    P8's, which asks for an equation, too.  The term is bound once: a filter is pushed below the
    expression that makes it, which would else be evaluated at every place where it stands."""
    def shape(ts):
        has = lambda n: F.exists(ts, lambda t: (t["kind"] == "const") & (t["name"] == n))
        rest = lambda es: ~F.exists(es, lambda e: e["undefined"]) & (F.size(es) > 0 if equations else F.lit(True))
        return has("HOL.Trueprop") & ~has("Pure.eq") & TM.has_vars(ts) & TM.let(_equations(ts), rest)

    return TM.let(ts, shape)


def theorem_search(terms: DataFrame, namefilter: str, equations: bool = False, cap: int | None = None) -> DataFrame:
    """P7 (P8 when ``equations``): terms with a Trueprop, no meta-equality and no
    ``_ = undefined``, name containing ``namefilter`` (and, for P7, starting with it),
    no left-out name pattern, at least one schematic variable; P8 also asks for an
    equation, under premises too.  Duplicates of a statement are removed.  O2: ``cap``
    keeps that many results in name order; by default all stay."""
    ts = F.col("tokens")
    named = F.col("name").contains(namefilter) if equations else F.col("name").startswith(namefilter)
    hits = terms.where(named & ~TM.bad_name("name") & searchable(ts, equations)).withColumn("lemma_object", TM.render(ts))
    first = hits.groupBy("lemma_object").agg(F.min("name").alias("name"))
    return first if cap is None else first.orderBy("name", "lemma_object").limit(cap)
