"""The two extraction jobs from end to end: terms to the template table, theory text to the lemma table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import terms as TM
from quire.functions import text as T
from quire.operators import extract as X
from quire.plans import oracle as O
from quire.plans.driver import document_theories, part_terms
from quire.plans.q_templates import _SEARCH_COND
from quire.plans.registry import register

# Names without the part's key: several facts of a theory may share one.
_TEMPLATES_SQL = f"""WITH {O.part_terms_cte('pt0')}, pt AS (SELECT term_id, regexp_replace(name, '_[0-9]+', '') AS name, tokens FROM pt0),
g AS (SELECT split_part(name, '.', 1) AS theory_file, {O.render('tokens')} AS lemma_object, min(name) AS lemma_name, any_value(tokens) AS tokens
      FROM pt WHERE {_SEARCH_COND} GROUP BY 1, 2),
sy AS (SELECT u.e.name AS symbol, min(u.e.type) AS type
       FROM pt, unnest(list_filter(tokens, lambda t: t.kind = 'const' AND NOT {O.keep_const('t.name')})) AS u(e) GROUP BY 1),
n AS (SELECT theory_file, lemma_name, lemma_object, {O.strip_trueprop(O.abstract('tokens'))} AS template,
             list_transform(list_filter(tokens, lambda t: t.kind = 'const' AND NOT {O.keep_const('t.name')}), lambda t: t.name) AS c FROM g),
s AS (SELECT *, list_reverse(list_filter(c, lambda e, i: list_position(c, e) = i)) AS symbols FROM n),
ty AS (SELECT theory_file, lemma_object, list(coalesce(sy.type, '?') ORDER BY x.i) AS types
       FROM s, unnest(list_transform(symbols, lambda e, i: {{'e': e, 'i': i}})) AS u(x) LEFT JOIN sy ON sy.symbol = x.e GROUP BY 1, 2)
SELECT theory_file, lemma_name, lemma_object, array_to_string(symbols, ' | ') AS symbols,
       coalesce(array_to_string(types, ' | '), '') AS types, {O.render('template')} AS template
FROM s LEFT JOIN ty USING (theory_file, lemma_object)"""


@register("extract_templates", _TEMPLATES_SQL)
def extract_templates(spark, sf):
    """P7 -> T1/T3 -> X12 -> X15: every searchable term of every theory as a template row."""
    t = part_terms(spark, sf).withColumn("name", F.regexp_replace("name", "_[0-9]+", "")).withColumn("theory_file", F.split_part("name", F.lit("."), F.lit(1)))
    consts = F.filter("tokens", lambda x: (x["kind"] == "const") & ~TM.keep_constant(x["name"]))
    types = t.select(F.explode(consts).alias("c")).groupBy(F.col("c.name").alias("symbol")).agg(F.min("c.type").alias("type"))
    out = X.template_table(t, types)
    join = lambda c: F.array_join(c, " | ")
    return out.select("theory_file", "lemma_name", "lemma_object", join("symbols").alias("symbols"),
                      join(F.transform("types", lambda x: F.coalesce(x, F.lit("?")))).alias("types"), "template")


_BODY = O.split_lemma("stmt")[1]
_DEF_KINDS = ", ".join(f"'{k}'" for k in T.DEFINITION_KINDS)
_LEMMAS_SQL = f"""WITH {O.statements_cte()}, {O.last_block_cte()},
th0 AS (SELECT theory_file, pos, stmt, {O.theorem_name('stmt')} AS name FROM lb WHERE kind IN ('theorem', 'lemma')),
th AS (SELECT theory_file, name, arg_max(stmt, pos) AS stmt FROM th0 GROUP BY theory_file, name),
d0 AS (SELECT theory_file, pos, stmt, {O.definition_name('stmt')} AS def_name FROM lb WHERE kind IN ({_DEF_KINDS})),
d AS (SELECT *, split_part(theory_file, '/', 2) || '.' || def_name AS def_key FROM d0),
b AS (SELECT theory_file, theory_file || '.' || name AS lemma_name, coalesce({_BODY}, '') AS lemma_object FROM th WHERE name IS NOT NULL),
w0 AS (SELECT theory_file, lemma_name, {O.usplit_ws('lemma_object')} AS ws FROM b),
w AS (SELECT theory_file, lemma_name, u.x.e AS word, u.x.i AS pos FROM w0,
      unnest(list_filter(list_transform(ws, lambda e, i: {{'e': e, 'i': i}}), lambda x: list_position(ws, x.e) = x.i)) AS u(x)),
sy AS (SELECT w.theory_file, w.lemma_name, list(k.def_key ORDER BY w.pos) AS symbols
       FROM w JOIN (SELECT DISTINCT theory_file, def_name, def_key FROM d) k ON k.theory_file = w.theory_file AND k.def_name = w.word GROUP BY 1, 2),
tp AS (SELECT b.theory_file, b.lemma_name, b.lemma_object, coalesce(sy.symbols, []) AS symbols
       FROM b LEFT JOIN sy ON sy.theory_file = b.theory_file AND sy.lemma_name = b.lemma_name),
tp2 AS (SELECT * FROM tp WHERE length(lemma_name) - length(replace(lemma_name, '.', '')) <= 1),
dl AS (SELECT def_key, arg_max(stmt, (theory_file, pos)) AS def_stmt FROM d WHERE def_key IS NOT NULL GROUP BY def_key),
ex AS (SELECT theory_file, lemma_name, u.x.e AS symbol, u.x.i AS spos FROM tp2, unnest(list_transform(symbols, lambda e, i: {{'e': e, 'i': i}})) AS u(x)),
kk AS (SELECT *, length(symbol) - length(replace(symbol, '.', '')) AS n, regexp_replace(symbol, '\\.[^.]*$', '') AS head FROM ex),
lk AS (SELECT kk.theory_file, kk.lemma_name, kk.spos, CASE WHEN a.def_key IS NOT NULL THEN a.def_stmt ELSE c.def_stmt END AS def
       FROM kk LEFT JOIN dl a ON a.def_key = CASE n WHEN 1 THEN symbol WHEN 2 THEN head END
               LEFT JOIN dl c ON c.def_key = CASE WHEN n = 2 AND ends_with(head, '_class') THEN left(head, length(head) - 6) END),
ud AS (SELECT theory_file, lemma_name, list(def ORDER BY spos) FILTER (WHERE def IS NOT NULL AND def <> '') AS used FROM lk GROUP BY 1, 2),
fs AS (SELECT theory_file, list_sort(list(DISTINCT s)) AS file_symbols FROM tp, unnest(symbols) AS u(s) GROUP BY 1),
ld AS (SELECT theory_file, list(stmt ORDER BY pos) AS defs FROM d GROUP BY 1)
SELECT tp2.theory_file, tp2.lemma_name, tp2.lemma_object, th.stmt AS lemma_command, array_to_string(tp2.symbols, ' | ') AS used_symbols,
       coalesce(array_to_string(list_filter(file_symbols, lambda x: NOT list_contains(tp2.symbols, x)), ' | '), '') AS local_symbols,
       array_to_string(coalesce(ld.defs, []) || coalesce(ud.used, []), ' | ') AS defs, replace(tp2.lemma_object, chr(10), ' ') AS template
FROM tp2 LEFT JOIN th ON th.theory_file = tp2.theory_file AND th.name = split_part(reverse(split_part(reverse(tp2.lemma_name), '.', 1)), '(', 1)
LEFT JOIN ud ON ud.theory_file = tp2.theory_file AND ud.lemma_name = tp2.lemma_name
LEFT JOIN fs ON fs.theory_file = tp2.theory_file LEFT JOIN ld ON ld.theory_file = tp2.theory_file"""


@register("assemble_from_text", _LEMMAS_SQL)
def assemble_from_text(spark, sf):
    """X1 -> P5/X2/A3, X3/X6 -> A2 -> J1-J5/P6/J6: theory text to the lemma table in one job."""
    t = document_theories(spark, sf)
    out = X.lemmas_from_text(t, X.templates_from_statements(t))
    join = lambda c: F.array_join(c, " | ").alias(c)
    return out.select("theory_file", "lemma_name", "lemma_object", "lemma_command", join("used_symbols"), join("local_symbols"), join("defs"), "template")
