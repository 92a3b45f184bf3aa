"""Assembly queries (J1-J6, A2, X12-X16, O4-O8) over lemmas from ``orders``/``lineitem``
and definitions from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import assemble as A
from quire.operators import statements as ST
from quire.plans import oracle as O
from quire.plans.driver import customer_runs, order_templates, order_theorems, part_definitions, part_symbol_types
from quire.plans.registry import register
from quire.session import cut_lineage


def _j(c, sep=" | "):
    return F.array_join(c, sep)


_DISTINCT_FIRST = O.let("coalesce(ss.s, [])", "s", "list_filter(s, lambda x, i: list_position(s, x) = i)")

_BASE = f"""WITH
sy AS (SELECT l_orderkey, l_linenumber,
              CASE l_linenumber % 4 WHEN 0 THEN t || '.' || b WHEN 1 THEN t || '.' || b || '.simps'
                   WHEN 2 THEN t || '.' || b || '_class.x' ELSE b END AS symbol
       FROM (SELECT l_orderkey, l_linenumber, 'Thy' || CAST(l_partkey // 4 AS VARCHAR) AS t,
                    'p' || CAST(l_partkey AS VARCHAR) AS b FROM lineitem)),
ss AS (SELECT l_orderkey, list(symbol ORDER BY l_linenumber, symbol) AS s FROM sy GROUP BY l_orderkey),
tp AS (SELECT 'Thy' || CAST(o_custkey AS VARCHAR) AS theory_file,
              'Thy' || CAST(o_custkey AS VARCHAR) || '.o' || CAST(o_orderkey AS VARCHAR) ||
              CASE WHEN o_orderkey % 7 = 0 THEN '.simps' WHEN o_orderkey % 5 = 0 THEN '(2)' ELSE '' END AS lemma_name,
              '?' || o_orderpriority || ' = ' || o_orderstatus AS lemma_object,
              {_DISTINCT_FIRST} AS symbols,
              '?H1 (' || o_orderpriority || ')' || chr(10) || '= ?H2' AS template
       FROM orders LEFT JOIN ss ON ss.l_orderkey = o_orderkey
       WHERE o_custkey IN (SELECT c_custkey FROM customer GROUP BY c_custkey HAVING sum(CASE WHEN c_custkey % 10 = 0 THEN 2 ELSE 1 END) = 1)),
tp2 AS (SELECT * FROM tp WHERE length(lemma_name) - length(replace(lemma_name, '.', '')) <= 1),
df AS (SELECT 'Thy' || CAST(p_partkey // 4 AS VARCHAR) || '.p' || CAST(p_partkey AS VARCHAR) AS def_key,
              'Thy' || CAST(p_partkey // 4 AS VARCHAR) AS theory_file, p_partkey * 2 + again AS pos,
              'p' || CAST(p_partkey AS VARCHAR) AS def_name,
              'definition p' || CAST(p_partkey AS VARCHAR) || ' where "' || p_name || CASE again WHEN 1 THEN ' again' ELSE '' END || '"' AS def_stmt
       FROM part, (VALUES (0), (1)) v(again) WHERE again = 0 OR p_partkey % 10 = 0),
dl AS (SELECT def_key, arg_max(def_stmt, pos) AS def_stmt FROM df GROUP BY def_key),
exa AS (SELECT theory_file, u.s AS symbol FROM tp, unnest(symbols) AS u(s)),
ex AS (SELECT theory_file, lemma_name, u.e.x AS symbol, u.e.i AS spos FROM tp2,
       unnest(list_transform(symbols, lambda x, i: {{'x': x, 'i': i}})) AS u(e)),
kk AS (SELECT theory_file, lemma_name, spos,
              CASE WHEN n = 1 THEN symbol WHEN n = 2 THEN head END AS key1,
              CASE WHEN n = 2 AND ends_with(head, '_class') THEN left(head, length(head) - 6) END AS key2
       FROM (SELECT *, length(symbol) - length(replace(symbol, '.', '')) AS n,
                    regexp_replace(symbol, '\\.[^.]*$', '') AS head FROM ex)),
lk AS (SELECT kk.theory_file, kk.lemma_name, kk.spos,
              CASE WHEN d1.def_key IS NOT NULL THEN d1.def_stmt ELSE d2.def_stmt END AS def
       FROM kk LEFT JOIN dl d1 ON d1.def_key = kk.key1 LEFT JOIN dl d2 ON d2.def_key = kk.key2),
ud AS (SELECT theory_file, lemma_name, list(def ORDER BY spos) FILTER (WHERE def IS NOT NULL AND def <> '') AS used_defs
       FROM lk GROUP BY theory_file, lemma_name),
fs AS (SELECT theory_file, list_sort(list(DISTINCT symbol)) AS file_symbols FROM exa GROUP BY theory_file),
ld AS (SELECT theory_file, list(def_stmt ORDER BY pos) AS local_defs FROM df GROUP BY theory_file),
th AS (SELECT 'Thy' || CAST(o_custkey AS VARCHAR) AS theory_file, 'o' || CAST(o_orderkey AS VARCHAR) AS short_name,
              'lemma o' || CAST(o_orderkey AS VARCHAR) || ': "' || o_orderpriority || '"' AS lemma_command
       FROM orders WHERE o_orderstatus = 'F'),
lem AS (SELECT tp2.theory_file, tp2.lemma_name, tp2.lemma_object, th.lemma_command, tp2.symbols AS used_symbols,
               coalesce(list_filter(fs.file_symbols, lambda x: NOT list_contains(tp2.symbols, x)), []) AS local_symbols,
               coalesce(ud.used_defs, []) AS used_defs, coalesce(ld.local_defs, []) AS local_defs,
               replace(tp2.template, chr(10), ' ') AS template
        FROM tp2
        LEFT JOIN th ON th.theory_file = tp2.theory_file
              AND th.short_name = split_part(reverse(split_part(reverse(tp2.lemma_name), '.', 1)), '(', 1)
        LEFT JOIN ud ON ud.theory_file = tp2.theory_file AND ud.lemma_name = tp2.lemma_name
        LEFT JOIN fs ON fs.theory_file = tp2.theory_file
        LEFT JOIN ld ON ld.theory_file = tp2.theory_file)
"""

_J6_SQL = _BASE + """SELECT theory_file, lemma_name, lemma_object, lemma_command,
       array_to_string(used_symbols, ' | ') AS used_symbols, array_to_string(local_symbols, ' | ') AS local_symbols,
       array_to_string(used_defs, ' | ') AS used_defs, array_to_string(local_defs, ' | ') AS local_defs,
       array_to_string(local_defs || used_defs, ' | ') AS defs, template FROM lem"""


def _lemmas(spark, sf):
    return A.assemble_lemmas(order_templates(spark, sf), order_theorems(spark, sf), part_definitions(spark, sf), customer_runs(spark, sf))


def _templates(spark, sf):
    """The templates of theories with exactly one result."""
    one = ST.single_result_guard(customer_runs(spark, sf))
    return order_templates(spark, sf).join(one, "theory_file", "left_semi").withColumnRenamed("symbols", "used_symbols")


@register("j6_assemble_lemmas", _J6_SQL)
def j6_assemble_lemmas(spark, sf):
    """The full assembly (P6, J1-J5, A2, O4, O6, X7, X16) into the lemmas table."""
    l = _lemmas(spark, sf)
    return l.select("theory_file", "lemma_name", "lemma_object", "lemma_command",
                    *[_j(c).alias(c) for c in ("used_symbols", "local_symbols", "used_defs", "local_defs", "defs")],
                    "template")


# Entries of a chunk in the queries below; the stand-in's files are small.
CHUNK = 3

_J6R_SQL = _BASE + """SELECT theory_file, lemma_name, lemma_object, lemma_command, array_to_string(used_symbols, ' | ') AS used_symbols,
       CAST(len(local_symbols) AS BIGINT) AS n_local_symbols, array_to_string(used_defs, ' | ') AS used_defs, CAST(len(local_defs) AS BIGINT) AS n_local_defs, template FROM lem"""


@register("j6_lemma_references", _J6R_SQL)
def j6_lemma_references(spark, sf):
    """J6 with its file's lists stored once: every lemma with their sizes, referring to the chunks by file."""
    l, _, _ = A.lemma_references(order_templates(spark, sf), order_theorems(spark, sf), part_definitions(spark, sf), customer_runs(spark, sf), CHUNK)
    return l.select("theory_file", "lemma_name", "lemma_object", "lemma_command", _j("used_symbols").alias("used_symbols"), "n_local_symbols",
                    _j("used_defs").alias("used_defs"), "n_local_defs", "template")


_J5C_SQL = _BASE + f""", c AS (SELECT theory_file, pos // {CHUNK} AS chunk, count(*) AS n, string_agg(def_stmt, ' | ' ORDER BY pos) AS local_defs FROM df GROUP BY 1, 2)
SELECT theory_file, chunk, CAST(coalesce(sum(n) OVER (PARTITION BY theory_file ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first, local_defs FROM c"""


@register("j5_definition_chunks", _J5C_SQL)
def j5_definition_chunks(spark, sf):
    """Every file's definitions in chunks with offsets, a row a chunk."""
    return A.definition_chunks(part_definitions(spark, sf), CHUNK).select("theory_file", "chunk", "first", _j("local_defs").alias("local_defs"))


_J4C_SQL = _BASE + f""", d AS (SELECT DISTINCT theory_file, symbol FROM exa), n AS (SELECT theory_file, CAST(ceil(count(*) / {CHUNK}) AS BIGINT) AS pieces FROM d GROUP BY 1)
SELECT theory_file, CAST('0x' || substr(md5(symbol), 1, 8) AS BIGINT) % pieces AS chunk, string_agg(symbol, ' | ' ORDER BY symbol) AS file_symbols
FROM d JOIN n USING (theory_file) GROUP BY 1, 2"""


@register("j4_symbol_chunks", _J4C_SQL)
def j4_symbol_chunks(spark, sf):
    """Every file's symbols in chunks, a row a chunk."""
    lists = cut_lineage(_templates(spark, sf).select("theory_file", "used_symbols"), "symbol-lists")
    return A.symbol_chunks(lists, CHUNK).select("theory_file", "chunk", _j("file_symbols").alias("file_symbols"))


_J2_SQL = _BASE + "SELECT theory_file, lemma_name, array_to_string(used_defs, ' | ') AS used_defs, CAST(len(used_defs) AS INTEGER) AS n_defs FROM lem"


@register("j2_dependent_definitions", _J2_SQL)
def j2_dependent_definitions(spark, sf):
    """J1 + J2: definitions of every lemma's symbols (one-dot, two-dot and _class keys)."""
    t = ST.drop_generated(_templates(spark, sf))
    d = A.dependent_definitions(t, part_definitions(spark, sf), ["theory_file", "lemma_name"])
    return d.select("theory_file", "lemma_name", _j("used_defs").alias("used_defs"), F.size("used_defs").alias("n_defs"))


_A2_SQL = _BASE + "SELECT theory_file, array_to_string(file_symbols, ' | ') AS file_symbols FROM fs"


@register("a2_local_symbol_sets", _A2_SQL)
def a2_local_symbol_sets(spark, sf):
    """P14 + A2: sorted union of the symbols of all lemmas of a file (O5 across rows)."""
    return A.local_symbol_sets(_templates(spark, sf)).select("theory_file", _j("file_symbols").alias("file_symbols"))


_J5_SQL = _BASE + "SELECT theory_file, array_to_string(local_defs, ' | ') AS local_defs, CAST(len(local_defs) AS INTEGER) AS n_defs FROM ld"


@register("j5_local_definitions", _J5_SQL)
def j5_local_definitions(spark, sf):
    """Every file's definition texts in file order."""
    ld = A.local_definitions(part_definitions(spark, sf))
    return ld.select("theory_file", _j("local_defs").alias("local_defs"), F.size("local_defs").alias("n_defs"))


_X15_SQL = _BASE + """, ty AS (SELECT 'Thy' || CAST(p_partkey // 4 AS VARCHAR) || '.p' || CAST(p_partkey AS VARCHAR) AS symbol,
                           p_type AS type FROM part),
et AS (SELECT ex.theory_file, ex.lemma_name, list(coalesce(ty.type, '?') ORDER BY ex.spos) AS types
       FROM ex LEFT JOIN ty ON ty.symbol = ex.symbol GROUP BY ex.theory_file, ex.lemma_name)
SELECT tp2.theory_file, tp2.lemma_name, coalesce(array_to_string(types, ' | '), '') AS types
FROM tp2 LEFT JOIN et ON et.theory_file = tp2.theory_file AND et.lemma_name = tp2.lemma_name"""


@register("x15_symbol_types", _X15_SQL)
def x15_symbol_types(spark, sf):
    """Types aligned with every lemma's symbol list (unknown -> '?')."""
    t = ST.drop_generated(_templates(spark, sf))
    ty = A.symbol_types(t, part_symbol_types(spark, sf), ["theory_file", "lemma_name"])
    return ty.select("theory_file", "lemma_name",
                     _j(F.transform("types", lambda x: F.coalesce(x, F.lit("?")))).alias("types"))
