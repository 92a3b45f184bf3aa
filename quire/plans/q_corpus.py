"""Corpus queries (X1-X11, P5, P6, P14, A3, A10) over theory text built from ``documents``
and paths from ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import statements as ST
from quire.plans import oracle as O
from quire.plans.driver import NESTED, document_theories, importing_theories, nested_theories, table
from quire.plans.registry import register


def _statements(spark, sf):
    return ST.split_statements(document_theories(spark, sf))


_X1_SQL = f"WITH {O.statements_cte()} SELECT theory_file, block, pos, kind, stmt FROM st"


@register("x1_split_statements", _X1_SQL)
def x1_split_statements(spark, sf):
    """Cut every theory text into command spans (posexplode keeps the order)."""
    return _statements(spark, sf).select("theory_file", "block", "pos", "kind", "stmt")


_NESTED_LINE = "CASE (k - 1) % {n} {whens} END".format(n=len(NESTED), whens=" ".join(f"WHEN {i} THEN '{a}' || l || '{b}'" for i, (a, b) in enumerate(NESTED)))
_NESTED_SQL = f"""WITH thy AS (SELECT source || '/T' || CAST(doc_id AS VARCHAR) AS theory_file,
    array_to_string(list_transform(string_split(text, chr(10)), lambda l, k: {_NESTED_LINE}), chr(10)) AS text FROM documents),
{O.spans_cte('thy', ['theory_file'])} SELECT theory_file, pos, kind, stmt FROM st"""


@register("x1_nested_syntax", _NESTED_SQL)
def x1_nested_syntax(spark, sf):
    """X1 on text in which command words also stand at line starts inside strings, nested comments,
    cartouches and verbatim text, where they don't cut."""
    return ST.split_statements(nested_theories(spark, sf)).select("theory_file", "pos", "kind", "stmt")


_OWN_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(nullif(lower(regexp_extract(text, '[A-Za-z]+')), ''), 'empty') || '_cmd' AS w FROM documents),
j AS (SELECT d.doc_id, d.source, d.text, own.w AS own, coalesce(up.w, 'none_cmd') AS up, coalesce(nx.w, 'none_cmd') AS nx FROM documents d JOIN w own USING (doc_id)
      LEFT JOIN w up ON up.doc_id = d.doc_id // 3 LEFT JOIN w nx ON nx.doc_id = d.doc_id + 1),
known(doc_id, command) AS (SELECT doc_id, w FROM w UNION SELECT j.doc_id, known.command FROM known JOIN j ON j.doc_id // 3 = known.doc_id),
own AS (SELECT doc_id, list(command) AS own FROM known GROUP BY doc_id),
thy AS (SELECT source || '/T' || CAST(doc_id AS VARCHAR) AS theory_file, own.own,
    '(* header *)' || chr(10) || 'theory T' || CAST(doc_id AS VARCHAR) || chr(10) || '  imports Main "Lib.T' || CAST(doc_id // 3 AS VARCHAR) || '"' || chr(10)
    || '  keywords "' || j.own || '" :: thy_decl and "none_cmd" "is" and "maybe_cmd" :: quasi_command' || chr(10) || 'begin' || chr(10)
    || array_to_string(list_transform(string_split(text, chr(10)), lambda l, k: CASE (k - 1) % 4 WHEN 0 THEN 'lemma' WHEN 1 THEN j.own WHEN 2 THEN up ELSE nx END || ' ' || l), chr(10)) AS text
    FROM j JOIN own USING (doc_id)),
{O.spans_cte('thy', ['theory_file'], own='own')} SELECT theory_file, pos, kind, stmt FROM st"""


@register("x1_own_commands", _OWN_SQL)
def x1_own_commands(spark, sf):
    """X1/P5 with the commands that theories declare in their headers and pass on to those that
    import them, over any number of steps."""
    return ST.split_with_own_commands(importing_theories(spark, sf)).select("theory_file", "pos", "kind", "stmt")


_X2_SQL = f"""WITH {O.statements_cte()}, {O.last_block_cte()},
th AS (SELECT theory_file, pos, stmt, {O.theorem_name('stmt')} AS lemma_name FROM lb WHERE kind IN ('theorem', 'lemma'))
SELECT theory_file, lemma_name, arg_max(stmt, pos) AS stmt, max(pos) AS pos FROM th GROUP BY theory_file, lemma_name"""


@register("x2_theorems", _X2_SQL)
def x2_theorems(spark, sf):
    """P5 (kinds, last block per theory) + X2 (names) + A3 (last statement wins)."""
    st = ST.split_statements(ST.last_block(document_theories(spark, sf)))
    return ST.theorems(st).select("theory_file", "lemma_name", "stmt", "pos")


_X3_SQL = f"""WITH {O.statements_cte()}, {O.last_block_cte()},
d AS (SELECT theory_file, pos, stmt, {O.definition_name('stmt')} AS def_name FROM lb
      WHERE kind IN ({', '.join(f"'{k}'" for k in T.DEFINITION_KINDS)}))
SELECT CASE WHEN contains(theory_file, '/') THEN split_part(theory_file, '/', 2) ELSE theory_file END || '.' || def_name AS def_key,
       theory_file, pos, def_name, stmt AS def_stmt FROM d"""


@register("x3_definitions", _X3_SQL)
def x3_definitions(spark, sf):
    """P5 (definition kinds, last block) + X3 (names) + X6 (qualified key)."""
    st = ST.split_statements(ST.last_block(document_theories(spark, sf)))
    return ST.definitions(st).select("def_key", "theory_file", "pos", "def_name", "def_stmt")


_P5_SQL = f"""WITH {O.statements_cte()}, {O.last_block_cte(key='session')} SELECT session, block, pos, kind, stmt FROM lb"""


@register("p5_last_block", _P5_SQL)
def p5_last_block(spark, sf):
    """P5 quirk: a session's documents are blocks of one text, of which only the last stays; the
    block is found on the ids, before any text is cut."""
    t = ST.last_block(document_theories(spark, sf), key="session")
    return ST.split_statements(t).select("session", "block", "pos", "kind", "stmt")


_X4_NAME, _X4_BODY = O.split_lemma("stmt")
_X5_NAME, _X5_BODY = O.parse_generated("gen")
_X4_SQL = f"""WITH {O.statements_cte()},
t AS (SELECT theory_file, block, pos, stmt,
             CASE WHEN pos % 2 = 0 THEN replace(stmt, '"' || chr(10), '"') || '{{EOS}} tail' ELSE stmt END AS gen
      FROM st WHERE kind IN ('theorem', 'lemma'))
SELECT theory_file, block, pos, {_X4_NAME} AS name, {_X4_BODY} AS body,
       {_X5_NAME} AS gen_name, {_X5_BODY} AS gen_body FROM t"""


@register("x4_split_lemma", _X4_SQL)
def x4_split_lemma(spark, sf):
    """X4 on every theorem statement; X5 on a generated form (every other row carries
    the end mark, the rest were cut off and give NULLs)."""
    st = ST.kind_filter(_statements(spark, sf), T.THEOREM_KINDS)
    gen = F.when(F.col("pos") % 2 == 0,
                 F.concat(F.replace("stmt", F.lit('"\n'), F.lit('"')), F.lit("{EOS} tail"))).otherwise(F.col("stmt"))
    x = st.select("theory_file", "block", "pos", T.split_lemma("stmt").alias("a"), T.parse_generated(gen).alias("b"))
    return x.select("theory_file", "block", "pos", F.col("a.name").alias("name"), F.col("a.body").alias("body"),
                    F.col("b.name").alias("gen_name"), F.col("b.body").alias("gen_body"))


_P6_SQL = f"""WITH {O.statements_cte()}, {O.last_block_cte()},
th AS (SELECT theory_file, pos, stmt, {O.theorem_name('stmt')} AS lemma_name FROM lb WHERE kind IN ('theorem', 'lemma')),
x2 AS (SELECT theory_file, lemma_name, arg_max(stmt, pos) AS stmt FROM th GROUP BY theory_file, lemma_name),
q AS (SELECT theory_file, theory_file || '.' || lemma_name AS qualified_name FROM x2 WHERE lemma_name IS NOT NULL)
SELECT theory_file, qualified_name,
       split_part(reverse(split_part(reverse(qualified_name), '.', 1)), '(', 1) AS short_name
FROM q WHERE length(qualified_name) - length(replace(qualified_name, '.', '')) <= 1"""


@register("p6_drop_generated", _P6_SQL)
def p6_drop_generated(spark, sf):
    """P6 (at most one dot in the qualified name) + X7 (short name)."""
    th = ST.theorems(ST.split_statements(ST.last_block(document_theories(spark, sf)))).where(F.col("lemma_name").isNotNull())
    q = th.select("theory_file", F.concat("theory_file", F.lit("."), "lemma_name").alias("qualified_name"))
    return ST.drop_generated(q, "qualified_name").select(
        "theory_file", "qualified_name", T.short_theorem_name("qualified_name").alias("short_name"))


_A10_SQL = f"""WITH {O.statements_cte()},
runs AS (SELECT theory_file, block, count(CASE WHEN kind IN ('theorem', 'lemma') AND ({O.theorem_name('stmt')}) IS NOT NULL THEN 1 END) AS n
         FROM st GROUP BY theory_file, block)
SELECT CAST(count_if(n > 0) AS BIGINT) AS n_with_data, count(*) AS n_all, count_if(n > 0) / count(*) AS ratio FROM runs"""


@register("a10_coverage", _A10_SQL)
def a10_coverage(spark, sf):
    """A10: theory runs (documents) that yielded named theorems / all runs."""
    st = _statements(spark, sf)
    named = F.when(F.col("kind").isin(T.THEOREM_KINDS), T.theorem_name("stmt"))
    runs = st.groupBy("theory_file", "block").agg(F.count(named).alias("n"))
    return ST.coverage(runs, F.col("n") > 0)


_P14_SQL = """WITH r AS (SELECT regexp_extract(url, '://([^/?#]+)', 1) AS theory_file, page_id FROM pages)
SELECT theory_file, page_id FROM r WHERE theory_file IN (SELECT theory_file FROM r GROUP BY theory_file HAVING count(*) = 1)"""


@register("p14_single_result", _P14_SQL)
def p14_single_result(spark, sf):
    """Use a theory (a page host) only when it delivered exactly one result (page)."""
    p = table(spark, sf, "pages")
    r = p.select(F.regexp_extract("url", "://([^/?#]+)", 1).alias("theory_file"), "page_id")
    return ST.single_result_guard(r)


_PATH = "regexp_replace(url, '^[a-z]+://', '')"
_X8_SQL = f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages),
q AS (SELECT page_id, path, regexp_replace(path, '/[^/]*$', '') AS project,
             CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir,
             reverse(split_part(reverse(path), '/', 1)) AS base FROM p)
SELECT page_id, path, project, dir, base,
       concat_ws('-', 'HOL', nullif(replace(dir, '/', '-'), '')) || '.' || base AS import_name,
       regexp_replace(regexp_replace(path, '[^{O.RE_WCHARS}]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe_name,
       CASE WHEN contains(path, '/') THEN split_part(path, '/', 2) ELSE path END || '.' || base AS def_key
FROM q"""


@register("x8_paths", _X8_SQL)
def x8_paths(spark, sf):
    """X6, X8-X11 on page paths: project, dir/base, import name, safe name, def key."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return p.select(
        "page_id", "path", T.project_path("path").alias("project"), T.path_dir("path").alias("dir"),
        T.path_base("path").alias("base"), T.import_name("path").alias("import_name"),
        T.safe_name("path").alias("safe_name"), T.qualified_def_key("path", T.path_base("path")).alias("def_key"),
    )
