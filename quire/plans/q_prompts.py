"""Prompt queries (R1-R9, W2, O11) over per-order examples and conversation turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import prompts as P
from quire.functions.text import OUTPUT_MARK
from quire.plans import oracle as O
from quire.plans.driver import conversation_pairs, order_examples, table
from quire.plans.registry import register

_EX_SQL = """WITH it AS (
  SELECT l.l_orderkey, list(p.p_name ORDER BY l.l_linenumber, l.l_partkey) AS symbols, list(p.p_type ORDER BY l.l_linenumber, l.l_partkey) AS ty,
         list('definition ' || replace(p.p_name, ' ', '_') || ' = ' || p.p_brand ORDER BY l.l_linenumber, l.l_partkey) AS defs
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY l.l_orderkey),
ex AS (SELECT o.o_orderkey AS row_id, coalesce(symbols, []) AS symbols,
              CASE WHEN o.o_orderkey % 3 = 0 THEN list_slice(coalesce(ty, []), 1, len(coalesce(ty, [])) - 1) ELSE coalesce(ty, []) END AS types, coalesce(defs, []) AS defs,
              '?H1 (' || o.o_orderpriority || ')' AS template, o.o_orderstatus || ' ' || o.o_orderpriority AS lemma_object,
              CASE WHEN o.o_orderkey % 2 = 0 THEN 'template' ELSE 'lemma_object' END AS output_key
       FROM orders o LEFT JOIN it ON it.l_orderkey = o.o_orderkey),
pr AS (SELECT row_id,
  '###symbols' || chr(10) || array_to_string(symbols, chr(10) || chr(10)) || chr(10) || '###defs' || chr(10) || array_to_string(defs, chr(10) || chr(10)) AS input_r1,
  '###symbols' || chr(10) || array_to_string(list_transform(list_zip(list_slice(symbols, 1, least(len(symbols), len(types))), list_slice(types, 1, least(len(symbols), len(types)))), lambda p: p[1] || ' :::: ' || p[2]), chr(10) || chr(10)) AS input_r2,
  defs, output_key, template, lemma_object FROM ex)
"""

_R_SQL = _EX_SQL + """SELECT row_id, input_r1, input_r2,
  input_r2 || chr(10) || '###defs' || chr(10) || array_to_string(defs, chr(10) || chr(10)) AS input_r3,
  chr(10) || '###output' || chr(10) || CASE output_key WHEN 'template' THEN template WHEN 'lemma_object' THEN lemma_object END || '###end' AS output
FROM pr"""


def _prompts(spark, sf):
    ex = order_examples(spark, sf)
    return P.process_dataset(ex).select(
        "row_id", P.prompt_symbols_defs().alias("input_r1"), P.prompt_types_no_defs().alias("input_r2"),
        P.prompt_types_defs().alias("input_r3"), "output")


@register("r1_render_prompts", _R_SQL)
def r1_render_prompts(spark, sf):
    """R1-R5 (+ O11 zip): the three input renderers and the dynamic output."""
    return _prompts(spark, sf)


_W2_SQL = _EX_SQL + f"""
, tk AS (SELECT row_id, {O.usplit_ws('input_r1')} AS toks FROM pr),
b AS (SELECT row_id, len(toks) AS n, row_id // 16 AS batch, toks FROM tk),
m AS (SELECT *, CAST(ceil(max(n) OVER (PARTITION BY batch) / 8) * 8 AS INTEGER) AS pad_len FROM b)
SELECT row_id, CAST(batch AS BIGINT) AS batch, pad_len, CAST(pad_len - n AS INTEGER) AS n_pad,
       array_to_string(list_transform(range(1, pad_len - n + 1), lambda i: '<pad>') || toks, ' ') AS padded FROM m"""


@register("w2_batch_pad", _W2_SQL)
def w2_batch_pad(spark, sf):
    """Batches of 16 consecutive prompts left-padded to the batch's longest, rounded up to 8."""
    ex = _prompts(spark, sf).select("row_id", P.whitespace_tokens("input_r1").alias("ids"))
    b = P.batch_pad(ex, "ids", pad="<pad>")
    return b.select("row_id", F.col("batch").cast("long").alias("batch"), "pad_len",
                    (F.col("pad_len") - F.size("ids")).alias("n_pad"), F.array_join("padded", " ").alias("padded"))


_R6_SQL = f"""SELECT conv_id, turn, CAST(len({O.usplit_ws('text')}) AS INTEGER) AS n_tokens,
  array_to_string(list_slice({O.usplit_ws('text')}, 1, 824), ' ') || chr(10) || '###output' || chr(10) AS prompt
FROM conversations"""


@register("r6_truncate_prompts", _R6_SQL)
def r6_truncate_prompts(spark, sf):
    """Every turn cut to its first 824 tokens, with the output mark appended."""
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.size(P.whitespace_tokens("text")).alias("n_tokens"),
                    P.prepare_prompt("text", 824).alias("prompt"))


_PAIRS_SQL = """WITH u AS (SELECT conv_id, turn, text AS prompt FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, text AS reply FROM conversations WHERE role = 'assistant'),
pr AS (SELECT u.conv_id, u.turn, prompt, reply FROM u JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn)
"""
_MAXLEN = 128
_R7_SQL = _PAIRS_SQL + f"""
, t AS (SELECT conv_id, turn, {O.usplit_ws('prompt')} AS ta, {O.usplit_ws('reply')} AS tb FROM pr),
s AS (SELECT *, len(ta) AS la, len(tb) AS lb FROM t),
f AS (SELECT *, CASE WHEN la + lb > {_MAXLEN} THEN least(lb, greatest({_MAXLEN} - la, {_MAXLEN // 2})) ELSE lb END AS fb FROM s)
SELECT conv_id, turn, CAST(CASE WHEN la + lb > {_MAXLEN} THEN {_MAXLEN} - fb ELSE la END AS INTEGER) AS n_input,
       CAST(fb AS INTEGER) AS n_output,
       array_to_string(list_slice(ta, 1, CASE WHEN la + lb > {_MAXLEN} THEN {_MAXLEN} - fb ELSE la END), ' ') AS input_text,
       array_to_string(list_slice(tb, 1, fb), ' ') AS output_text FROM f"""


@register("r7_tokenize_pair", _R7_SQL)
def r7_tokenize_pair(spark, sf):
    """(prompt, reply) token pairs cut longest-first to 128 tokens."""
    t = conversation_pairs(spark, sf).select("conv_id", "turn", P.tokenize_pair("prompt", "reply", _MAXLEN).alias("t"))
    return t.select("conv_id", "turn", F.size("t.input_tokens").alias("n_input"), F.size("t.output_tokens").alias("n_output"),
                    F.array_join("t.input_tokens", " ").alias("input_text"), F.array_join("t.output_tokens", " ").alias("output_text"))


_R8_SQL = _PAIRS_SQL + f"""
, t AS (SELECT conv_id, turn, {O.usplit_ws("prompt || chr(10) || '###output' || chr(10) || reply")} AS toks FROM pr),
m AS (SELECT conv_id, turn, toks, list_max(list_filter(range(1, len(toks) + 1), lambda i: toks[i] = '###output')) AS mend FROM t)
SELECT conv_id, turn, CAST(len(toks) AS INTEGER) AS n_tokens,
       CAST(CASE WHEN mend IS NULL THEN 0 ELSE len(toks) - mend END AS INTEGER) AS n_learn,
       array_to_string(list_transform(toks, lambda x, i: CASE WHEN mend IS NULL OR i <= mend THEN '-' ELSE x END), ' ') AS labels FROM m"""


@register("r8_completion_mask", _R8_SQL)
def r8_completion_mask(spark, sf):
    """Labels learn only from tokens after the last output mark (masked -> NULL, shown as ``-``)."""
    pr = conversation_pairs(spark, sf)
    toks = P.whitespace_tokens(F.concat("prompt", F.lit(OUTPUT_MARK), "reply"))
    t = pr.select("conv_id", "turn", toks.alias("toks"))
    back = F.array_position(F.reverse("toks"), "###output")
    mend = F.when(back > 0, F.size("toks") + 1 - back).cast("int")
    lab = t.select("conv_id", "turn", "toks", P.completion_mask("toks", mend, F.lit(None).cast("string")).alias("labels"))
    learned = F.filter("labels", lambda x: x.isNotNull())
    return lab.select("conv_id", "turn", F.size("toks").alias("n_tokens"), F.size(learned).alias("n_learn"),
                      F.array_join("labels", " ", "-").alias("labels"))


_R9_SQL = _PAIRS_SQL + f"""
, t AS (SELECT conv_id, turn, {O.usplit_ws('prompt')} AS ti, {O.usplit_ws('reply')} AS tr FROM pr)
SELECT conv_id, turn, CAST(len(ti || tr) AS INTEGER) AS n_generated, CAST(len(tr) AS INTEGER) AS n_new,
       array_to_string(list_slice(ti || tr, len(ti) + 1, len(ti || tr)), ' ') AS new_text FROM t"""


@register("r9_strip_prompt", _R9_SQL)
def r9_strip_prompt(spark, sf):
    """Generated tokens (prompt + reply) with the prompt tokens removed."""
    pr = conversation_pairs(spark, sf)
    t = pr.select("conv_id", "turn", P.whitespace_tokens("prompt").alias("ti"),
                  F.concat(P.whitespace_tokens("prompt"), P.whitespace_tokens("reply")).alias("out"))
    s = P.strip_prompt("out", "ti")
    return t.select("conv_id", "turn", F.size("out").alias("n_generated"), F.size(s).alias("n_new"),
                    F.array_join(s, " ").alias("new_text"))
