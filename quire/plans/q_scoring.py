"""Scoring queries (E1-E12, A5-A7, A13, J8) over examples and predictions from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import scoring as S
from quire.plans import oracle as O
from quire.plans.driver import PREDICTION_OFFSETS, part_examples, part_predictions
from quire.plans.registry import register
from quire.session import large_join

_CTE = f"WITH {O.part_examples_cte()}, {O.part_predictions_cte('template')}"
_CTE_LEMMA = f"WITH {O.part_examples_cte()}, {O.part_predictions_cte('lemma')}"


# The strategies that the stand-in predictions have.
USED = ["greedy", "beam-search"]
_EVERY = "(SELECT * FROM ex, (VALUES ('greedy'), ('beam-search')) w(strategy)) ex"


def _template_scores(spark, sf):
    return S.evaluate(part_examples(spark, sf), part_predictions(spark, sf, "template"), "template", strategies=USED)


_E8_SQL = f"""{_CTE}
SELECT ex.row_id, ex.strategy,
       array_to_string(list_transform(pred.candidates, lambda c: {O.clean_term('c')}), ' | ') AS cleaned_text,
       {O.clean_term('ex.template')} AS reference,
       CAST(list_min(list_transform(pred.candidates, lambda c: levenshtein({O.clean_term('c')}, {O.clean_term('ex.template')}))) AS INTEGER) AS distance,
       coalesce(list_min(list_transform(pred.candidates, lambda c: levenshtein({O.clean_term('c')}, {O.clean_term('ex.template')}))) = 0, false) AS success
FROM {_EVERY} LEFT JOIN pred ON pred.row_id = ex.row_id AND pred.strategy = ex.strategy"""


@register("e8_template_eval", _E8_SQL)
def e8_template_eval(spark, sf):
    """E2 + E5 + A5 + J8: template predictions scored per row and strategy."""
    return _template_scores(spark, sf).select(
        "row_id", "strategy", F.array_join("cleaned", " | ").alias("cleaned_text"), "reference", "distance", "success"
    )


_E9_SQL = f"""{_CTE_LEMMA}
SELECT ex.row_id, ex.strategy,
       array_to_string(list_transform(pred.candidates, lambda c: {O.clean_term('c')}), ' | ') AS cleaned_text,
       {O.clean_term('ex.lemma_object')} AS reference,
       {O.normalize_vars(O.clean_term('ex.lemma_object'))} AS normalized_reference,
       CAST(list_min(list_transform(pred.candidates, lambda c: levenshtein(
            {O.clean_term(O.normalize_vars(O.clean_term('c')))},
            {O.clean_term(O.normalize_vars(O.clean_term('ex.lemma_object')))}))) AS INTEGER) AS distance
FROM {_EVERY} LEFT JOIN pred ON pred.row_id = ex.row_id AND pred.strategy = ex.strategy"""


@register("e9_lemma_eval", _E9_SQL)
def e9_lemma_eval(spark, sf):
    """E2 + E4 + E5 + A5 + J8: statement predictions scored up to variable names, every example under
    every strategy."""
    scores = S.evaluate(part_examples(spark, sf), part_predictions(spark, sf, "lemma"), "lemma_object", strategies=USED)
    return scores.select(
        "row_id", "strategy", F.array_join("cleaned", " | ").alias("cleaned_text"), "reference",
        T.normalize_vars("reference").alias("normalized_reference"), "distance",
    )


_A6_SQL = f"""WITH e8 AS ({_E8_SQL})
SELECT strategy, CAST(count_if(success) AS BIGINT) AS n_success, count(*) AS n_rows,
       round(count_if(success) * 100.0::DOUBLE / count(*), 1) AS pct_success
FROM e8 GROUP BY strategy"""


@register("a6_success_rate", _A6_SQL)
def a6_success_rate(spark, sf):
    """Successes and percentage per strategy, of all examples."""
    return S.success_rate(_template_scores(spark, sf))


_A7_ROWS_SQL = f"""WITH e8 AS ({_E8_SQL}), ex2 AS (SELECT row_id, theory_file, lemma_name FROM ({_CTE} SELECT * FROM ex))
SELECT ex2.theory_file, ex2.lemma_name, e8.row_id,
       CAST(sum(CAST(e8.success AS BIGINT)) AS BIGINT) AS success_count, bool_or(e8.success) AS any_success
FROM e8 JOIN ex2 USING (row_id) GROUP BY ex2.theory_file, ex2.lemma_name, e8.row_id"""


@register("a7_row_results", _A7_ROWS_SQL)
def a7_row_results(spark, sf):
    """A7 per row with the P4 key columns first."""
    ex = part_examples(spark, sf)
    scores = large_join(_template_scores(spark, sf), ex.select("row_id", "theory_file", "lemma_name"), "row_id")
    return S.row_results(scores, ["theory_file", "lemma_name"])


_A7_SQL = f"""WITH e8 AS ({_E8_SQL}), r AS (SELECT row_id, bool_or(success) AS any_success FROM e8 GROUP BY row_id)
SELECT CAST(count_if(any_success) AS BIGINT) AS n_any_success, count(*) AS n_rows,
       round(count_if(any_success) * 100.0::DOUBLE / count(*), 1) AS pct_any_success FROM r"""


@register("a7_any_strategy", _A7_SQL)
def a7_any_strategy(spark, sf):
    """A7 totals: rows right under any strategy."""
    return S.any_strategy_report(_template_scores(spark, sf))


_CONFIGS_SQL = f"""WITH e8 AS ({_E8_SQL}), e9 AS ({_E9_SQL}),
s AS (SELECT 'template_small' AS config, row_id, success FROM e8 UNION ALL SELECT 'lemma_object_small', row_id, coalesce(distance = 0, false) FROM e9),
p AS (SELECT config, row_id, count_if(success) AS n FROM s GROUP BY ALL UNION ALL SELECT NULL, row_id, count_if(success) FROM s GROUP BY row_id)
SELECT config, CAST(count_if(n > 0) AS BIGINT) AS n_any_success, count(*) AS n_rows, round(count_if(n > 0) * 100.0::DOUBLE / count(*), 1) AS pct_any_success, CAST(sum(n) AS BIGINT) AS success_count
FROM p GROUP BY config"""


@register("a7_all_configs", _CONFIGS_SQL)
def a7_all_configs(spark, sf):
    """A7 over training configs: per config and over all configs and strategies, the rows that any of them
    gets right; a config that can't be evaluated and one without predictions are skipped."""
    ex = part_examples(spark, sf)
    tagged = [part_predictions(spark, sf, task).withColumn("config", F.lit(c)) for task, c in (("template", "template_small"), ("lemma", "lemma_object_small"), ("template", "other"))]
    preds = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    return S.config_report(S.evaluate_configs(ex, preds, ["template_small", "lemma_object_small", "other", "template_large"]))


_J8_SQL = f"""{_CTE}, w AS (SELECT row_id, strategy FROM {_EVERY}),
given AS (SELECT DISTINCT p_partkey - off AS row_id, strategy FROM part, (VALUES {", ".join(f"('{s}', {o})" for s, _, o in PREDICTION_OFFSETS)}) o(strategy, off))
SELECT coalesce(g.strategy, w.strategy) AS strategy, count(w.row_id) AS n_examples,
       CAST(count_if(g.row_id IS NULL) AS BIGINT) AS n_missing, CAST(count_if(w.row_id IS NULL) AS BIGINT) AS n_extra
FROM w FULL JOIN given g ON g.row_id = w.row_id AND g.strategy = w.strategy GROUP BY 1"""


@register("j8_alignment", _J8_SQL)
def j8_alignment(spark, sf):
    """J8's count check: the last example has no next part to predict it, and the parts at either
    end predict rows that are no example."""
    return S.alignment_report(part_examples(spark, sf), part_predictions(spark, sf, "template", known_only=False), USED)


_P13_SQL = f"""WITH e8 AS ({_E8_SQL}) SELECT strategy, CAST(count_if(success) AS BIGINT) AS n_success, count(*) AS n_rows,
  round(count_if(success) * 100.0::DOUBLE / count(*), 1) AS pct_success FROM e8 WHERE row_id >= 100 GROUP BY strategy"""


@register("p13_evaluate_skipped", _P13_SQL)
def p13_evaluate_skipped(spark, sf):
    """P13 + E8 + A6: an evaluation whose config skips the first 100 examples (the feature)."""
    scores = S.evaluate(part_examples(spark, sf), part_predictions(spark, sf, "template"), "template", "hol-full", USED, skip=100)
    return S.success_rate(scores)


def _cut(preds):
    return preds.withColumn("candidates", F.transform("candidates", lambda c: T.cut_eos(c)))


_E10_SQL = f"""WITH {O.part_examples_cte()}, {O.part_predictions_cte('template', 'rawpred')},
pred AS (SELECT row_id, strategy, list_transform(candidates, lambda c: split_part(c, '###end', 1)) AS candidates FROM rawpred),
j AS (SELECT ex.row_id, ex.template AS ref, a.candidates AS ca, b.candidates AS cb FROM ex
      LEFT JOIN (SELECT * FROM pred WHERE strategy = 'greedy') a USING (row_id)
      LEFT JOIN (SELECT * FROM pred WHERE strategy = 'beam-search') b USING (row_id)),
d AS (SELECT row_id,
      list_transform(ca, lambda p: CAST(levenshtein(p, ref) AS INTEGER)) AS la,
      list_transform(cb, lambda p: CAST(levenshtein(p, ref) AS INTEGER)) AS lb,
      list_transform(ca, lambda p: {O.hamming('p', 'ref')}) AS ha,
      list_transform(cb, lambda p: {O.hamming('p', 'ref')}) AS hb,
      list_transform(ca, lambda p: {O.jaccard('p', 'ref')}) AS ja,
      list_transform(cb, lambda p: {O.jaccard('p', 'ref')}) AS jb FROM j)
SELECT row_id,
       array_to_string(la, ',') AS greedy_levenshtein_list,
       array_to_string(lb, ',') AS beam_search_levenshtein_list,
       array_to_string(ha, ',') AS greedy_hamming_list, array_to_string(hb, ',') AS beam_search_hamming_list,
       array_to_string(list_transform(ja, lambda x: CAST(floor(x * 1000000) AS BIGINT)), ',') AS greedy_jaccard_ppm,
       array_to_string(list_transform(jb, lambda x: CAST(floor(x * 1000000) AS BIGINT)), ',') AS beam_search_jaccard_ppm,
       least(list_min(la), list_min(lb)) AS min_levenshtein,
       CAST(least(list_min(ha), list_min(hb)) AS INTEGER) AS min_hamming,
       greatest(list_max(ja), list_max(jb)) AS max_jaccard,
       array_to_string(least(la, lb), ',') AS min_levenshtein_list,
       coalesce(list_contains(la, 0), false) OR coalesce(list_contains(lb, 0), false) AS any_success
FROM d"""


@register("e10_best_of_two", _E10_SQL)
def e10_best_of_two(spark, sf):
    """Greedy against beam search with three distances."""
    ex = part_examples(spark, sf)
    preds = _cut(part_predictions(spark, sf, "template"))
    out = S.compare_two(ex, preds, "greedy", "beam-search")
    as_text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select(
        "row_id",
        as_text("greedy_levenshtein_list").alias("greedy_levenshtein_list"),
        as_text("beam_search_levenshtein_list").alias("beam_search_levenshtein_list"),
        as_text("greedy_hamming_list").alias("greedy_hamming_list"), as_text("beam_search_hamming_list").alias("beam_search_hamming_list"),
        *[as_text(F.transform(f"{s}_jaccard_list", lambda x: F.floor(x * 1000000))).alias(f"{s}_jaccard_ppm") for s in ("greedy", "beam_search")],
        "min_levenshtein", "min_hamming", "max_jaccard",
        as_text("min_levenshtein_list").alias("min_levenshtein_list"),
        "any_success",
    )


_E3_SQL = f"""WITH {O.part_predictions_cte('template', 'pred')}
SELECT row_id, strategy, CAST(s.slot AS INTEGER) AS slot,
       {O.clean_term("split_part(s.c || chr(10) || 'tail', chr(10), 1)")} AS cleaned,
       CAST(length(split_part(s.c, '###end', 1)) AS INTEGER) AS n_chars
FROM pred, unnest(list_transform(candidates, lambda c, i: {{'c': c, 'slot': i}})) AS u(s)"""


@register("e3_clean_prediction", _E3_SQL)
def e3_clean_prediction(spark, sf):
    """E1 + E3 per candidate (posexplode keeps the slot): first line, then E2; and
    the length after the end-mark cut (the characters counted by A11)."""
    preds = part_predictions(spark, sf, "template")
    x = preds.select("row_id", "strategy", F.posexplode("candidates").alias("pos", "c"))
    return x.select(
        "row_id", "strategy", (F.col("pos") + 1).alias("slot"),
        T.clean_prediction(F.concat("c", F.lit("\ntail"))).alias("cleaned"),
        F.length(T.cut_eos("c")).alias("n_chars"),
    )


_A13_SQL = f"""{_CTE}
, s AS (SELECT row_id, strategy, list_transform(candidates, lambda c: {O.clean_term('c')} = {O.clean_term('ex.template')}) AS r
        FROM {_EVERY} LEFT JOIN pred USING (row_id, strategy))
SELECT row_id, strategy, CASE WHEN len(r) > 0 THEN list_bool_or(r) END AS row_any FROM s"""


@register("a13_row_any", _A13_SQL)
def a13_row_any(spark, sf):
    """Per (row, strategy) list of candidate outcomes -> any, NULL for none."""
    ex = part_examples(spark, sf)
    j = S.align_predictions(ex, part_predictions(spark, sf, "template"), USED)
    r = F.transform("candidates", lambda c: T.clean_term(c) == T.clean_term("template"))
    return j.select("row_id", "strategy", S.row_any(r).alias("row_any"))


_E12_SQL = "SELECT s.strategy, s.k, count(*) AS n_rows, CAST(sum(s.k) AS BIGINT) AS n_candidates FROM part, (VALUES " + ", ".join(
    f"('{n}', {k})" for n, k in S.STRATEGIES) + ") s(strategy, k) GROUP BY s.strategy, s.k"


@register("e12_strategy_plan", _E12_SQL)
def e12_strategy_plan(spark, sf):
    """Batch work per strategy: every example times the 12 strategies (an
    explode of a fixed array, not a join) with the candidates each asks for."""
    ex = part_examples(spark, sf).select("row_id")
    plan = ex.select("row_id", F.explode(S.strategy_array()).alias("s")).select("row_id", "s.strategy", "s.k")
    return plan.groupBy("strategy", "k").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("k").alias("n_candidates"))
