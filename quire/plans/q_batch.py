"""Batch-work queries (U1-U7, H1, J10, A4, A9, A11, O4-O10) over conversations,
predictions, events and order examples."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.operators import batch as B
from quire.plans import oracle as O
from quire.plans.driver import order_examples, part_predictions, table
from quire.plans.registry import register
from quire.session import checkpoint_dir, delete_at_end
from quire.sources.io import ResultsCache

# The words that the model's window holds.
WINDOW = 150

_STEPS = " ".join(f"LEFT JOIN nx c{i} ON c{i}.a = {'w.words[len(w.words)]' if i == 1 else f'c{i - 1}.b'}" for i in range(1, B.CONTINUATION + 1))
_PROMPTS_SQL = f"""WITH w AS (SELECT conv_id, turn, role, {O.usplit_ws("coalesce(text, '')")} AS words FROM conversations),
pairs AS (SELECT unnest(list_transform(range(1, len(words)), lambda i: {{'a': words[i], 'b': words[i + 1]}})) AS p FROM w),
cnt AS (SELECT p.a AS a, p.b AS b, count(*) AS n FROM pairs GROUP BY ALL),
tot AS (SELECT a FROM cnt GROUP BY a ORDER BY sum(n) DESC, a LIMIT {B.VOCABULARY}),
nx AS (SELECT a, list(b ORDER BY n DESC, b)[1] AS b FROM cnt JOIN tot USING (a) GROUP BY a),
pd AS (SELECT conv_id, turn, role, CASE WHEN ok AND said <> '' THEN [said] ELSE [] END AS c, CASE WHEN ok THEN 'ok' ELSE 'error' END AS status
  FROM (SELECT w.*, len(words) BETWEEN 1 AND {WINDOW} AS ok, concat_ws(' ', {', '.join(f'c{i}.b' for i in range(1, B.CONTINUATION + 1))}) AS said FROM w {_STEPS}))
"""


def _prompts(spark, sf):
    """Every turn as a prompt; the model refuses blank ones and those longer than its window."""
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("prompt"))


def _model(spark, sf):
    """A word model trained on all turns; the factory of its predictor, called once a task."""
    model = B.train_bigrams(table(spark, sf, "conversations"))
    return lambda: B.bigram_predictor(model, window=WINDOW)


_KEY = ["conv_id", "turn"]


@register("u3_predict", _PROMPTS_SQL + "SELECT conv_id, turn, array_to_string(c, ' | ') AS candidates, status FROM pd")
def u3_predict(spark, sf):
    """U3 + U6: a trained word model over partitions (mapInPandas, its predictor made once per
    task), keyed by conversation and turn; a refused row becomes status 'error'."""
    p = B.predict(_prompts(spark, sf), _model(spark, sf), id_col=_KEY)
    return p.select(*_KEY, F.array_join("candidates", " | ").alias("candidates"), "status")


_H1_SQL = """SELECT conv_id, turn, md5(md5('conv_id') || md5(CAST(conv_id AS VARCHAR)) || md5('turn') || md5(CAST(turn AS VARCHAR))
   || md5('role') || coalesce(md5(role), md5('unknown')) || md5('text') || coalesce(md5(text), md5('unknown'))) AS fingerprint
FROM conversations"""


@register("h1_fingerprint", _H1_SQL)
def h1_fingerprint(spark, sf):
    """H1: md5 fingerprint of every turn's (conv_id, turn, role, text)."""
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", B.fingerprint("conv_id", "turn", "role", "text", df=c).alias("fingerprint"))


_H1N_SQL = """WITH t AS (SELECT conv_id, list(md5(md5('turn') || md5(CAST(turn AS VARCHAR)) || md5('said')
     || md5(md5('role') || coalesce(md5(role), md5('unknown')) || md5('words') || md5(coalesce(array_to_string(list_transform(string_split(text, ' '), lambda w: md5(w)), ''), ''))))
     ORDER BY turn) AS h, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, md5(md5('conv_id') || md5(CAST(conv_id AS VARCHAR)) || md5('turns') || md5(array_to_string(h, ''))
   || md5('sizes') || md5(md5('turns') || md5(CAST(n AS VARCHAR)) || md5('many') || md5(CASE WHEN n > 5 THEN 'True' ELSE 'False' END))) AS fingerprint FROM t"""


@register("h1_nested_fingerprint", _H1N_SQL)
def h1_nested_fingerprint(spark, sf):
    """H1 over nested values: a conversation as a struct of an array of structs (with a further struct and an
    array of words) and a map, without its ``text`` at any level."""
    said = F.struct("role", F.coalesce(F.split("text", " "), F.array().cast("array<string>")).alias("words"), "text")
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))).alias("turns"))
    n = F.size("turns")
    sizes = F.create_map(F.lit("turns"), n.cast("string"), F.lit("text"), F.lit("ignored"), F.lit("many"), F.when(n > 5, "True").otherwise("False"))
    c = c.withColumn("sizes", sizes).withColumn("text", F.lit("ignored"))
    return c.select("conv_id", B.fingerprint("conv_id", "turns", "sizes", "text", df=c, ignore=("text",)).alias("fingerprint"))


_J10_SQL = _PROMPTS_SQL + """SELECT conv_id, turn, array_to_string(c, ' | ') AS candidates,
  CASE WHEN role = 'user' THEN 'cache' ELSE 'run' END AS origin FROM pd WHERE status = 'ok'"""


@register("j10_rerun_missing", _J10_SQL)
def j10_rerun_missing(spark, sf):
    """J10 + S7: results of the users' turns are in the results cache; only the rows without a good
    result there are predicted and added, and the cache is compacted to one row a key."""
    todo = _prompts(spark, sf)
    todo = todo.withColumn("fingerprint", B.fingerprint(*_KEY, "prompt", df=todo))
    path = f"{checkpoint_dir(spark)}/results-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    key, ok, model = ["fingerprint", *_KEY], F.col("status") == "ok", _model(spark, sf)
    first = B.predict(todo.where(F.col("role") == "user"), model, id_col=key)
    cache = ResultsCache(spark, path, ", ".join(f"{c} {t}" for c, t in first.dtypes))
    cache.add(first)
    cache.add(B.predict(cache.missing(todo, ok), model, id_col=key))
    cache.compact(ok)
    origin = F.when(F.col("order") == 1, "cache").otherwise("run")
    return cache.good(ok).select(*_KEY, F.array_join("candidates", " | ").alias("candidates"), origin.alias("origin"))


_A11M_SQL = _PROMPTS_SQL + """SELECT count(*) AS n_rows, CAST(coalesce(sum(length(c[1])), 0) AS BIGINT) AS n_chars,
  CAST(coalesce(sum(len(string_split(c[1], ' '))), 0) AS BIGINT) AS n_tokens, true AS took_time FROM pd"""


@register("a11_measured_run", _A11M_SQL)
def a11_measured_run(spark, sf):
    """A11 of a real run: the predictor's rows are written, counted as they pass and timed (here only
    whether the times are positive and fit each other)."""
    path = f"{checkpoint_dir(spark)}/predictions-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    m = B.measured(B.predict(_prompts(spark, sf), _model(spark, sf), id_col=_KEY, timed=True), lambda df: df.write.parquet(path))
    fits = (F.col("wall_sec") > 0) & (F.col("task_sec") > 0) & (F.abs(F.col("chars_per_sec") * F.col("wall_sec") - F.col("n_chars")) < 1)
    return m.select("n_rows", "n_chars", "n_tokens", fits.alias("took_time"))


_A11_SQL = f"""WITH {O.part_predictions_cte('template')}
SELECT strategy, count(*) AS n_rows,
  CAST(sum(list_sum(list_transform(candidates, lambda c: length(c)))) AS BIGINT) AS n_chars,
  CAST(sum(list_sum(list_transform(candidates, lambda c: len({O.usplit_ws('c')})))) AS BIGINT) AS n_tokens
FROM pred GROUP BY strategy"""


@register("a11_throughput", _A11_SQL)
def a11_throughput(spark, sf):
    """Characters and tokens generated per strategy (the original divides by a
    wall time measured on the driver)."""
    return B.throughput(part_predictions(spark, sf, "template"))


_A9_SQL = """WITH r AS (SELECT 'run' || CAST(user_id % 2 AS VARCHAR) AS run, value > 2 AS passes_generation,
   value > 5 AS passes_syntax, value > 10 AS passes_counterexample FROM events),
l AS (SELECT run, 'passes_generation' AS stage, passes_generation AS passed FROM r
      UNION ALL SELECT run, 'passes_syntax', passes_syntax FROM r
      UNION ALL SELECT run, 'passes_counterexample', passes_counterexample FROM r)
SELECT run, stage, CAST(count_if(passed) AS BIGINT) AS n_pass, CAST(count_if(NOT passed) AS BIGINT) AS n_fail FROM l GROUP BY run, stage"""


@register("a9_stage_comparison", _A9_SQL)
def a9_stage_comparison(spark, sf):
    """Passes and failures per stage for two runs (events split by user parity)."""
    e = table(spark, sf, "events")
    r = e.select(F.concat(F.lit("run"), (F.col("user_id") % 2).cast("string")).alias("run"),
                 (F.col("value") > 2).alias("passes_generation"), (F.col("value") > 5).alias("passes_syntax"),
                 (F.col("value") > 10).alias("passes_counterexample"))
    return B.stage_comparison(r, ["passes_generation", "passes_syntax", "passes_counterexample"])


_O9_SQL = """WITH log AS (SELECT event_id AS step, value AS loss, CASE WHEN event_type = 'view' THEN value END AS eval_loss FROM events)
SELECT step, 'loss' AS variable, CASE WHEN step % 10 = 0 THEN loss END AS value FROM log
UNION ALL SELECT step, 'eval_loss', eval_loss FROM log"""


@register("o9_melt_loss", _O9_SQL)
def o9_melt_loss(spark, sf):
    """A training log (events as steps) melted to (step, variable, value)."""
    e = table(spark, sf, "events")
    log = e.select(F.col("event_id").alias("step"), F.col("value").alias("loss"),
                   F.when(F.col("event_type") == "view", F.col("value")).alias("eval_loss"))
    return B.melt_loss(log)


_A4_SQL = """SELECT conv_id, role AS k, arg_max(text, turn) AS v FROM conversations GROUP BY conv_id, role"""


@register("a4_merge_maps", _A4_SQL)
def a4_merge_maps(spark, sf):
    """A4: per conversation, merge the {role: text} maps of its turns, later wins."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.create_map("role", "text").alias("m"))
    return B.merge_maps_last_wins(c, ["conv_id"], "m", "turn").select("conv_id", "k", "v")


def _keep_first(x: str) -> str:
    return O.let(x, "l", "list_filter(l, lambda e, i: list_position(l, e) = i)")


_ARR_SQL = """WITH it AS (
  SELECT l.l_orderkey, list(p.p_name ORDER BY l.l_linenumber, l.l_partkey) AS symbols, list(p.p_type ORDER BY l.l_linenumber, l.l_partkey) AS types
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY l.l_orderkey),
al AS (SELECT o_orderkey AS l_orderkey, coalesce(symbols, []) AS symbols, coalesce(types, []) AS types FROM orders LEFT JOIN it ON it.l_orderkey = o_orderkey)
SELECT l_orderkey AS row_id,
  array_to_string(KF(symbols), ' | ') AS distinct_symbols,
  CASE WHEN list_position(symbols, symbols[len(symbols)]) > 0 THEN CAST(list_position(symbols, symbols[len(symbols)]) - 1 AS INTEGER) END AS last_index,
  array_to_string(KF(list_filter(symbols, lambda s: s <> symbols[1])), ' | ') AS except_first,
  array_to_string(KF(list_slice(symbols, 1, 2) || list_slice(symbols, -2, -1)), ' | ') AS union_ends,
  array_to_string(symbols || CASE WHEN l_orderkey % 3 = 0 THEN list_slice(types, 1, len(types) - 1) ELSE types END, ' | ') AS flattened
FROM al"""


@register("o4_array_ops", _ARR_SQL.replace("KF(symbols)", _keep_first("symbols"))
          .replace("KF(list_filter(symbols, lambda s: s <> symbols[1]))", _keep_first("list_filter(symbols, lambda s: s <> symbols[1])"))
          .replace("KF(list_slice(symbols, 1, 2) || list_slice(symbols, -2, -1))", _keep_first("list_slice(symbols, 1, 2) || list_slice(symbols, -2, -1)")))
def o4_array_ops(spark, sf):
    """O4 (set difference), O5 (set union), O6/O7 (concat/flatten), O8 (ordered
    distinct), O10 (index of) on every order's part names."""
    s, types = F.col("symbols"), F.col("types")
    return order_examples(spark, sf).select(
        "row_id",
        F.array_join(F.array_distinct(s), " | ").alias("distinct_symbols"),
        B.index_of(s, F.try_element_at(s, F.lit(-1))).cast("int").alias("last_index"),
        F.array_join(F.array_except(s, F.slice(s, 1, 1)), " | ").alias("except_first"),
        F.array_join(F.array_union(F.slice(s, 1, 2), F.slice(s, F.greatest(F.size(s) - 1, F.lit(1)), 2)), " | ").alias("union_ends"),
        F.array_join(F.flatten(F.array(s, types)), " | ").alias("flattened"),
    )


_S9_SQL = """SELECT p_partkey, concat_ws('-', split_part('hub/lemmas-' || replace(p_brand, '#', ''), '/', -1),
    'cfg' || CAST(p_size % 3 AS VARCHAR), split_part('org/' || lower(p_type), '/', -1),
    nullif(CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'v' || CAST(p_partkey % 5 AS VARCHAR) END, '')) AS run_id
FROM part"""


@register("s9_run_ids", _S9_SQL)
def s9_run_ids(spark, sf):
    """Run ids ``{dataset}-{config}-{model}[-{label}]`` (last path segment of each
    name; an empty label is left out) for model/dataset/config/label columns made
    from every part."""
    from quire.functions.text import run_id

    p = table(spark, sf, "part")
    cols = p.select(
        "p_partkey",
        F.concat(F.lit("org/"), F.lower("p_type")).alias("model"),
        F.concat(F.lit("hub/lemmas-"), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("dataset"),
        F.concat(F.lit("cfg"), (F.col("p_size") % 3).cast("string")).alias("config"),
        F.when(F.col("p_partkey") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("v"), (F.col("p_partkey") % 5).cast("string"))).alias("label"),
    )
    return cols.select("p_partkey", run_id("model", "dataset", "config", "label").alias("run_id"))


def _nfc(s):
    return s.fillna("").str.normalize("NFC")


def _add_words(pdf):
    return pdf.assign(n_words=pdf["nfc"].map(lambda t: len(set(t.split()))).astype("int64"))


_U1_SQL = f"""SELECT doc_id, nfc_normalize(text) AS nfc, CAST(len(list_distinct({O.usplit_ws('nfc_normalize(text)')})) AS BIGINT) AS n_words FROM documents"""


@register("u1_user_functions", _U1_SQL)
def u1_user_functions(spark, sf):
    """U1 (a vectorised user function per row) and U2 (a user function
    per piece of an Arrow batch) over every document's whole text: Unicode composition, which
    no built-in function does, and the distinct composed words."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    composed = B.map_rows(d, _nfc, "text", "nfc", "string")
    return B.map_batches(composed.select("doc_id", "nfc"), _add_words, "doc_id long, nfc string, n_words long")


VOCAB = 50000


def _md5_tokenizer():
    """Whitespace tokens to ids: the first 32 bits of the token's md5, modulo the
    vocabulary size (deterministic on every worker, no vocabulary file)."""
    import hashlib

    return lambda text: [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % VOCAB for t in text.split()]


_U7_SQL = f"""SELECT conv_id, turn, array_to_string(list_transform({O.usplit_ws('text')},
        lambda t: CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % {VOCAB} AS INTEGER)), ' ') AS ids FROM conversations"""


@register("u7_tokenize", _U7_SQL)
def u7_tokenize(spark, sf):
    """A pluggable tokenizer built once per worker, run as a pandas UDF over every
    turn's whole text; all ids."""
    c = table(spark, sf, "conversations")
    ids = c.select("conv_id", "turn", B.tokenizer_udf(_md5_tokenizer)("text").alias("ids"))
    return ids.select("conv_id", "turn", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))
