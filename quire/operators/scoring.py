"""Scoring jobs: predictions against references, per strategy and per row.

Tables
------
examples     (row_id long, ..., template string, lemma_object string)
predictions  (row_id long, strategy string, candidates array<string>)
scores       (row_id long, strategy string, cleaned array<string>, reference string,
              distance int, success boolean)

Predictions are aligned with examples by ``row_id`` (J8), never by position.  The
join is an equi-join on a unique key, always sort-merge (``large_join``); the per-row
report then reuses the join's hash partitioning on ``row_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import distance as D
from quire.functions import text as T
from quire.session import large_join

# The generation strategies and how many candidates each returns.
STRATEGIES = [
    ("greedy", 1),
    ("beam-search", 4),
    ("temperature-0.1", 4), ("temperature-0.2", 4), ("temperature-0.3", 4), ("temperature-0.4", 4),
    ("temperature-0.5", 4), ("temperature-0.6", 4), ("temperature-0.7", 4), ("temperature-0.8", 4),
    ("temperature-0.9", 4), ("temperature-1.0", 4),
]


def strategy_table(spark) -> DataFrame:
    """The strategy table (12 rows: name, k, sampling temperature or NULL)."""
    rows = []
    for name, k in STRATEGIES:
        temp = float(name.split("-", 1)[1]) if name.startswith("temperature-") else None
        rows.append((name, k, temp))
    return spark.createDataFrame(rows, "strategy string, k int, temperature double")


def strategy_array() -> "F.Column":
    """E12 as a literal array of (strategy, k) structs, for an explode per row."""
    return F.array(*[F.struct(F.lit(n).alias("strategy"), F.lit(k).alias("k")) for n, k in STRATEGIES])


def align_predictions(examples: DataFrame, predictions: DataFrame, strategies: list[str] | None = None) -> DataFrame:
    """Pair every prediction row with its example by ``row_id``.  With ``strategies`` there
    is a row for each example and strategy, with NULL candidates where none were predicted."""
    if strategies is None:
        return large_join(examples, predictions, "row_id")
    wanted = examples.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in strategies])))
    return large_join(wanted, predictions, ["row_id", "strategy"], "left")


def alignment_report(examples: DataFrame, predictions: DataFrame, strategies: list[str]) -> DataFrame:
    """J8's count check: per strategy the examples, those without predictions, and the predictions
    that name no example."""
    both = examples.select("row_id", F.lit(True).alias("ex")).withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in strategies])))
    j = large_join(both, predictions.select("row_id", "strategy", F.lit(True).alias("pr")), ["row_id", "strategy"], "full")
    return j.groupBy("strategy").agg(F.count("ex").alias("n_examples"), F.count_if(F.col("pr").isNull()).alias("n_missing"),
                                     F.count_if(F.col("ex").isNull()).alias("n_extra"))


def template_eval(examples: DataFrame, predictions: DataFrame, reference_col: str = "template",
                  strategies: list[str] | None = None) -> DataFrame:
    """Clean both sides (E2), smallest edit distance over the k candidates (A5),
    success when it is 0.  A missing prediction (see ``align_predictions``) has no distance
    and no success."""
    joined = align_predictions(examples.select("row_id", reference_col), predictions, strategies)
    cleaned = F.transform("candidates", T.clean_term)
    ref = T.clean_term(reference_col)
    return (
        joined.select("row_id", "strategy", cleaned.alias("cleaned"), ref.alias("reference"))
        .withColumn("distance", D.best_distance("cleaned", "reference"))
        .withColumn("success", F.coalesce(F.col("distance") == 0, F.lit(False)))
    )


def lemma_eval(examples: DataFrame, predictions: DataFrame, reference_col: str = "lemma_object",
               strategies: list[str] | None = None) -> DataFrame:
    """E2 then E4 on both sides and E2 again, smallest edit distance, success at 0.
    ``cleaned`` keeps the un-normalised cleaned candidates."""
    joined = align_predictions(examples.select("row_id", reference_col), predictions, strategies)
    cleaned = F.transform("candidates", T.clean_term)
    ref = T.clean_term(reference_col)
    scored = joined.select("row_id", "strategy", cleaned.alias("cleaned"), ref.alias("reference"))
    norm_ref = T.clean_term(T.normalize_vars("reference"))
    dist = D.best_distance("cleaned", norm_ref, lambda p, r: F.levenshtein(T.clean_term(T.normalize_vars(p)), r))
    return scored.withColumn("distance", dist).withColumn("success", F.coalesce(F.col("distance") == 0, F.lit(False)))


def evaluate(examples: DataFrame, predictions: DataFrame, train_config: str, eval_config: str = "",
             strategies: list[str] | None = None, skip: int = 0) -> DataFrame | None:
    """Scores over a list of strategies: E8 or E9 by the training config (``template`` first,
    then ``lemma_object``; any other config gives no scores, None), after P13's skip of the
    first ``skip`` examples for the evaluation configs that ask for it."""
    from quire.operators import rows as R

    examples = R.skip_prefix(examples, skip, when_config=eval_config) if skip else examples
    if "template" in train_config:
        return template_eval(examples, predictions, strategies=strategies)
    if "lemma_object" in train_config:
        return lemma_eval(examples, predictions, strategies=strategies)
    return None


def evaluate_configs(examples: DataFrame, predictions: DataFrame, configs: list[str]) -> DataFrame:
    """Scores (config, row_id, strategy, success) over several training configs.

    ``predictions`` has a ``config`` column.  Each config is evaluated by its kind (E8 or E9), every example
    under every strategy that has predictions for it; a strategy without any, and a config that
    neither kind fits, are skipped, as a failing one is.  Which those are is one small row a config.
    """
    there = predictions.where(F.col("config").isin(configs)).groupBy("config").agg(F.sort_array(F.collect_set("strategy")).alias("s")).collect()
    scores = None
    for config, strategies in sorted((r["config"], r["s"]) for r in there):
        own = evaluate(examples, predictions.where(F.col("config") == config).drop("config"), config, strategies=strategies)
        if own is not None:
            own = own.select(F.lit(config).alias("config"), "row_id", "strategy", "success")
            scores = own if scores is None else scores.unionByName(own)
    empty = examples.sparkSession.createDataFrame([], "config string, row_id long, strategy string, success boolean")
    return empty if scores is None else scores


def config_report(scores: DataFrame) -> DataFrame:
    """Successes per config and over all (``config`` NULL): the rows right under any strategy, all rows, the
    percentage, and the successes counted over strategies."""
    per = scores.groupBy("config", "row_id").agg(F.count_if("success").alias("n"))
    rows = per.unionByName(per.groupBy("row_id").agg(F.sum("n").alias("n")).withColumn("config", F.lit(None).cast("string")))
    return rows.groupBy("config").agg(F.count_if(F.col("n") > 0).alias("n_any_success"), F.count(F.lit(1)).alias("n_rows"),
                                      F.round(F.count_if(F.col("n") > 0) * 100.0 / F.count(F.lit(1)), 1).alias("pct_any_success"), F.sum("n").alias("success_count"))


def success_rate(scores: DataFrame) -> DataFrame:
    """Correct rows and percentage (one decimal) per strategy, of all rows that ``scores`` has
    for it; rows without a prediction are there when the scores were made for a list of
    strategies."""
    return scores.groupBy("strategy").agg(
        F.count_if("success").alias("n_success"),
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.count_if("success") * 100.0 / F.count(F.lit(1)), 1).alias("pct_success"),
    )


def row_results(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A7 (per row): number of successful strategies and whether any succeeded.
    ``keys`` are extra per-row columns carried along (P4 puts them first)."""
    keys = keys or []
    out = scores.groupBy("row_id", *keys).agg(
        F.sum(F.col("success").cast("long")).alias("success_count"),
        F.bool_or("success").alias("any_success"),
    )
    return out.select(*keys, "row_id", "success_count", "any_success")


def any_strategy_report(scores: DataFrame) -> DataFrame:
    """A7 (total): rows with any success, all rows, percentage."""
    per_row = row_results(scores)
    return per_row.agg(
        F.count_if("any_success").alias("n_any_success"),
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.count_if("any_success") * 100.0 / F.count(F.lit(1)), 1).alias("pct_any_success"),
    )


def row_any(results) -> "F.Column":
    """Any true in a list; an empty or missing list gives NULL; NULL elements
    count as false."""
    r = F.col(results) if isinstance(results, str) else results
    return F.when(F.size(r) > 0, F.exists(r, lambda x: F.coalesce(x, F.lit(False))))


def compare_two(examples: DataFrame, predictions: DataFrame, a: str, b: str, reference_col: str = "template") -> DataFrame:
    """E10/E11 over two strategies of the same rows.

    Per row: the distance lists of each strategy (``*_list``, in candidate order),
    scalar best values (min edit and hamming distance, max jaccard), the
    lexicographic list minimum the original computed, and whether either strategy
    has an exact match (NULL counts as false).
    """
    ref = F.col(reference_col)
    # one pass over the predictions: both strategies of a row side by side (one
    # partially aggregated group-by on row_id), then one join with the examples
    pick = lambda s: F.first(F.when(F.col("strategy") == s, F.col("candidates")), ignorenulls=True)
    both = (predictions.where(F.col("strategy").isin(a, b))
            .groupBy("row_id").agg(pick(a).alias("ca"), pick(b).alias("cb")))
    j = large_join(examples.select("row_id", reference_col), both, "row_id", "left")
    # each distance list is computed once as a column and then reused
    d = j.select(
        "row_id",
        D.distances("ca", ref).alias("lev_a"), D.distances("cb", ref).alias("lev_b"),
        D.distances("ca", ref, D.hamming).alias("ham_a"), D.distances("cb", ref, D.hamming).alias("ham_b"),
        D.distances("ca", ref, D.jaccard).alias("jac_a"), D.distances("cb", ref, D.jaccard).alias("jac_b"),
    )
    lev_a, lev_b = F.col("lev_a"), F.col("lev_b")
    return d.select(
        "row_id",
        lev_a.alias(f"{_n(a)}_levenshtein_list"),
        lev_b.alias(f"{_n(b)}_levenshtein_list"),
        *[F.col(f"{k}_{s}").alias(f"{_n(n)}_{d}_list") for k, d in (("ham", "hamming"), ("jac", "jaccard")) for s, n in (("a", a), ("b", b))],
        F.least(F.array_min(lev_a), F.array_min(lev_b)).alias("min_levenshtein"),
        F.least(F.array_min("ham_a"), F.array_min("ham_b")).alias("min_hamming"),
        F.greatest(F.array_max("jac_a"), F.array_max("jac_b")).alias("max_jaccard"),
        F.least(lev_a, lev_b).alias("min_levenshtein_list"),
        any_of_two(F.array_contains(lev_a, 0), F.array_contains(lev_b, 0)).alias("any_success"),
    )


def any_of_two(a, b) -> "F.Column":
    """Either succeeded; NULL counts as false."""
    return F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))


def _n(strategy: str) -> str:
    return strategy.replace("-", "_").replace(".", "_")
