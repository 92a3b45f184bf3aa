"""Sources and row operators over whole tables: written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.operators import mixing as M
from quire.operators import rows as R
from quire.operators import statements as ST
from quire.plans import oracle as O
from quire.plans.driver import document_theories, part_predictions, table
from quire.plans.q_mixing import _base
from quire.plans.registry import register
from quire.session import checkpoint_dir, delete_at_end
from quire.sources import io

_BASE_SQL = """WITH base AS (
  SELECT doc_id AS row_id, source || '/T' || CAST(doc_id AS VARCHAR) AS theory_file, lang,
         CASE WHEN b < 8000 THEN 'train' WHEN b < 9000 THEN 'test' ELSE 'valid' END AS split
  FROM (SELECT *, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 10000 AS b FROM documents))
"""


def _folder(spark, name):
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    return path


@register("s1_corpus_scan", f"""WITH {O.statements_cte()} SELECT theory_file, text FROM st_thy""")
def s1_corpus_scan(spark, sf):
    """Every document's theory is written to a file of its own, and the folder is scanned."""
    root = _folder(spark, "corpus")
    io.corpus_write(document_theories(spark, sf), root)
    return io.corpus_scan(spark, root).select("theory_file", "text")


@register("s3_dataset_save", _BASE_SQL + "SELECT row_id, theory_file, CASE WHEN split = 'test' THEN 'again' ELSE lang END AS lang, split FROM base")
def s3_dataset_save(spark, sf):
    """S3 + S2: a dataset of three splits is saved, its test split is saved again, all are loaded."""
    root, base = _folder(spark, "datasets"), _base(spark, sf)
    io.dataset_save(base, root, "lemmas", "small")
    io.dataset_save(base.where("split = 'test'").withColumn("lang", F.lit("again")), root, "lemmas", "small")
    return io.dataset_load(spark, root, "lemmas", "small").select("row_id", "theory_file", "lang", "split")


@register("s2_dataset_split", _BASE_SQL + "SELECT row_id, theory_file, lang, split FROM base WHERE split = 'valid'")
def s2_dataset_split(spark, sf):
    """One split of a saved dataset (only its folder is read)."""
    root = _folder(spark, "datasets")
    io.dataset_save(_base(spark, sf), root, "lemmas", "small")
    return io.dataset_load(spark, root, "lemmas", "small", "valid").select("row_id", "theory_file", "lang", "split")


@register("s4_versioned_save", _BASE_SQL + "SELECT 'small-2024-05-06' AS label, row_id, split FROM base UNION ALL SELECT 'small', row_id, split FROM base")
def s4_versioned_save(spark, sf):
    """A dataset under its dated and its moving label."""
    root = _folder(spark, "datasets")
    io.versioned_save(_base(spark, sf), root, "lemmas", "small", today="2024-05-06")
    both = [io.dataset_load(spark, root, "lemmas", c).select(F.lit(c).alias("label"), "row_id", "split") for c in ("small-2024-05-06", "small")]
    return both[0].unionByName(both[1])


@register("s5_predictions_json", f"""WITH {O.part_predictions_cte('template')}
SELECT row_id, strategy, array_to_string(list_transform(candidates, lambda c: {O.clean_term('c')}), ' | ') AS candidates FROM pred""")
def s5_predictions_json(spark, sf):
    """S5 + S6: predictions saved as JSON lines, loaded and cleaned."""
    path = io.predictions_json_save(part_predictions(spark, sf, "template"), _folder(spark, "predictions"), debug=True)
    return io.predictions_json_load(spark, path).select("row_id", "strategy", F.array_join("candidates", " | ").alias("candidates"))


@register("p1_row_operators", """WITH c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, * FROM customer),
n AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey)
SELECT n.n_orders, c.row_id, c.c_custkey, upper(c.c_name) AS c_name FROM c JOIN n ON n.o_custkey = c.c_custkey WHERE c.row_id >= 10""")
def p1_row_operators(spark, sf):
    """P1 (map), P2 (drop), P3 (aligned column), P4 (order), P11 (not null), P13 (skip ten rows, the
    feature) on customers with a dense row id."""
    c = M.dense_index(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), ["c_custkey"], "row_id")
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    c = R.drop_columns(R.map_columns(c, {"c_name": F.upper("c_name")}), "c_acctbal")
    c = R.not_null(R.add_aligned_column(c, n, "n_orders", "c_custkey"), "n_orders")
    return R.ordered_projection(R.skip_prefix(c, 10), ["n_orders", "row_id"])


@register("p12_head", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, c_custkey FROM customer ORDER BY 1 LIMIT 100")
def p12_head(spark, sf):
    """The evaluation slice of the first 100 rows (the feature)."""
    return R.head(M.dense_index(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"], "row_id"), 100).select("row_id", "c_custkey")


@register("u4_run_extraction", f"""WITH {O.statements_cte()}, c AS (SELECT block, count(*) AS n FROM st WHERE kind = 'definition' GROUP BY block)
SELECT CAST(count(c.n) AS BIGINT) AS n_with_data, count(*) AS n_all, count(c.n) / count(*) AS ratio FROM documents LEFT JOIN c ON c.block = doc_id""")
def u4_run_extraction(spark, sf):
    """U4 + A10: a pluggable extraction run over every theory, and its coverage."""

    def definitions(theories):
        found = ST.kind_filter(ST.split_statements(theories), ["definition"]).groupBy("block").agg(F.collect_list("stmt").alias("data"))
        return theories.select("block").join(found, "block", "left")

    _, covered = ST.run_extraction(document_theories(spark, sf), definitions)
    return covered
