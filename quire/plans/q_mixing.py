"""Mixing queries (W3, A1, O1, J7, O3, A12) over datasets made from ``documents`` + ``labels``."""

from __future__ import annotations


from pyspark.sql import functions as F

from quire.operators import mixing as M
from quire.plans.driver import table
from quire.plans.registry import register

TOP_N = 5

_BASE_SQL = """WITH base AS (
  SELECT doc_id AS row_id, source || '/T' || CAST(doc_id AS VARCHAR) AS theory_file, lang,
         CASE WHEN b < 8000 THEN 'train' WHEN b < 9000 THEN 'test' ELSE 'valid' END AS split
  FROM (SELECT *, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 10000 AS b FROM documents)),
ds1 AS (SELECT 'd1' AS source, base.*, l.quality FROM base LEFT JOIN labels l ON l.doc_id = base.row_id WHERE lang = 'en'),
ds2 AS (SELECT 'd2' AS source, base.* FROM base WHERE lang IS DISTINCT FROM 'en'),
cnt AS (SELECT regexp_replace(theory_file, '/[^/]*$', '') AS project, count(*) AS n_rows, min(row_id) AS first_row
        FROM ds2 WHERE split = 'train' GROUP BY 1 ORDER BY n_rows DESC, first_row ASC LIMIT TOP_N),
top2 AS (SELECT * FROM ds2 WHERE regexp_replace(theory_file, '/[^/]*$', '') IN (SELECT project FROM cnt)),
un AS (SELECT source, row_id, theory_file, lang, split, quality FROM ds1
       UNION ALL SELECT source, row_id, theory_file, lang, split, NULL FROM top2 WHERE split IN (SELECT DISTINCT split FROM ds1))
""".replace("TOP_N", str(TOP_N))


def _base(spark, sf):
    d = table(spark, sf, "documents")
    base = d.select(F.col("doc_id").alias("row_id"),
                    F.concat("source", F.lit("/T"), F.col("doc_id").cast("string")).alias("theory_file"), "lang")
    return M.hash_split(base, "row_id")


def _datasets(spark, sf):
    base = _base(spark, sf)
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), "quality")
    ds1 = base.where(F.col("lang") == "en").join(labels, "row_id", "left").withColumn("source", F.lit("d1"))
    ds2 = base.where(~F.col("lang").eqNullSafe("en")).withColumn("source", F.lit("d2"))
    return ds1, ds2


@register("w3_hash_split", _BASE_SQL + "SELECT row_id, lang, split FROM base")
def w3_hash_split(spark, sf):
    """W3 default: 80/10/10 by an md5 threshold per row (no shuffle)."""
    return _base(spark, sf).select("row_id", "lang", "split")


_EXACT_SQL = """WITH h AS (SELECT doc_id AS row_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT AS hb FROM documents),
r AS (SELECT row_id, row_number() OVER (ORDER BY hb, row_id) - 1 AS i, count(*) OVER () AS n FROM h),
s AS (SELECT row_id, i, CAST(ceil(n * 0.2) AS BIGINT) AS n_held FROM r)
SELECT row_id, CASE WHEN i < CAST(ceil(n_held * 0.5) AS BIGINT) THEN 'test' WHEN i < n_held THEN 'valid' ELSE 'train' END AS split FROM s"""


@register("w3_exact_split", _EXACT_SQL)
def w3_exact_split(spark, sf):
    """W3 exact sizes: hash order + dense index (range partitions + offsets)."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"))
    return M.exact_split(d, "row_id").select("row_id", "split")


@register("a1_top_projects", _BASE_SQL + "SELECT project, n_rows, first_row FROM cnt")
def a1_top_projects(spark, sf):
    """A1 + O1: the most frequent projects of the train split, ties to the first met."""
    _, ds2 = _datasets(spark, sf)
    return M.project_counts(ds2, TOP_N)


@register("j7_union_top_projects", _BASE_SQL + "SELECT source, row_id, theory_file, lang, split, quality FROM un")
def j7_union_top_projects(spark, sf):
    """J7 (rows of the top projects, all splits) + O3 (union by split)."""
    ds1, ds2 = _datasets(spark, sf)
    out = M.union_by_split(ds1, M.top_projects(ds2, TOP_N))
    return out.select("source", "row_id", "theory_file", "lang", "split", "quality")


_A12_SQL = _BASE_SQL + """, allsets AS (SELECT 'd1' AS source, split FROM ds1 UNION ALL SELECT 'd2', split FROM ds2
   UNION ALL SELECT 'd2_top', split FROM top2 UNION ALL SELECT 'union', split FROM un)
SELECT source, split, count(*) AS n_rows FROM allsets GROUP BY source, split"""


@register("a12_dataset_sizes", _A12_SQL)
def a12_dataset_sizes(spark, sf):
    """Row counts of each input, the top-project subset and the union, per split."""
    ds1, ds2 = _datasets(spark, sf)
    top2 = M.top_projects(ds2, TOP_N)
    un = M.union_by_split(ds1, top2)
    parts = [ds1.select("split").withColumn("source", F.lit("d1")),
             ds2.select("split").withColumn("source", F.lit("d2")),
             top2.select("split").withColumn("source", F.lit("d2_top")),
             un.select("split").withColumn("source", F.lit("union"))]
    allsets = parts[0]
    for p in parts[1:]:
        allsets = allsets.unionByName(p)
    return M.dataset_sizes(allsets).select("source", "split", "n_rows")


_W1_SQL = """SELECT doc_id, source, n_chars, text, row_number() OVER (ORDER BY source, doc_id) - 1 AS row_id FROM documents"""


@register("w1_dense_index", _W1_SQL)
def w1_dense_index(spark, sf):
    """A dense 0-based row id in (source, doc_id) order, from one range-partitioned
    sort and a per-partition offset table (no single-partition window)."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars", "text")
    return M.dense_index(d, ["source", "doc_id"], "row_id").select("doc_id", "source", "n_chars", "text", "row_id")
