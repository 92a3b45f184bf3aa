"""One registered query per operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import alignment, bpe, decontam, exact_dedup, langid, quality, sharding, simhash, spelling, suffix_dedup, token_counts, url_filter, warc
from quire.llm.common import pick, table

#: The tokenizer of the contracts.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(pick(table(spark, sf_dir, "documents"), "text"), VOCABULARY, PATTERN)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.fit(url_filter.labelled_urls(spark))
    return url_filter.judge(pick(table(spark, sf_dir, "pages"), "page_id", "url"), model)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    return bpe_digests(docs)


def bpe_digests(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and ``more`` columns (ids, decoded) of a table (doc_id, text)."""
    both = docs.select("doc_id", bpe.encode_and_decode(F.col("text"), VOCABULARY, PATTERN).alias("b")).select("doc_id", "b.*")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.ids_text(F.col("ids")).cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *more)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.decisions(spark, exact_dedup.Table(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", "text_sha256")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), words=3, threshold=2)
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(pick(table(spark, sf_dir, "pages"), "page_id", "url", "html"), at_rest=True)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = decontam.find(docs, "text", table(spark, sf_dir, "benchmark"), null_ids=True)
    f = F.col("found")
    items = F.sha2(F.array_join(f["items"], ",").cast("binary"), 256)
    return found.select("doc_id", f["n_words"].alias("n_words"), decontam.n_hit(f).alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"), items.alias("items_sha256"), decontam.is_contaminated(f).alias("contaminated"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_url_filter, op3_byte_bpe, op4_exact_dedup, op5_simhash, op6_warc, op7_quality, op8_decontamination, op9_language_id, op10_sharding, op11_suffix_dedup, op12_alignment, op13_spelling)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express the operator; the others (hashes and models that SQL lacks) are
    tested against brute force."""
    return {
        "op4_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
        "op6_warc": """
            SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes, sha256(p) AS payload_digest,
                   CASE WHEN strlen(p) >= 100 AND page_id <> least_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN strlen(p) >= 100 AND page_id <> least_id THEN least_id END AS refers_to
            FROM (SELECT page_id, p, min(page_id) OVER (PARTITION BY p) AS least_id
                  FROM (SELECT page_id, coalesce(html, '') AS p FROM pages))""",
        "op8_decontamination": r"""
            WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
            item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
            wanted AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[j:j + least(len(w), 13) - 1], ' ') AS win
                       FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS j FROM item WHERE len(w) > 0)),
            size AS (SELECT DISTINCT n FROM wanted),
            there AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
                      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, size WHERE len(w) >= n)),
            hit AS (SELECT doc_id, t.n, i, item_id FROM there t JOIN wanted USING (n, win)),
            covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM hit) GROUP BY doc_id),
            found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
                      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
            SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
                   sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
            FROM doc d LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)""",
        "op11_suffix_dedup": """
            WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
            win AS (SELECT r, k, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT r, k, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM doc)),
            least_id AS (SELECT s, min(k) AS m FROM win GROUP BY s),
            hit AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM win JOIN least_id USING (s) WHERE m < k),
            numbered AS (SELECT r, i, count(*) FILTER (WHERE before IS NULL OR i > before + 50) OVER (PARTITION BY r ORDER BY i) AS g FROM hit),
            span AS (SELECT r, min(i) AS a, max(i) + 50 AS z FROM numbered GROUP BY r, g),
            piece AS (SELECT r, a, z, substr(h, 2 * coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0))) AS before
                      FROM span JOIN doc USING (r)),
            kept AS (SELECT r, string_agg(before, '' ORDER BY a) AS head, max(z) AS z, sum(z - a) AS n_removed, count(*) AS n_spans FROM piece GROUP BY r)
            SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
                   sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256
            FROM doc LEFT JOIN kept USING (r)""",
    }
