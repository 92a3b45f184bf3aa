"""Token counts: an exact histogram of encoded lengths and its suffix sums.

Documents are encoded and counted by length (partial aggregation in each task); from the histogram
suffix sums answer, for every context limit, how many documents and tokens are within or over it,
the quantile it stands at, and the total left if every document were truncated to it.

Defined results: a null text has length 0, as an empty one; repeated rows count each time; an empty
table gives only the rows of the asked limits, with zero counts and a null quantile; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import vocab
from quire.session import cut_lineage

#: Lengths summed in one block; the sums over blocks are few (longest document / this).
BLOCK = 1024
#: Context limits asked for by default; a limit needs no document of that length.
LIMITS = tuple(512 << i for i in range(9))


def encoded_length(text: Column, vocabulary: str, pattern: str) -> Column:
    """Tokens of a text (long), special tokens being ordinary text."""
    tokens = vocab.ranks(vocabulary)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import tiktoken

        enc = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
        for batch in batches:
            yield pa.array(np.fromiter((len(enc.encode_ordinary(t.as_py() or "")) for t in batch), np.int64, len(batch)))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "long")(text)


def length_histogram(lengths: DataFrame, limits: Sequence[int] = LIMITS) -> DataFrame:
    """(length, n_docs) of a one-column table of lengths; the limits are there with at least zero documents."""
    counts = lengths.toDF("length").groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))
    asked = lengths.sparkSession.createDataFrame([(int(x), 0) for x in limits], "length long, n_docs long")
    return counts.unionByName(asked).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """For every length of the histogram, taken as a context limit L, one row:

    ``context_limit``; ``n_docs`` of exactly L tokens; ``docs_within``/``tokens_within`` and
    ``docs_over``/``tokens_over`` (at most, more than L); ``truncated_total``, the tokens if every
    document kept its first L; ``quantile``, the share of documents within L.

    Two levels: sums over blocks of lengths (a few rows, the only unpartitioned window), then
    running sums inside each block.
    """
    h = histogram.withColumn("block", F.floor(F.col("length") / block)).withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    offsets = blocks.select("block", zero("d", before).alias("d_before"), zero("t", before).alias("t_before"), zero("d", after).alias("d_after"), zero("t", after).alias("t_after"))
    up = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy("block").orderBy("length").rowsBetween(1, Window.unboundedFollowing)
    s = h.join(offsets, "block").select(
        F.col("length").alias("context_limit"),
        "n_docs",
        (F.col("d_before") + F.sum("n_docs").over(up)).alias("docs_within"),
        (F.col("t_before") + F.sum("n_tokens").over(up)).alias("tokens_within"),
        (F.col("d_after") + zero("n_docs", over)).alias("docs_over"),
        (F.col("t_after") + zero("n_tokens", over)).alias("tokens_over"),
    )
    return s.withColumn("truncated_total", F.col("tokens_within") + F.col("context_limit") * F.col("docs_over")).withColumn("quantile", F.try_divide(F.col("docs_within").cast("double"), (F.col("docs_within") + F.col("docs_over")).cast("double")))


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, limits: Sequence[int] = LIMITS) -> DataFrame:
    """``suffix_sums`` of the encoded lengths of a table's ``text`` column.  The histogram is written once,
    so every text is encoded once."""
    lengths = docs.select(encoded_length(docs["text"], vocabulary, pattern))
    return suffix_sums(cut_lineage(length_histogram(lengths, limits), "token-histogram"))
