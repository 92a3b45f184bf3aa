"""Prompt rendering, truncation and token-array helpers as column expressions.

Renderers (R1-R4) take and return Columns, so ``process_dataset`` (R5) accepts any
of them, or user callables with the same shape (U5).  The default tokenizer is
whitespace splitting (Python ``str.split``); a real tokenizer plugs in through a
pandas UDF (see ``quire.operators.batch.tokenizer_udf``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import DEFS_MARK, EOS_MARK, OUTPUT_MARK, SEP_MARK, SYMBOLS_MARK, TYPE_MARK, py_split_ws


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zip_shortest(a, b) -> Column:
    """Pairs of two lists, stopping at the shorter (``arrays_zip`` pads, so both
    are cut to the smaller size first)."""
    n = F.least(F.size(_col(a)), F.size(_col(b)))
    return F.arrays_zip(F.slice(_col(a), 1, n).alias("a"), F.slice(_col(b), 1, n).alias("b"))


def prompt_symbols_defs(symbols="symbols", defs="defs") -> Column:
    """Symbols mark, symbols, defs mark, definitions."""
    return F.concat(F.lit(SYMBOLS_MARK), F.array_join(_col(symbols), SEP_MARK), F.lit(DEFS_MARK),
                    F.array_join(_col(defs), SEP_MARK))


def _typed_symbols(symbols, types) -> Column:
    pairs = zip_shortest(symbols, types)
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["a"], F.lit(f" {TYPE_MARK} "), p["b"])), SEP_MARK)


def prompt_types_no_defs(symbols="symbols", types="types") -> Column:
    """R2: ``symbol :::: type`` per symbol (zip stops at the shorter list)."""
    return F.concat(F.lit(SYMBOLS_MARK), _typed_symbols(symbols, types))


def prompt_types_defs(symbols="symbols", types="types", defs="defs") -> Column:
    """R2 followed by the defs mark and the definitions."""
    return F.concat(F.lit(SYMBOLS_MARK), _typed_symbols(symbols, types), F.lit(DEFS_MARK),
                    F.array_join(_col(defs), SEP_MARK))


def output_dynamic(output_key="output_key", choices: tuple[str, ...] = ("template", "lemma_object")) -> Column:
    """Output mark + the value of the column *named by* ``output_key`` + end mark.
    An unknown key gives NULL."""
    m = F.create_map(*[x for c in choices for x in (F.lit(c), F.col(c))])
    return F.concat(F.lit(OUTPUT_MARK), F.try_element_at(m, _col(output_key)), F.lit(EOS_MARK))


def process_dataset(df: DataFrame, input_fn=prompt_symbols_defs, output_fn=output_dynamic) -> DataFrame:
    """Add ``input`` and ``output`` from pluggable Column renderers."""
    return df.withColumns({"input": input_fn(), "output": output_fn()})


def whitespace_tokens(c) -> Column:
    """Default tokenizer: Python ``str.split()``."""
    return py_split_ws(c)


def truncate_tokens(c, n: int = 824, tokens=whitespace_tokens) -> Column:
    """Keep the first ``n`` tokens and decode back (whitespace: join by one space)."""
    return F.array_join(F.slice(tokens(c), 1, n), " ")


def prepare_prompt(c, n: int = 824) -> Column:
    """R6 + the output mark appended (the prompt a predictor completes)."""
    return F.concat(truncate_tokens(c, n), F.lit(OUTPUT_MARK))


def longest_first_sizes(la: Column, lb: Column, max_length: int) -> tuple[Column, Column]:
    """Sizes after ``longest_first`` truncation of a pair to ``max_length``: one
    token at a time from the longer sequence (the second on ties), in closed form."""
    fb = F.least(lb, F.greatest(F.lit(max_length) - la, F.floor(F.lit(max_length) / 2).cast("int")))
    over = (la + lb) > max_length
    fb = F.when(over, fb).otherwise(lb)
    fa = F.when(over, F.lit(max_length) - fb).otherwise(la)
    return fa, fb


def tokenize_pair(a, b, max_length: int, tokens=whitespace_tokens) -> Column:
    """Token arrays of (input, output), cut longest first to ``max_length``."""
    ta, tb = tokens(a), tokens(b)
    fa, fb = longest_first_sizes(F.size(ta), F.size(tb), max_length)
    return F.struct(F.slice(ta, 1, fa).alias("input_tokens"), F.slice(tb, 1, fb).alias("output_tokens"))


def completion_mask(ids, marker_end: Column, ignore=-100) -> Column:
    """Labels that learn only from tokens after the response mark; tokens at
    0-based positions below ``marker_end`` become ``ignore`` (all of them when the
    mark is missing, ``marker_end`` NULL)."""
    return F.transform(_col(ids), lambda t, i: F.when(marker_end.isNull() | (i < marker_end), F.lit(ignore)).otherwise(t))


def strip_prompt(out_ids, in_ids) -> Column:
    """Generated tokens without the prompt's tokens at their head."""
    o, i = _col(out_ids), _col(in_ids)
    return F.slice(o, F.size(i) + 1, F.greatest(F.size(o) - F.size(i), F.lit(0)))


def batch_pad(df: DataFrame, ids: str = "ids", row_id: str = "row_id", batch_size: int = 16, multiple: int = 8,
              pad=0) -> DataFrame:
    """Batches of ``batch_size`` consecutive rows, each left-padded to the longest
    in its batch rounded up to ``multiple``.  A batch is at most ``batch_size`` rows,
    so the window never holds a large group."""
    b = df.withColumn("batch", F.floor(F.col(row_id) / batch_size))
    longest = F.max(F.size(ids)).over(Window.partitionBy("batch"))
    b = b.withColumn("pad_len", (F.ceil(longest / multiple) * multiple).cast("int"))
    return b.withColumn("padded", F.concat(F.array_repeat(F.lit(pad), F.col("pad_len") - F.size(ids)), F.col(ids)))
