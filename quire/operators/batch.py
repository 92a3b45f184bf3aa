"""Batch work over partitions: pluggable row/batch functions, the predictor, guarded
rows, fingerprints, rerunning only what is missing, and small reports.

The predictor runs inside ``mapInPandas``: each task loads the model once (the
factory is called once per task, not per row), handles Arrow batches of prompts,
and returns ``row_id`` with the candidates, so no gather to the driver and no
reliance on row order.  Errors of a row become its ``status`` instead of failing
the job (U6).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, StringType, StructType

from quire.functions.text import py_split_ws


# The default predictor answers like the template service stub: "Template for <name>".
STUB_PREFIX = "Template for "


def stub_predictor(k: int | None = None) -> Callable[[list[str]], list[list[str]]]:
    """A model stand-in: for every prompt, ``Template for <w>`` for each of its words (the first
    ``k``, if given).  A prompt without words raises (to exercise the error path)."""

    def predict(prompts: list[str]) -> list[list[str]]:
        out = []
        for p in prompts:
            words = p.split()
            if not words:
                raise ValueError("empty prompt")
            out.append([STUB_PREFIX + w for w in words[:k]])
        return out

    return predict


# Words that a trained bigram model knows, and words of a continuation.
VOCABULARY = 50_000
CONTINUATION = 5


def train_bigrams(texts: DataFrame, text_col: str = "text", vocabulary: int = VOCABULARY) -> dict[str, str]:
    """A word model of a table of texts: for each of the ``vocabulary`` words that are most often followed by
    another one (ties: in order of the words), the word that follows it most often (ties: the first).

    Pairs are counted by a combinable aggregate; only the model, at most ``vocabulary`` rows, reaches
    the driver and, in the predictor, the tasks.
    """
    words = texts.select(py_split_ws(text_col).alias("w"))
    pairs = words.select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))).alias("p"))
    counts = pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))
    follows = counts.groupBy("a").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("n"), "b")).alias("best"))
    rows = follows.orderBy(F.desc("total"), "a").limit(vocabulary).select("a", F.col("best.b").alias("b")).collect()
    return {r["a"]: r["b"] for r in rows}


def bigram_predictor(model: dict[str, str], length: int = CONTINUATION, window: int | None = None) -> Callable[[list[str]], list[list[str]]]:
    """A predictor that continues a prompt, word by word from its last one, by the most frequent follower, as
    far as the model knows one and up to ``length`` words; a prompt whose last word it doesn't know
    has no candidate.  It refuses (raises on) a prompt without words or with more than ``window``."""

    def predict(prompts: list[str]) -> list[list[str]]:
        out = []
        for p in prompts:
            words = p.split()
            if not words:
                raise ValueError("empty prompt")
            if window is not None and len(words) > window:
                raise ValueError(f"{len(words)} words in a window of {window}")
            said, word = [], words[-1]
            while len(said) < length and word in model:
                word = model[word]
                said.append(word)
            out.append([" ".join(said)] if said else [])
        return out

    return predict


class RowTimeout(Exception):
    """A row ran past its time limit."""


def _call_with_limit(fn, arg, seconds: float | None):
    """Run ``fn(arg)``; with ``seconds``, raise RowTimeout when it runs longer (a
    real-time alarm in the Python worker, which runs the function in its main
    thread)."""
    if not seconds:
        return fn(arg)
    import signal

    def on_alarm(signum, frame):
        raise RowTimeout(f"no result within {seconds}s")

    old = signal.signal(signal.SIGALRM, on_alarm)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return fn(arg)
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, old)


def predict(df: DataFrame, make_predictor: Callable[[], Callable[[list[str]], list[list[str]]]],
            prompt_col: str = "prompt", id_col: str | list[str] = "row_id",
            row_timeout: float | None = None, timed: bool = False) -> DataFrame:
    """U3 + U6: k candidates per prompt over the input's own partitions:
    (id columns, candidates, status, error).

    ``make_predictor`` is called once per task (load the model there).  A batch is
    predicted at once; when a batch fails, its rows are retried one by one so only
    the failing rows get ``status='error'`` (with the message) and empty candidates; so
    does a model that returns another number of answers than it was asked for.
    With ``row_timeout`` (seconds) rows are predicted one at a time and a row past
    the limit gets ``status='timeout'`` (the original allowed 60 s per row).  With ``timed`` there is a
    column ``seconds``, each row's part of the time that the model took for its batch.
    """

    ids = [id_col] if isinstance(id_col, str) else list(id_col)

    def answers(model, prompts):
        got = model(prompts)
        if len(got) != len(prompts):
            raise ValueError(f"{len(got)} answers to {len(prompts)} prompts")
        return got

    def one(model, p):
        try:
            return _call_with_limit(lambda x: answers(model, x), [p], row_timeout)[0], "ok", None
        except RowTimeout as e:
            return [], "timeout", str(e)
        except Exception as e:  # noqa: BLE001 - a row's failure is data
            return [], "error", f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_predictor()
        for pdf in batches:
            prompts = pdf[prompt_col].fillna("").astype(str).tolist()
            begun = time.monotonic()
            rows = None
            if not row_timeout:
                try:
                    rows = [(c, "ok", None) for c in answers(model, prompts)]
                except Exception:  # fall back to rows to isolate the bad ones
                    rows = None
            if rows is None:
                rows = [one(model, p) for p in prompts]
            cands, status, err = (list(x) for x in zip(*rows)) if rows else ([], [], [])
            out = pdf[ids].assign(candidates=cands, status=status, error=err)
            yield out.assign(seconds=(time.monotonic() - begun) / max(len(rows), 1)) if timed else out

    src = df.select(*ids, prompt_col)
    schema = ", ".join(f"`{c}` {t}" for c, t in src.select(*ids).dtypes) + ", candidates array<string>, status string, error string" + (", seconds double" if timed else "")
    return src.mapInPandas(run, schema)


# Rows that a user function gets at once.
ROWS_AT_ONCE = 256


# Types whose columns Arrow and the user functions' pandas hand over alike, piece by piece.
PLAIN = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of ``ROWS_AT_ONCE`` rows (no copies); a batch is let go before the next one is read."""
    for b in batches:
        for i in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(i, ROWS_AT_ONCE)
        del b
        pa.default_memory_pool().release_unused()


def map_rows(df: DataFrame, fn: Callable[[pd.Series], pd.Series], col: str, out: str, return_type: str = "string") -> DataFrame:
    """A user function per row, vectorised over pandas Series (prefer a Column expression when one exists).

    It gets ``ROWS_AT_ONCE`` rows of an Arrow batch at once and its results go back at once, so that Python holds few of
    the texts beside the batch; a table with a column of another than the ``PLAIN`` types, or one that
    has ``out``, goes through a pandas UDF, a whole batch at once."""
    made, names = PLAIN.get(return_type), df.columns
    if made is None or not all(t in PLAIN for _, t in df.dtypes) or len({n.lower() for n in [*names, out]}) <= len(names):
        return df.withColumn(out, F.pandas_udf(fn, return_type)(F.col(col)))

    def added(p: pa.RecordBatch) -> pa.RecordBatch:
        values = pa.Array.from_pandas(fn(p.column(col).to_pandas()), type=made)
        return pa.RecordBatch.from_arrays([*p.columns, values], [*names, out])

    return df.mapInArrow(lambda it: map(added, _pieces(it)), StructType([*df.schema.fields, *StructType.fromDDL(f"`{out}` {return_type}").fields]))


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user function per piece of an Arrow batch, of at most ``ROWS_AT_ONCE`` rows, so that what the
    function makes of whole texts (such as their words) is held for few of them.  So are the Python objects of the
    texts themselves, unless a column is of another than the ``PLAIN`` types: then the batch becomes one
    pandas frame first."""
    result = StructType.fromDDL(schema)
    types = [t for _, t in df.dtypes] + [f.dataType.simpleString() for f in result]
    if not all(t in PLAIN for t in types):
        pieces = lambda b: (b.iloc[i:i + ROWS_AT_ONCE].reset_index(drop=True) for i in range(0, len(b), ROWS_AT_ONCE))
        return df.mapInPandas(lambda it: (fn(p) for b in it for p in pieces(b)), schema)
    made = pa.schema([(f.name, PLAIN[f.dataType.simpleString()]) for f in result])
    back = lambda pdf: pa.RecordBatch.from_pandas(pdf, schema=made, preserve_index=False)
    return df.mapInArrow(lambda it: (back(fn(p.to_pandas())) for p in _pieces(it)), schema)


def tokenizer_udf(make_tokenizer: Callable[[], Callable[[str], list[int]]]):
    """A pandas UDF encoding text to token ids with a tokenizer built once per
    worker process (cached on first use)."""
    state: dict = {}

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        tok = state.get("tok")
        if tok is None:
            tok = state["tok"] = make_tokenizer()
        return texts.fillna("").map(lambda t: list(tok(t)))

    return encode


# The deepest level that a fingerprint looks at, and what stands for the rest.
MAX_DEPTH = 6
BEYOND, UNKNOWN = "max_depth_reached", "unknown"


def fingerprint(*cols: str, df: DataFrame | None = None, ignore: tuple[str, ...] = ()) -> Column:
    """H1: md5 of the row ``{name: value}``: see ``value_hash``.  The columns in ``ignore`` are left out, as are
    keys of that name at every level.  Column order matters."""
    types = {f.name: f.dataType for f in df.schema.fields} if df is not None else {}
    pairs = [(c, F.col(c), types.get(c, StringType())) for c in cols if c not in ignore]
    return _dict_hash(pairs, 0, ignore)


def value_hash(c: Column, dtype: DataType, depth: int = 0, ignore: tuple[str, ...] = ()) -> Column:
    """The hash of a nested value, an expression built from its type.

    A scalar is hashed as its text (booleans as ``True`` and ``False``), an array as its elements' hashes one
    behind the other, a struct or a map (in its order) as its keys' and values' hashes, without the
    ignored keys.  NULL, at any level, counts as unknown; below ``MAX_DEPTH`` everything counts alike.
    """
    if depth > MAX_DEPTH:
        return F.lit(_py_md5(BEYOND))
    unknown = F.lit(_py_md5(UNKNOWN))
    if isinstance(dtype, ArrayType):
        out = F.md5(F.array_join(F.transform(c, lambda x: value_hash(x, dtype.elementType, depth + 1, ignore)), ""))
    elif isinstance(dtype, MapType):
        entries = F.map_entries(c)
        if ignore and isinstance(dtype.keyType, StringType):
            entries = F.filter(entries, lambda e: ~e["key"].isin(*ignore))
        out = F.md5(F.array_join(F.transform(entries, lambda e: F.concat(
            value_hash(e["key"], dtype.keyType, depth + 1, ignore), value_hash(e["value"], dtype.valueType, depth + 1, ignore))), ""))
    elif isinstance(dtype, StructType):
        out = F.when(c.isNotNull(), _dict_hash([(f.name, c[f.name], f.dataType) for f in dtype.fields if f.name not in ignore], depth, ignore))
    elif isinstance(dtype, BooleanType):
        out = F.md5(F.when(c, F.lit("True")).otherwise(F.when(c.isNotNull(), F.lit("False"))))
    else:
        out = F.md5(c.cast("string"))
    return F.coalesce(out, unknown)


def _dict_hash(pairs: list[tuple[str, Column, DataType]], depth: int, ignore: tuple[str, ...]) -> Column:
    if not pairs:
        return F.lit(_py_md5(""))
    key = lambda name: F.lit(_py_md5(BEYOND if depth + 1 > MAX_DEPTH else name))
    return F.md5(F.concat(*[h for name, c, t in pairs for h in (key(name), value_hash(c, t, depth + 1, ignore))]))


def _py_md5(s: str) -> str:
    import hashlib

    return hashlib.md5(s.encode()).hexdigest()


def rerun_missing(todo: DataFrame, done: DataFrame, key: str = "fingerprint", ok: Column | None = None) -> DataFrame:
    """Rows of ``todo`` without a good result in ``done`` (failed ones rerun)."""
    good = done.where(ok) if ok is not None else done
    return todo.join(good.select(key).distinct(), key, "left_anti")


def merge_maps_last_wins(df: DataFrame, keys: list[str], map_col: str, order: str) -> DataFrame:
    """A4: merge the maps of each group, a later map (greater ``order``) wins per key."""
    e = df.select(*keys, order, F.explode(map_col).alias("k", "v"))
    return e.groupBy(*keys, "k").agg(F.max_by("v", order).alias("v"))


def stage_comparison(results: DataFrame, stages: list[str], run_col: str = "run") -> DataFrame:
    """Passes and failures per (run, stage) from one boolean column per stage."""
    long = results.unpivot([run_col], stages, "stage", "passed")
    return long.groupBy(run_col, "stage").agg(F.count_if(F.col("passed")).alias("n_pass"),
                                             F.count_if(~F.col("passed")).alias("n_fail"))


def _units() -> tuple[Column, Column]:
    """Characters and white-space tokens of a row's candidates."""
    chars = F.aggregate(F.transform("candidates", F.length), F.lit(0).cast("long"), lambda a, x: a + x)
    toks = F.aggregate(F.transform("candidates", lambda c: F.size(py_split_ws(c))), F.lit(0).cast("long"), lambda a, x: a + x)
    return chars, toks


def throughput(preds: DataFrame, elapsed_sec: float | None = None) -> DataFrame:
    """Characters and whitespace tokens generated, per strategy; with the
    elapsed wall time (a driver value) also units per second."""
    chars, toks = _units()
    out = preds.groupBy("strategy").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(chars).alias("n_chars"), F.sum(toks).alias("n_tokens"))
    if elapsed_sec:
        out = out.withColumn("chars_per_sec", F.floor(F.col("n_chars") / F.lit(float(elapsed_sec))))
    return out


def measured(preds: DataFrame, save: Callable[[DataFrame], None]) -> DataFrame:
    """A11 of a real run: ``save`` (an action, such as writing the predictions) is run and timed, and its rows and
    units are counted while they pass (``Observation``), without a second pass.

    One row: n_rows, n_chars, n_tokens, ``wall_sec``, ``task_sec`` (the time that the model took in all
    tasks, if the predictions were made with ``timed``), and characters and tokens a second of wall time.
    """
    chars, toks = _units()
    busy = [F.sum("seconds").alias("task_sec")] if "seconds" in preds.columns else []
    seen = Observation("throughput")
    watched = preds.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.sum(chars).alias("n_chars"), F.sum(toks).alias("n_tokens"), *busy)
    begun = time.monotonic()
    save(watched)
    wall = time.monotonic() - begun
    m = seen.get
    n = {k: int(m.get(k) or 0) for k in ("n_rows", "n_chars", "n_tokens")}
    row = (n["n_rows"], n["n_chars"], n["n_tokens"], wall, m.get("task_sec"), n["n_chars"] / wall, n["n_tokens"] / wall)
    return preds.sparkSession.createDataFrame([row], "n_rows long, n_chars long, n_tokens long, wall_sec double, task_sec double, chars_per_sec double, tokens_per_sec double")


def melt_loss(log: DataFrame, every: int = 10) -> DataFrame:
    """Training log -> (step, variable, value); the training loss only on
    steps divisible by ``every``, else NULL."""
    x = log.withColumn("loss", F.when(F.col("step") % every == 0, F.col("loss")))
    return x.unpivot(["step"], ["loss", "eval_loss"], "variable", "value")


def index_of(arr, value, start: int = 0) -> Column:
    """Position of ``value`` counted from ``start``; NULL when absent (the
    original raises)."""
    p = F.array_position(F.col(arr) if isinstance(arr, str) else arr, value)
    return F.when(p > 0, p - 1 + start)
