"""Assembly jobs: join theorems with the symbols and definitions they depend on.

templates    (theory_file, lemma_name, lemma_object, symbols array<string>, template [, types])
theorems     (theory_file, lemma_name, stmt)           -- X2 + A3 output
definitions  (def_key, theory_file, pos, def_name, def_stmt)
lemmas       (theory_file, lemma_name, lemma_object, lemma_command, used_symbols, local_symbols,
              used_defs, local_defs, defs, template)

Scale notes
-----------
* J1/J2 look up every distinct symbol once (both keys through *one* join, with a
  priority), then join the found texts to the lemmas' symbols and regroup per lemma.
  Popular symbols (hot keys) are split by AQE's skew-join handling.
* A2 is ``collect_set`` per file, partially aggregated in every map task, so a
  file holding a third of all lemmas sends only its distinct symbols.
* Order matters (definitions in symbol order, local definitions in file order):
  positions travel with the rows through every shuffle and arrays are sorted by
  them at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import statements as ST
from quire.session import cut_lineage


def _dots(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))


def definition_keys(symbol) -> tuple[Column, Column]:
    """J1 keys: one dot -> the symbol; two dots -> without its last segment (key 1),
    and when that ends in ``_class``, without those 6 characters (key 2); any other
    dot count -> no key."""
    s = F.col(symbol) if isinstance(symbol, str) else symbol
    n = _dots(s)
    head = F.regexp_replace(s, r"\.[^.]*\z", "")
    key1 = F.when(n == 1, s).when(n == 2, head)
    key2 = F.when((n == 2) & head.endswith("_class"), F.substring(head, F.lit(1), F.length(head) - 6))
    return key1, key2


def last_definitions(definitions: DataFrame) -> DataFrame:
    """A3 on the lookup side of J1: one (def_key, def_stmt) per key, the last in theory and
    file order."""
    return definitions.groupBy("def_key").agg(F.max_by("def_stmt", F.struct("theory_file", "pos")).alias("def_stmt"))


def dependent_definitions(lemmas: DataFrame, definitions: DataFrame, id_cols: list[str],
                          symbols_col: str = "used_symbols", all_rows: bool = True) -> DataFrame:
    """J1 + J2: definitions used by each lemma, in symbol order, duplicates kept,
    missing or empty ones skipped.  Every distinct symbol is looked up once: the first of its
    keys that exists wins (an empty definition still stops the lookup).  Returns
    ``id_cols + [used_defs]`` for every lemma (an empty array when none is found);
    ``all_rows=False`` returns only the lemmas with at least one hit (the caller's own
    left join fills the rest)."""
    ex = lemmas.select(*id_cols, F.posexplode(symbols_col).alias("spos", "symbol"))
    symbols = ex.select("symbol").distinct()
    k1, k2 = definition_keys(F.col("symbol"))
    keys = F.array(F.struct(F.lit(1).alias("prio"), k1.alias("key")), F.struct(F.lit(2).alias("prio"), k2.alias("key")))
    probes = (symbols.select("symbol", F.explode(keys).alias("k"))
              .select("symbol", "k.prio", F.col("k.key").alias("def_key")).where(F.col("def_key").isNotNull()))
    lookup = last_definitions(definitions) if "pos" in definitions.columns else definitions.select("def_key", "def_stmt")
    best = (probes.join(lookup, "def_key").groupBy("symbol").agg(F.min_by("def_stmt", "prio").alias("def_stmt"))
            .where(F.col("def_stmt").isNotNull() & (F.col("def_stmt") != "")))
    per = ex.join(best, "symbol").groupBy(*id_cols).agg(F.array_sort(F.collect_list(F.struct("spos", "def_stmt"))).alias("h"))
    found = per.select(*id_cols, F.col("h.def_stmt").alias("used_defs"))
    if not all_rows:
        return found
    return (lemmas.select(*id_cols).join(found, id_cols, "left")
            .withColumn("used_defs", F.coalesce("used_defs", F.array().cast("array<string>"))))


def local_symbol_sets(lemmas: DataFrame, file_col: str = "theory_file", symbols_col: str = "used_symbols") -> DataFrame:
    """A2: sorted union of the symbols of every lemma of a file."""
    return (lemmas.select(file_col, F.explode(symbols_col).alias("s"))
            .groupBy(file_col).agg(F.sort_array(F.collect_set("s")).alias("file_symbols")))


def local_definitions(definitions: DataFrame, file_col: str = "theory_file") -> DataFrame:
    """J5 (right side): all definition texts of a file in file order."""
    return definitions.groupBy(file_col).agg(
        F.array_sort(F.collect_list(F.struct("pos", "def_stmt"))).alias("d")
    ).select(file_col, F.col("d.def_stmt").alias("local_defs"))


def theorem_command(lemmas: DataFrame, theorems: DataFrame) -> DataFrame:
    """Attach the source statement by (theory, short name); NULL when absent."""
    th = theorems.select("theory_file", F.col("lemma_name").alias("short_name"), F.col("stmt").alias("lemma_command"))
    return (lemmas.withColumn("short_name", T.short_theorem_name("lemma_name"))
            .join(th, ["theory_file", "short_name"], "left").drop("short_name"))


def symbol_types(lemmas: DataFrame, types: DataFrame, id_cols: list[str], symbols_col: str = "used_symbols") -> DataFrame:
    """Type of every symbol of a lemma, aligned with the symbol list (NULL when
    unknown; an empty list for a lemma without symbols).  ``types`` is (symbol, type)."""
    ex = lemmas.select(*id_cols, F.posexplode_outer(symbols_col).alias("spos", "symbol"))
    j = ex.join(types.select("symbol", "type"), "symbol", "left")
    entry = F.when(F.col("spos").isNotNull(), F.struct("spos", "type"))
    per = j.groupBy(*id_cols).agg(F.array_sort(F.collect_list(entry)).alias("t"))
    return per.select(*id_cols, F.col("t.type").alias("types"))


# Entries of one chunk of a file's list.
CHUNK = 1000


def definition_chunks(definitions: DataFrame, chunk: int = CHUNK, file_col: str = "theory_file") -> DataFrame:
    """J5 stored once a file: (theory_file, chunk, first, local_defs).

    A chunk holds the definitions at ``chunk`` consecutive places of a file, so a file with very many
    is very many rows, and no task ever holds its whole list; ``first`` is the number of definitions
    in the chunks before it (a running sum over the file's chunk counts).
    """
    placed = definitions.withColumn("chunk", F.floor(F.col("pos") / chunk))
    parts = placed.groupBy(file_col, "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "def_stmt"))).alias("d"))
    before = Window.partitionBy(file_col).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(file_col, "chunk").agg(F.count(F.lit(1)).alias("n"))
    firsts = counts.select(file_col, "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return parts.join(firsts, [file_col, "chunk"]).select(file_col, "chunk", "first", F.col("d.def_stmt").alias("local_defs"))


# Symbols of the lemmas' lists that one task of ``symbol_chunks`` gets.
SYMBOLS_PER_TASK = 1_000_000


def symbol_chunks(lemmas: DataFrame, chunk: int = CHUNK, file_col: str = "theory_file", symbols_col: str = "used_symbols",
                  per_task: int = SYMBOLS_PER_TASK) -> DataFrame:
    """A2 stored once a file: (theory_file, chunk, file_symbols).  The distinct symbols of a file are dealt by
    their md5 to as many chunks as they need, each sorted; a sorted union of the chunks is the file's set.

    ``lemmas`` is read twice: give a table, not a long plan.  The tasks grow in number with its symbols, so that
    none gets many more than ``per_task`` in either shuffle (but a file's distinct symbols meet in one task, where they
    are sorted and counted and may spill)."""
    n = lemmas.select(F.sum(F.size(symbols_col).cast("long"))).first()[0] or 0
    tasks = max(lemmas.sparkSession.sparkContext.defaultParallelism, -(-n // per_task))
    listed = lemmas.where(F.col(file_col).isNotNull()).select(file_col, F.explode(symbols_col).alias("s"))
    names = listed.repartition(tasks, file_col, "s").distinct().repartition(tasks, file_col)
    pieces = F.ceil(F.count(F.lit(1)).over(Window.partitionBy(file_col)) / chunk)
    dealt = names.withColumn("chunk", F.conv(F.substring(F.md5("s"), 1, 8), 16, 10).cast("long") % pieces)
    return dealt.groupBy(file_col, "chunk").agg(F.sort_array(F.collect_list("s")).alias("file_symbols"))


def lemma_references(templates: DataFrame, theorems: DataFrame, definitions: DataFrame, runs: DataFrame | None = None,
                     chunk: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """J6 without the copies: (lemmas, symbol chunks, definition chunks).

    A lemma row has all of J6 but its file's lists; of these it has only the sizes
    (``n_local_symbols``, ``n_local_defs``), and refers to the chunks by its ``theory_file``.  A file of n
    lemmas and m definitions costs n + m.  ``expand_references`` rebuilds J6's rows.
    """
    every, found = _joined_lemmas(templates, theorems, definitions, runs)
    symbols = cut_lineage(symbol_chunks(every, chunk), "symbol-chunks")
    defs = cut_lineage(definition_chunks(definitions, chunk), "definition-chunks")
    n_symbols = symbols.groupBy("theory_file").agg(F.sum(F.size("file_symbols")).alias("n_file_symbols"))
    n_defs = defs.groupBy("theory_file").agg(F.sum(F.size("local_defs")).alias("n_file_defs"))
    sized = found.join(n_symbols.join(n_defs, "theory_file", "full"), "theory_file", "left")
    # the file's set covers every lemma's own symbols
    local = F.coalesce("n_file_symbols", F.lit(0)) - F.size(F.array_distinct("used_symbols"))
    lemmas = sized.select("lemma_id", "theory_file", "lemma_name", "lemma_object", "lemma_command", "used_symbols", local.alias("n_local_symbols"),
                          "used_defs", F.coalesce("n_file_defs", F.lit(0)).alias("n_local_defs"), "template")
    return lemmas, symbols, defs


def expand_references(lemmas: DataFrame, symbols: DataFrame, defs: DataFrame) -> DataFrame:
    """J6's rows from ``lemma_references``, for those who want every file's lists on each of its lemmas."""
    sets = symbols.groupBy("theory_file").agg(F.sort_array(F.flatten(F.collect_list("file_symbols"))).alias("file_symbols"))
    lists = defs.groupBy("theory_file").agg(F.array_sort(F.collect_list(F.struct("first", "local_defs"))).alias("d"))
    lists = lists.select("theory_file", F.flatten("d.local_defs").alias("local_defs"))
    return _with_lists(lemmas, sets.join(lists, "theory_file", "full"))


def _joined_lemmas(templates: DataFrame, theorems: DataFrame, definitions: DataFrame, runs: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """All lemmas (P14 applied) with an id, and those that J6 keeps (P6) with their statement and used definitions."""
    if runs is not None:
        templates = templates.join(ST.single_result_guard(runs.select("theory_file")), "theory_file", "left_semi")
    every = cut_lineage(templates.withColumn("used_symbols", F.col("symbols")).withColumn("lemma_id", F.monotonically_increasing_id()), "lemmas")
    t = ST.drop_generated(every, "lemma_name")
    used = dependent_definitions(t, definitions, ["lemma_id"], all_rows=False)
    # the statements meet the names alone, so the lemmas with their symbols move once to both
    commands = theorem_command(t.select("lemma_id", "theory_file", "lemma_name"), theorems).select("lemma_id", "lemma_command")
    found = t.join(commands, "lemma_id").join(used, "lemma_id", "left")
    empty = F.array().cast("array<string>")
    return every, found.withColumn("used_defs", F.coalesce("used_defs", empty)).withColumn("template", T.one_line("template"))


def _with_lists(lemmas: DataFrame, per_file: DataFrame) -> DataFrame:
    """The file's lists on every lemma."""
    empty = F.array().cast("array<string>")
    out = (
        lemmas.join(per_file, "theory_file", "left")
        .withColumn("local_symbols", F.coalesce(F.array_except("file_symbols", "used_symbols"), empty))
        .withColumn("local_defs", F.coalesce("local_defs", empty))
        .withColumn("defs", F.concat("local_defs", "used_defs"))
    )
    return out.select("theory_file", "lemma_name", "lemma_object", "lemma_command", "used_symbols",
                      "local_symbols", "used_defs", "local_defs", "defs", "template")


def assemble_lemmas(templates: DataFrame, theorems: DataFrame, definitions: DataFrame,
                    runs: DataFrame | None = None) -> DataFrame:
    """P14 + A2 + P6 + X7/J3 + J4 + J1/J2 + J5 + O6 + X16 -> the ``lemmas`` table.

    With ``runs`` (theory_file, one row per delivered result) only theories with exactly
    one result are used.  The file symbol sets cover all lemmas of a file; generated
    lemmas are skipped after that.  ``defs`` is local definitions followed by used ones.
    The template table feeds three branches, so it is written once with a lemma id,
    which keeps two facts of one name apart.  Every lemma carries its file's lists;
    ``lemma_references`` stores those once.
    """
    every, found = _joined_lemmas(templates, theorems, definitions, runs)
    # both per-file tables are joined first, so the lemma rows meet files once
    return _with_lists(found, local_symbol_sets(every).join(local_definitions(definitions), "theory_file", "full"))
