"""Corpus jobs: theory text -> statements -> theorems and definitions.

theories     (theory_file string, text string [, block long])
statements   (theory_file string, [block long,] pos int, kind string, stmt string)
definitions  (def_key string, theory_file string, pos int, def_name string, def_stmt string)

Splitting is a per-row expression (a scan over the text's lexemes, then ``posexplode``),
so it runs where the file is and never shuffles.  The per-theory
steps (last block wins, last statement wins) are combinable aggregates
(``max``/``max_by``) with map-side partial aggregation, so a theory holding a
third of all statements is pre-reduced in every task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.session import cut_lineage

# Outer commands that start a new statement span (besides the
# theorem and definition kinds).  Proof commands are spans of their own.
OTHER_COMMANDS = [
    "theory", "imports", "begin", "end", "section", "subsection", "subsubsection", "chapter",
    "text", "txt", "declare", "lemmas", "corollary", "proposition", "schematic_goal", "locale",
    "context", "instantiation", "instance", "interpretation", "notation", "no_notation",
    "hide_const", "hide_fact", "setup", "ML", "ML_file", "method", "by", "apply", "done", "proof",
    "qed", "oops", "sorry", "using", "unfolding", "show", "have", "obtain", "next", "termination",
    "then", "also", "finally", "thus", "hence", "fix", "assume", "case", "from", "with", "note", "let", "moreover",
    "ultimately", "lift_definition", "sublocale", "partial_function", "global_interpretation", "named_theorems",
    "bundle", "syntax", "translations", "subclass", "setup_lifting", "code_printing", "value", "export_code",
]

COMMANDS = T.THEOREM_KINDS + T.DEFINITION_KINDS + OTHER_COMMANDS


# The delimiters of the outer syntax.  Strings ("..." and `...`, with escapes by a
# backslash) and verbatim text ({* ... *}) end at their first closing mark; comments ((* ... *)) and
# cartouches nest.  Inside one of them, the marks of the others mean nothing.
COMMENT = ("(*", "*)")
VERBATIM = ("{*", "*}")
OPEN_CARTOUCHE = ("\\<open>", "‹")
CLOSE_CARTOUCHE = ("\\<close>", "›")
# A text in lexemes: a newline with the first word of its line, an escaped mark, a delimiter, or a run
# of other characters; together they are the whole text.
LEXEME = r"""(?s)\n[ \t]*[\w']*|\\["\\`]|["`‹›]|\(\*|\*\)|\{\*|\*\}|\\<open>|\\<close>|[^\n"`\\(*{‹›]+|."""

# The characters that lexemes other than runs begin with.
_MARKS = "\n\"`\\‹›(*{"
# What a lexeme lies in.
_OUTER, _STRING, _ALT_STRING, _COMMENT, _CARTOUCHE, _VERBATIM = range(6)
# Cuts after which the scan starts a new chunk of its result (appending copies a chunk).
_CUTS = 256


def _scan(lexemes: Column, is_command) -> Column:
    """The cuts of a text: array of struct(at, kind), ``at`` the 1-based lexeme that begins a span.

    One pass over the lexemes that carries what they lie in and how deep; a newline cuts where it
    lies in nothing and a command follows.
    """
    cut_type = "array<struct<at:int,kind:string>>"
    # a run of other characters changes nothing: only lexemes that begin with a mark are scanned
    cells = F.filter(F.transform(lexemes, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("at"))), lambda c: F.instr(F.lit(_MARKS), F.substring(c["x"], 1, 1)) > 0)
    start = F.struct(F.lit(_OUTER).alias("mode"), F.lit(0).alias("depth"),
                     F.array().cast(cut_type).alias("cuts"), F.array().cast(f"array<{cut_type}>").alias("done"))

    def step(state, cell):
        mode, depth, lexeme = state["mode"], state["depth"], cell["x"]
        mark = F.when(F.length(lexeme) <= 8, lexeme).otherwise(F.lit(""))
        closes = (
            F.when(mode == _STRING, mark == '"').when(mode == _ALT_STRING, mark == "`").when(mode == _COMMENT, mark == COMMENT[1])
            .when(mode == _CARTOUCHE, mark.isin(*CLOSE_CARTOUCHE)).when(mode == _VERBATIM, mark == VERBATIM[1]).otherwise(False))
        nests = (F.when(mode == _COMMENT, mark == COMMENT[0]).when(mode == _CARTOUCHE, mark.isin(*OPEN_CARTOUCHE)).otherwise(False))
        enters = (
            F.when(mark.isin('"', '\\"'), _STRING).when(mark.isin("`", "\\`"), _ALT_STRING).when(mark == COMMENT[0], _COMMENT)
            .when(mark.isin(*OPEN_CARTOUCHE), _CARTOUCHE).when(mark == VERBATIM[0], _VERBATIM).otherwise(_OUTER))
        new_mode = F.when(mode == _OUTER, enters).when(closes & (depth == 1), _OUTER).otherwise(mode)
        new_depth = (F.when(mode == _OUTER, F.when(enters == _OUTER, 0).otherwise(1))
                     .when(closes, depth - 1).when(nests, depth + 1).otherwise(depth))
        word = F.ltrim(F.substring(lexeme, F.lit(2), F.length(lexeme)), F.lit(" \t"))
        cuts = (mode == _OUTER) & lexeme.startswith("\n") & is_command(word)
        here = F.array(F.struct(cell["at"].alias("at"), word.alias("kind")))
        full = cuts & (F.size(state["cuts"]) >= _CUTS)
        return F.struct(
            new_mode.alias("mode"), new_depth.alias("depth"),
            F.when(full, here).when(cuts, F.concat(state["cuts"], here)).otherwise(state["cuts"]).alias("cuts"),
            F.when(full, F.concat(state["done"], F.array(state["cuts"]))).otherwise(state["done"]).alias("done"))

    return F.aggregate(cells, start, step, lambda s: F.flatten(F.concat(s["done"], F.array(s["cuts"]))))


def split_statements(theories: DataFrame, commands: list[str] = COMMANDS, text_col: str = "text", own_col: str | None = None) -> DataFrame:
    """Cut each theory text into consecutive command spans.

    A span starts at a line whose first word is a command and that doesn't begin inside a string,
    a comment, a cartouche or verbatim text; it runs up to the next such line (trailing newline
    included).  One that is never closed reaches the end of the text.  Text before the first
    command (a header) is a span with kind NULL.  ``pos`` is the 0-based span number.  ``own_col``
    names a column with the theory's own commands (array<string>, NULL for none), which cut, too.
    An empty or NULL text has no span.
    """
    keep = [c for c in theories.columns if c not in (text_col, own_col)]

    def is_command(word):
        known = word.isin(*commands)
        return known if own_col is None else known | F.coalesce(F.array_contains("__own", word), F.lit(False))

    own = [] if own_col is None else [F.col(own_col).alias("__own")]
    text = F.col(text_col)
    lexed = theories.where(text != "").select(*keep, *own, F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(LEXEME), F.lit(0)).alias("__lex"))
    head = F.struct(F.lit(1).alias("at"), F.lit(None).cast("string").alias("kind"))
    cuts = lexed.select(*keep, "__lex", _scan(F.col("__lex"), is_command).alias("__cuts"))
    # the text before the first command is a span of its own, unless the first lexeme is one
    starts = F.when(F.try_element_at("__cuts", F.lit(1))["at"] == 1, F.col("__cuts")).otherwise(F.concat(F.array(head), F.col("__cuts")))
    cuts = cuts.select(*keep, "__lex", starts.alias("__cuts"))
    ends = F.concat(F.transform(F.slice(F.col("__cuts"), F.lit(2), F.size("__cuts")), lambda c: c["at"]), F.array(F.size("__lex") + 1))

    def span(cut, end):
        # a span's first lexeme begins with the newline that ends the span before
        joined = F.array_join(F.slice(F.col("__lex"), cut["at"], end - cut["at"]), "")
        stmt = F.concat(F.substring(joined, F.lit(2), F.length(joined)), F.when(end <= F.size("__lex"), F.lit("\n")).otherwise(F.lit("")))
        return F.struct(cut["kind"].alias("kind"), stmt.alias("stmt"))

    spans = cuts.select(*keep, F.posexplode(F.zip_with("__cuts", ends, span)).alias("pos", "__span"))
    return spans.select(*keep, F.col("pos").cast("int").alias("pos"), "__span.kind", "__span.stmt")


# --- commands of a theory's own (X1, P5) --------------------------------------
# The parts of a theory header, and the kind of declared keyword that is no command.
HEADER = r"(?s)\btheory\s+\"?([^\s\"]+)\"?(.*?)\bbegin\b"
IMPORTS = r"(?s)\bimports\b(.*?)(?:\bkeywords\b|\babbrevs\b|\z)"
KEYWORDS = r"(?s)\bkeywords\b(.*?)(?:\babbrevs\b|\z)"
NO_COMMAND = "quasi_command"


def theory_headers(theories: DataFrame, text_col: str = "text", key: str = "theory_file") -> DataFrame:
    """(theory_file, name, imports, commands) of every theory with a header
    ``theory N imports A B keywords "k" "l" :: kind and "m" begin``.

    Imports are base names, without session and path.  A keyword is a command if a kind is
    declared for it; one without a kind, or of kind ``quasi_command``, is part of other commands.
    """
    plain = F.regexp_replace(F.col(text_col), r"(?s)\(\*.*?\*\)", " ")
    h = theories.select(key, F.regexp_extract(plain, HEADER, 1).alias("__n"), F.regexp_extract(plain, HEADER, 2).alias("__h")).where("__n <> ''")
    imported = F.regexp_extract_all(F.regexp_extract("__h", IMPORTS, 1), F.lit(r'[^\s"]+'), F.lit(0))
    groups = F.split(F.regexp_extract("__h", KEYWORDS, 1), r"\band\b")
    declared = F.filter(groups, lambda g: ~F.regexp_extract(g, r"::\s*\"?([\w-]*)", 1).isin("", NO_COMMAND))
    names = F.flatten(F.transform(declared, lambda g: F.regexp_extract_all(F.substring_index(g, "::", 1), F.lit(r'"([^"]*)"'), F.lit(1))))
    return h.select(key, F.col("__n").alias("name"), F.array_distinct(F.transform(imported, _base_name)).alias("imports"),
                    F.array_distinct(names).alias("commands"))


def _base_name(name):
    return F.substring_index(F.substring_index(name, "/", -1), ".", -1)


def known_commands(headers: DataFrame) -> DataFrame:
    """(name, command): the commands that each theory declares or gets from its imports, over any
    number of steps.

    A semi-naive iteration: each round joins only the pairs found in the last one to the import
    edges, an equi-join on the imported name, and drops those already known; it ends when a round
    finds none, so cyclic imports end, too.  The rounds' tables are written to the shared
    checkpoint folder.  Theory names are taken as unique.
    """
    edges = cut_lineage(headers.select("name", F.explode("imports").alias("imported")).distinct(), "imports")
    known = fresh = cut_lineage(headers.select("name", F.explode("commands").alias("command")).distinct(), "commands")
    while not fresh.isEmpty():
        passed = edges.join(fresh.withColumnRenamed("name", "imported"), "imported").select("name", "command").distinct()
        fresh = cut_lineage(passed.join(known, ["name", "command"], "left_anti"), "commands")
        known = known.unionByName(fresh)
    return known


def split_with_own_commands(theories: DataFrame, commands: list[str] = COMMANDS, text_col: str = "text", key: str = "theory_file") -> DataFrame:
    """X1 with the outer syntax of each theory: besides ``commands``, those that its header or a
    theory it imports declares start a span.  A theory without a header has ``commands`` only."""
    headers = cut_lineage(theory_headers(theories, text_col, key), "headers")
    own = known_commands(headers).groupBy("name").agg(F.collect_set("command").alias("__commands"))
    named = headers.join(own, "name").select(key, "__commands").groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("__commands"))).alias("__commands"))
    return split_statements(theories.join(named, key, "left"), commands, text_col, "__commands")


def kind_filter(statements: DataFrame, kinds: list[str]) -> DataFrame:
    """P5: keep statements of the given kinds."""
    return statements.where(F.col("kind").isin(kinds))


def last_block(theories: DataFrame, block_col: str = "block", key: str = "theory_file") -> DataFrame:
    """P5 quirk: a theory delivered in several blocks keeps only its last block.  Taken on the
    theories, before their text is cut.

    ``max`` per theory is partially aggregated on the map side; the semi join is on
    (theory, block), which spreads a hot theory over its many blocks.
    """
    last = theories.groupBy(key).agg(F.max(block_col).alias(block_col))
    return theories.join(last, [key, block_col], "left_semi")


def theorems(statements: DataFrame) -> DataFrame:
    """X2 + A3: named theorem statements, one per (theory, name); a repeated name
    keeps its last statement, and all unnamed ones share the NULL name."""
    thm = kind_filter(statements, T.THEOREM_KINDS).withColumn("lemma_name", T.theorem_name("stmt"))
    return last_wins(thm, ["theory_file", "lemma_name"], "stmt", "pos")


def last_wins(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """A3/A4: duplicate key keeps the value with the greatest ``order``."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def definitions(statements: DataFrame) -> DataFrame:
    """X3 + X6: definition statements with their name and ``theory.name`` key."""
    d = kind_filter(statements, T.DEFINITION_KINDS).withColumn("def_name", T.definition_name("stmt"))
    return d.select(
        T.qualified_def_key("theory_file", "def_name").alias("def_key"),
        "theory_file", "pos", "def_name", F.col("stmt").alias("def_stmt"),
        *[c for c in ("block",) if c in d.columns],
    )


def drop_generated(df: DataFrame, name_col: str = "lemma_name") -> DataFrame:
    """Skip names with more than one dot (facts generated from definitions)."""
    n = F.col(name_col)
    return df.where(F.length(n) - F.length(F.replace(n, F.lit("."), F.lit(""))) <= 1)


def single_result_guard(results: DataFrame, key: str = "theory_file") -> DataFrame:
    """Use a theory only when it delivered exactly one result."""
    one = results.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.any_value(F.struct(*results.columns)).alias("r"))
    return one.where(F.col("n") == 1).select("r.*")


def coverage(runs: DataFrame, has_data=None, data_col: str = "data") -> DataFrame:
    """A10: runs with data / all runs.  ``has_data`` is a boolean column; by default a
    non-empty ``data`` list (a missing list counts as no data)."""
    has = has_data if has_data is not None else F.coalesce(F.size(data_col), F.lit(0)) > 0
    return runs.agg(F.count_if(has).alias("n_with_data"), F.count(F.lit(1)).alias("n_all"),
                    (F.count_if(has) / F.count(F.lit(1))).alias("ratio"))


def run_extraction(theories: DataFrame, extraction_fn, data_col: str = "data") -> tuple[DataFrame, DataFrame]:
    """U4: apply a pluggable extraction job to the theories (``df.transform``) and
    report coverage (A10) of its results: runs whose ``data`` is non-empty."""
    results = theories.transform(extraction_fn)
    return results, coverage(results, data_col=data_col)
