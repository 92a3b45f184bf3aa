"""The two extraction jobs, each one plan from its inputs to its table.

templates  (theory_file, lemma_name, lemma_object, symbols, types, template)  -- from terms
lemmas     see ``assemble``                                                   -- from theory text
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import terms as TM
from quire.functions import text as T
from quire.operators import assemble as A
from quire.operators import statements as ST
from quire.operators import templates as TP
from quire.session import cut_lineage


def template_table(terms: DataFrame, types: DataFrame, poly: bool = False) -> DataFrame:
    """P7's shape test -> T1/T2 and T3 -> X12 -> X15: the template table of all searchable terms.

    ``terms`` (theory_file, name, tokens): a theory's facts are those whose name starts with the
    theory's.  ``types`` (symbol, type).
    """
    ts = F.col("tokens")
    prefix = F.concat("theory_file", F.lit("."))
    keep = terms.where(F.startswith("name", prefix) & TP.searchable(ts) & ~TM.bad_name("name"))
    rows = keep.groupBy("theory_file", TM.render(ts).alias("lemma_object")).agg(F.min("name").alias("lemma_name"), F.any_value("tokens").alias("tokens"))
    rows = rows.select("theory_file", "lemma_name", "lemma_object", TM.symbols_of("tokens").alias("symbols"),
                       TM.render(TM.strip_trueprop(TM.abstract("tokens", poly=poly))).alias("template"))
    # two statements may have one name, so rows are told apart by a number
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()), "template-rows")
    typed = A.symbol_types(rows, types, ["row"], "symbols")
    return rows.join(typed, "row").select("theory_file", "lemma_name", "lemma_object", "symbols", "types", "template")


def _read_statements(theories: DataFrame) -> DataFrame:
    """The theorems and definitions of a corpus, written once: cutting text is the dearest step, and several
    branches of a job read them."""
    kinds = T.THEOREM_KINDS + T.DEFINITION_KINDS
    return cut_lineage(ST.kind_filter(ST.split_statements(theories), kinds), "statements")


def lemmas_from_text(theories: DataFrame, templates: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """X1 -> P5/X2/A3 and X3/X6 -> P14/A2 -> J1-J5/P6/J6: the lemma table of a corpus of theory text.

    ``theories`` (theory_file, text [, block]), as the corpus scan reads them; ``templates`` as above.
    """
    if "block" in theories.columns:
        theories = ST.last_block(theories)
    statements = _read_statements(theories)
    return A.assemble_lemmas(templates, ST.theorems(statements), ST.definitions(statements), runs)


def templates_from_statements(theories: DataFrame) -> DataFrame:
    """A template table for theory text whose terms weren't parsed: every named theorem with its
    body as object and template, and the definitions of its file that the body names as symbols."""
    statements = _read_statements(theories)
    thm = ST.theorems(statements).where(F.col("lemma_name").isNotNull())
    bodies = thm.select("theory_file", F.concat("theory_file", F.lit("."), "lemma_name").alias("lemma_name"),
                        F.coalesce(T.split_lemma("stmt")["body"], F.lit("")).alias("lemma_object"))
    words = bodies.select("theory_file", "lemma_name", F.posexplode(F.array_distinct(T.py_split_ws("lemma_object"))).alias("pos", "word"))
    defs = ST.definitions(statements).select("theory_file", F.col("def_name").alias("word"), "def_key").distinct()
    named = words.join(defs, ["theory_file", "word"]).groupBy("theory_file", "lemma_name").agg(
        F.array_sort(F.collect_list(F.struct("pos", "def_key"))).alias("s"))
    out = bodies.join(named, ["theory_file", "lemma_name"], "left")
    return out.select("theory_file", "lemma_name", "lemma_object",
                      F.coalesce(F.col("s.def_key"), F.array().cast("array<string>")).alias("symbols"), F.col("lemma_object").alias("template"))
