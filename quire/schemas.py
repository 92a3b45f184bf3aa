"""One fixed schema per table of the engine."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions.terms import TERM

TABLES: dict[str, str] = {
    "theories": "theory_file string, text string",
    "statements": "theory_file string, pos int, kind string, stmt string",
    "theorems": "theory_file string, lemma_name string, stmt string, pos int",
    "definitions": "def_key string, theory_file string, pos int, def_name string, def_stmt string",
    "templates": "theory_file string, lemma_name string, lemma_object string, symbols array<string>, types array<string>, template string",
    "lemmas": "theory_file string, lemma_name string, lemma_object string, lemma_command string, used_symbols array<string>, "
              "local_symbols array<string>, used_defs array<string>, local_defs array<string>, defs array<string>, template string",
    "predictions": "row_id bigint, strategy string, candidates array<string>",
    "outcomes": "term_id bigint, status string",
    "terms": f"term_id bigint, tokens {TERM}",
    "symbol_types": "symbol string, type string, arity int",
}


@lru_cache(maxsize=None)
def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and with their types; a missing column is an error."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema(table)])


def matches(df: DataFrame, table: str) -> bool:
    """Has ``df`` exactly the table's columns and types?"""
    return df.dtypes == [(f.name, f.dataType.simpleString()) for f in schema(table)]
