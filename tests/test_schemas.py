"""The jobs' tables have their fixed schemas."""

import pytest

from quire import schemas
from quire.functions import terms as TM
from quire.operators import assemble as A
from quire.operators import extract as X
from quire.operators import statements as ST
from quire.operators import templates as TP
from quire.plans import driver as D

SF = "/root/testdata/sf0.001"


def test_job_tables(spark):
    theories = D.document_theories(spark, SF).select("theory_file", "text")
    st = ST.split_statements(theories)
    terms = D.part_terms(spark, SF)
    types = D.nation_symbols(spark, SF)
    tables = {
        "theories": theories, "statements": st, "theorems": ST.theorems(st), "definitions": ST.definitions(st),
        "templates": X.template_table(terms.withColumn("theory_file", TM.F.split_part("name", TM.F.lit("."), TM.F.lit(1))), types),
        "lemmas": A.assemble_lemmas(D.order_templates(spark, SF), D.order_theorems(spark, SF), D.part_definitions(spark, SF)),
        "predictions": D.part_predictions(spark, SF),
        "outcomes": TP.rediscovered(terms, TP.candidates(TP.make_templates(terms), types)),
        "terms": terms.select("term_id", "tokens"), "symbol_types": types.drop("sym_pos"),
    }
    assert {n: df.dtypes for n, df in tables.items() if not schemas.matches(df, n)} == {}


def test_conform(spark):
    df = spark.createDataFrame([("s", 1, "x")], "status string, term_id int, more string")
    assert schemas.matches(schemas.conform(df, "outcomes"), "outcomes")
    with pytest.raises(Exception):
        schemas.conform(df.drop("status"), "outcomes")
