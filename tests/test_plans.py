"""Plan shape guards: the per-row jobs plan no shuffle at all, and scans are pruned
and filtered.  (Every registered query is also checked for Cartesian products and
nested-loop joins in tests/test_oracle.py.)"""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
NO_SHUFFLE = ["x1_split_statements", "x8_paths", "r6_truncate_prompts", "h1_fingerprint", "t1_abstract", "u3_predict", "w3_hash_split"]


def _plan(spark, name):
    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_SHUFFLE)
def test_per_row_jobs_do_not_shuffle(spark, name):
    plan = _plan(spark, name)
    assert "Exchange" not in plan, plan


def test_scans_are_pruned_and_filtered(spark):
    plan = _plan(spark, "r7_tokenize_pair")
    assert "IsNotNull(role), EqualTo(role,user)" in plan and "IsNotNull(role), EqualTo(role,assistant)" in plan
    scan = _plan(spark, "e8_template_eval")
    assert "p_brand" not in scan and "p_retailprice" not in scan  # unused part columns are not read
