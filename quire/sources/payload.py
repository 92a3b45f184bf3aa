"""The template request payload as JSON, and the stub answer per function name.

The request is ``{"function_names": [...]}``; the answer is one
``"Template for <name>"`` per name.  A payload whose ``function_names`` is not a
list gives an ``error`` value instead of failing the job.  The HTTP server that
served this in the original is not built; the data step is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAYLOAD_SCHEMA = "struct<function_names:array<string>>"


def function_payload(names) -> Column:
    """Names -> ``{"function_names": [...]}``."""
    n = F.col(names) if isinstance(names, str) else names
    return F.to_json(F.struct(n.alias("function_names")))


def template_responses(payload) -> Column:
    """JSON payload -> struct(responses array<string>, error string)."""
    p = F.col(payload) if isinstance(payload, str) else payload
    parsed = F.from_json(p, PAYLOAD_SCHEMA)["function_names"]
    ok = parsed.isNotNull()
    return F.struct(
        F.when(ok, F.transform(parsed, lambda n: F.concat(F.lit("Template for "), n))).alias("responses"),
        F.when(~ok, F.lit("function_names must be a list")).alias("error"),
    )
