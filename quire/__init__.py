"""quire: build and score datasets of formal statements with Spark.

Every public function is a ``DataFrame -> DataFrame`` job or a ``Column -> Column``
expression built from ``pyspark.sql.functions``; Catalyst plans them, nothing is
collected to the driver.

Sub-packages
------------
sources    readers and writers (corpus scan, datasets, prediction files, caches)
functions  column expressions (text cleaning, distances, names, prompts, terms, hashes)
operators  table jobs (statements, assembly joins, mixing, scoring, templates, batch work)
plans      how the jobs are wired over the driver tables, and the query registry
streaming  incremental scoring of prediction files as they arrive
"""

__version__ = "0.1.0"
