"""SQL names for the user functions."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register_functions(spark: SparkSession) -> None:
    """Make ``strhash`` callable from SQL text; an expression, no Python involved."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION strhash(s STRING) RETURNS STRING "
        "RETURN substring(sha2(s, 256), 1, 5)"
    )
