"""Read-only SQL over the flows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from flowlens.functions.sqlcheck import check_query

# Refused words.
FORBIDDEN = re.compile(
    r"\b(DROP|DELETE|INSERT|UPDATE|ALTER|CREATE|TRUNCATE|EXEC|EXECUTE)\b", re.IGNORECASE
)


def is_read_only(text: str) -> bool:
    """A SELECT (or WITH) that names no changing statement."""
    starts = re.match(r"\s*(SELECT|WITH)\b", text, re.IGNORECASE)
    return bool(starts) and FORBIDDEN.search(text) is None


def query(flows: DataFrame, text: str, max_rows: int | None = None) -> DataFrame:
    """Run a SELECT over the view ``flows``.

    All rows come back unless ``max_rows`` is given.  The parsed text may read
    ``flows`` and its own common table expressions only, and call built-in
    functions that compute on their arguments; a temporary view of that name that
    the caller has is put back, a stored table of that name is left as it is.
    """
    if not is_read_only(text):
        raise ValueError("only SELECT statements are allowed")
    spark = flows.sparkSession
    check_query(spark, text, ("flows",))
    hidden = spark._jsparkSession.sessionState().catalog().getTempView("flows").isDefined()
    theirs = spark.table("flows") if hidden else None
    flows.createOrReplaceTempView("flows")
    try:
        result = spark.sql(text)
    finally:
        if theirs is None:
            spark.catalog.dropTempView("flows")
        else:
            theirs.createOrReplaceTempView("flows")
    return result if max_rows is None else result.limit(max_rows)
