"""Every operator as a runnable query over the driver's tables, with its check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flow_fixture import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Comparable across engines: doubles to six digits, arrays as text."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            c = F.round(c, 6)
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def check(name: str, sql: str | None = None, raw: bool = False):
    """Register a query; ``sql`` goes over the fixture's ``flows`` unless ``raw``."""

    def add(run):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, sf_dir: tidy(run(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql if raw else oracle(sql)
        return run

    return add
