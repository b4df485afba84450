"""Names for protocol numbers and techniques (fixed-size broadcast joins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowlens.schema import l7_table, protocol_table, technique_table


def with_protocol_name(df: DataFrame, column: str = "PROTOCOL") -> DataFrame:
    """Protocol name, or its number as text when it has none."""
    names = protocol_table(df.sparkSession).withColumnRenamed("protocol", "_p")
    return (
        df.join(F.broadcast(names), F.col(column) == F.col("_p"), "left")
        .withColumn(
            "protocol_name", F.coalesce(F.col("protocol_name"), F.col(column).cast("string"))
        )
        .drop("_p")
    )


def with_l7_name(df: DataFrame, column: str = "L7_PROTO") -> DataFrame:
    names = l7_table(df.sparkSession).withColumnRenamed("l7_proto", "_l7")
    return df.join(F.broadcast(names), F.col(column) == F.col("_l7"), "left").drop("_l7")


def with_technique_name(df: DataFrame, column: str = "MITRE_TECHNIQUE") -> DataFrame:
    names = technique_table(df.sparkSession).withColumnRenamed("technique", "_t")
    return df.join(F.broadcast(names), F.col(column) == F.col("_t"), "left").drop("_t")
