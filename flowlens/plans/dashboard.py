"""Dashboard tables, precomputed where nothing is filtered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.functions.predicates import FlowFilter, flow_filter
from flowlens.operators.filters import flow_page
from flowlens.operators.summaries import (
    attack_distribution,
    flow_count,
    timeline,
    top_talkers,
)

SUMMARY_TABLES = ("timeline", "attacks", "top_src", "top_dst", "total")
# Rows kept in the ranking tables and shown of each.
RANKED, SHOWN = 100, 10


def summary_tables(f: DataFrame) -> dict[str, DataFrame]:
    """The five summaries of all flows, as lazy tables."""
    return {
        "timeline": timeline(f),
        "attacks": attack_distribution(f),
        "top_src": top_talkers(f, "src", "flows", RANKED),
        "top_dst": top_talkers(f, "dst", "flows", RANKED),
        "total": flow_count(f),
    }


def build_summaries(f: DataFrame, out: str) -> dict[str, DataFrame]:
    """Write the summaries.

    The flows are scanned three times, one or two columns each; attack counts
    and the total are added up from the hourly timeline already written.
    """
    spark = f.sparkSession
    path = {name: f"{out}/{name}" for name in SUMMARY_TABLES}

    def save(df: DataFrame, name: str) -> DataFrame:
        df.coalesce(1).write.mode("overwrite").parquet(path[name])
        return spark.read.parquet(path[name])

    hourly = timeline(f, ordered=False)
    hourly.write.mode("overwrite").parquet(path["timeline"])
    hourly = spark.read.parquet(path["timeline"])
    attacks = hourly.groupBy("attack").agg(F.sum("count").alias("count"))
    save(attacks, "attacks")
    save(attacks.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("cnt")), "total")
    save(top_talkers(f, "src", "flows", RANKED), "top_src")
    save(top_talkers(f, "dst", "flows", RANKED), "top_dst")
    return read_summaries(spark, out)


def read_summaries(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{out}/{name}") for name in SUMMARY_TABLES}


def dashboard(
    f: DataFrame,
    spec: FlowFilter | None = None,
    summaries: dict[str, DataFrame] | None = None,
    minutes: int = 60,
    limit: int = 1000,
    offset: int = 0,
) -> dict[str, DataFrame]:
    """Every table of the dashboard.

    Without a filter the written summaries answer (at their one-hour buckets);
    with one, each table is a pruned scan of the columns it needs.  Attack
    counts always cover all flows.
    """
    free = spec is None or spec == FlowFilter()
    where = None if free else flow_filter(spec)
    ready = summaries if free and summaries is not None else None

    def ranking(name: str, direction: str) -> DataFrame:
        if ready is None:
            return top_talkers(f, direction, "flows", SHOWN, where)
        return ready[name].orderBy(F.col("value").desc(), "ip").limit(SHOWN)

    hours = ready["timeline"] if ready is not None and minutes == 60 else timeline(
        f, minutes, where, ordered=False
    )
    attacks = summaries["attacks"] if summaries is not None else attack_distribution(f)
    return {
        "timeline": hours.orderBy("time", "attack"),
        "attacks": attacks.orderBy(F.col("count").desc(), "attack"),
        "top_src": ranking("top_src", "src"),
        "top_dst": ranking("top_dst", "dst"),
        "flows": flow_page(f, where, limit, offset),
        "total": ready["total"] if ready is not None else flow_count(f, where),
    }
