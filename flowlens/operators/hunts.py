"""Threat-hunting jobs over all flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowlens.functions.columns import bucket_start, start_time, total_bytes
from flowlens.functions.slices import TimeSlices, with_previous_start
from flowlens.schema import DST, FLOW_ID, SRC, START

MINUTE_MS = 60_000
# Ports named in the hunting questions.
REMOTE_ADMIN_PORTS = (445, 3389, 22, 5985)
KNOWN_BAD_PORTS = (4444, 8080)
LARGE_OUTBOUND = 1_000_000


def remote_admin(f: DataFrame) -> DataFrame:
    return f.where(F.col("L4_DST_PORT").isin(*REMOTE_ADMIN_PORTS))


def large_outbound(
    f: DataFrame, min_bytes: int = LARGE_OUTBOUND, limit: int | None = None
) -> DataFrame:
    rows = f.where(F.col("OUT_BYTES") > min_bytes).orderBy(F.col("OUT_BYTES").desc(), FLOW_ID)
    return rows if limit is None else rows.limit(limit)


def beaconing(
    f: DataFrame,
    min_flows: int = 5,
    max_cv: float = 0.5,
    slices: TimeSlices | None = None,
) -> DataFrame:
    """Connections that repeat at even gaps: gap spread over mean at most ``max_cv``."""
    pair = [SRC, DST, "L4_DST_PORT"]
    rows = f.select(*pair, START, FLOW_ID)
    gap = (F.col(START) - F.col("_previous")).cast("double")
    stats = (
        with_previous_start(rows, pair, "_previous", slices)
        .groupBy(*pair)
        .agg(
            F.count(F.lit(1)).alias("flow_count"),
            F.avg(gap).alias("mean_gap_ms"),
            F.stddev_pop(gap).alias("gap_stddev_ms"),
        )
    )
    cv = F.col("gap_stddev_ms") / F.col("mean_gap_ms")
    enough = (F.col("flow_count") >= min_flows) & (F.col("mean_gap_ms") > 0)
    return stats.where(enough).withColumn("gap_cv", cv).where(
        F.col("gap_cv") <= max_cv
    )


def fan_out(f: DataFrame, minutes: int = 10, min_targets: int = 20) -> DataFrame:
    """Sources that reach many destinations in a short time."""
    return (
        f.groupBy(F.col(SRC).alias("src_ip"), bucket_start(START, minutes * MINUTE_MS).alias("bucket"))
        .agg(F.count_distinct(DST).alias("targets"))
        .where(F.col("targets") >= min_targets)
    )


def tunnelling(f: DataFrame, min_bytes: int = 100_000) -> DataFrame:
    """Pairs that move much data over DNS or ICMP."""
    channel = (
        F.when(F.col("PROTOCOL") == 1, "icmp").when(F.col("L4_DST_PORT") == 53, "dns")
    )
    return (
        f.where((F.col("PROTOCOL") == 1) | (F.col("L4_DST_PORT") == 53))
        .groupBy(F.col(SRC).alias("src_ip"), F.col(DST).alias("dst_ip"), channel.alias("channel"))
        .agg(F.count(F.lit(1)).alias("flow_count"), F.sum(total_bytes()).alias("total_bytes"))
        .where(F.col("total_bytes") >= min_bytes)
    )


def pivot_hosts(f: DataFrame) -> DataFrame:
    """Addresses seen both as source and as destination, with both counts.

    Each side is reduced to one row per address before they meet.
    """
    side = lambda c, name: f.groupBy(F.col(c).alias("ip")).agg(F.count(F.lit(1)).alias(name))
    return side(SRC, "as_source").join(side(DST, "as_destination"), "ip")


def off_hours(
    f: DataFrame, first_hour: int = 8, last_hour: int = 18, min_bytes: int = 100_000
) -> DataFrame:
    """Sources that send much outside [first_hour, last_hour), session time zone."""
    hour = F.hour(start_time())
    return (
        f.where((hour < first_hour) | (hour >= last_hour))
        .groupBy(F.col(SRC).alias("src_ip"))
        .agg(F.count(F.lit(1)).alias("flow_count"), F.sum("OUT_BYTES").alias("out_bytes"))
        .where(F.col("out_bytes") >= min_bytes)
    )


def known_bad_ports(f: DataFrame) -> DataFrame:
    return (
        f.where(F.col("L4_DST_PORT").isin(*KNOWN_BAD_PORTS))
        .groupBy(F.col(SRC).alias("src_ip"), F.col("L4_DST_PORT").alias("port"))
        .agg(
            F.count(F.lit(1)).alias("flow_count"),
            F.count_distinct(DST).alias("targets"),
            F.sum(total_bytes()).alias("total_bytes"),
        )
    )
