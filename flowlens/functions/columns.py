"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.schema import KILL_CHAIN, START


def bucket(column: Column | str, width_ms: int) -> Column:
    """Number of the fixed-width bucket, integer arithmetic throughout."""
    c = F.col(column) if isinstance(column, str) else column
    return F.floor(c / F.lit(width_ms)).cast("long")


def bucket_start(column: Column | str, width_ms: int) -> Column:
    return bucket(column, width_ms) * F.lit(width_ms)


def total_bytes() -> Column:
    return F.col("IN_BYTES") + F.col("OUT_BYTES")


def sorted_set(column: Column | str) -> Column:
    """Distinct non-null values in order.

    Only for columns with a small vocabulary (tactics, protocols, labels); for
    addresses and ports use :func:`smallest_distinct`.
    """
    return F.sort_array(F.collect_set(column))


def smallest_distinct(
    df: DataFrame, keys: list[str], column: str, n: int | None, alias: str
) -> DataFrame:
    """Per key, the ``n`` smallest distinct values of ``column`` (None: all) as a sorted array.

    Duplicates go first (a map-side aggregate), then each task keeps at most
    ``n`` rows per key before the shuffle (window group limit), so a key with
    millions of values never meets in one task.
    """
    distinct = df.where(F.col(column).isNotNull()).select(*keys, column).distinct()
    if n is None:
        return distinct.groupBy(*keys).agg(F.sort_array(F.collect_list(column)).alias(alias))
    w = Window.partitionBy(*keys).orderBy(column)
    return (
        distinct.withColumn("_rank", F.row_number().over(w))
        .where(F.col("_rank") <= n)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(column)).alias(alias))
    )


def order_tactics(tactics: Column | str) -> Column:
    """An array of tactics in kill-chain order, unknown names last (by name)."""
    c = F.col(tactics) if isinstance(tactics, str) else tactics
    chain = F.array(*[F.lit(t) for t in KILL_CHAIN])
    last = len(KILL_CHAIN) + 1
    ranked = F.transform(
        c,
        lambda t: F.struct(
            F.when(F.array_contains(chain, t), F.array_position(chain, t).cast("int"))
            .otherwise(F.lit(last))
            .alias("position"),
            t.alias("name"),
        ),
    )
    return F.transform(F.array_sort(ranked), lambda s: s["name"])


def kill_chain_coverage(tactics: Column | str) -> Column:
    """Percent of the kill chain that the tactics touch."""
    c = F.col(tactics) if isinstance(tactics, str) else tactics
    chain = F.array(*[F.lit(t) for t in KILL_CHAIN])
    return F.lit(100.0) * F.size(F.array_intersect(c, chain)) / F.lit(len(KILL_CHAIN))


def start_time(column: str = START) -> Column:
    return F.timestamp_millis(F.col(column))


def round_half_up(column: Column) -> Column:
    """Nearest integer, halves up."""
    return F.floor(column + F.lit(0.5)).cast("long")


def or_zero(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c, F.lit(0))
