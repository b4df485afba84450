"""Traffic summaries: counts, rankings, timelines, deduplication."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.columns import (
    bucket_start,
    round_half_up,
    sorted_set,
    total_bytes,
)
from flowlens.functions.predicates import all_of
from flowlens.schema import DST, END, FIVE_TUPLE, FLOW_ID, SRC, START

MINUTE_MS = 60_000


def _top(df: DataFrame, value: str, limit: int | None, *ties: str) -> DataFrame:
    ranked = df.orderBy(F.col(value).desc_nulls_last(), *ties)
    return ranked if limit is None else ranked.limit(limit)


def attack_distribution(f: DataFrame) -> DataFrame:
    counts = f.groupBy(F.col("Attack").alias("attack")).agg(F.count(F.lit(1)).alias("count"))
    return _top(counts, "count", None, "attack")


def top_talkers(
    f: DataFrame,
    direction: str = "src",
    metric: str = "flows",
    limit: int | None = 10,
    where: Column | None = None,
) -> DataFrame:
    ip = {"src": SRC, "dst": DST}[direction]
    value = {"bytes": F.sum(total_bytes()), "flows": F.count(F.lit(1))}[metric]
    ranked = f.where(all_of(where)).groupBy(F.col(ip).alias("ip")).agg(value.alias("value"))
    return _top(ranked, "value", limit, "ip")


def attack_sources(f: DataFrame, attack: str, limit: int | None = None) -> DataFrame:
    return top_talkers(f, "src", "flows", limit, F.col("Attack") == attack)


def protocol_distribution(f: DataFrame, where: Column | None = None) -> DataFrame:
    counts = (
        f.where(all_of(where))
        .groupBy(F.col("PROTOCOL").alias("protocol"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return _top(counts, "count", None, "protocol")


def time_range(f: DataFrame, end_column: str = END) -> DataFrame:
    return f.agg(F.min(START).alias("start"), F.max(end_column).alias("end"))


def flow_count(f: DataFrame, where: Column | None = None) -> DataFrame:
    return f.where(all_of(where)).agg(F.count(F.lit(1)).alias("cnt"))


def timeline(
    f: DataFrame, minutes: int = 60, where: Column | None = None, ordered: bool = True
) -> DataFrame:
    counts = (
        f.where(all_of(where))
        .groupBy(
            bucket_start(START, minutes * MINUTE_MS).alias("time"), F.col("Attack").alias("attack")
        )
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return counts.orderBy("time", "attack") if ordered else counts


def network_edges(
    f: DataFrame, limit: int | None = 100, where: Column | None = None
) -> DataFrame:
    edges = (
        f.where(all_of(where))
        .groupBy(F.col(SRC).alias("source"), F.col(DST).alias("target"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    return _top(edges, "weight", limit, "source", "target")


def tactic_distribution(f: DataFrame) -> DataFrame:
    counts = (
        f.where(F.col("MITRE_TACTIC") != "")
        .groupBy(F.col("MITRE_TACTIC").alias("attack"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return _top(counts, "count", None, "attack")


def technique_distribution(f: DataFrame, limit: int | None = 20) -> DataFrame:
    counts = (
        f.where(F.col("MITRE_TECHNIQUE") != "")
        .groupBy(F.col("MITRE_TECHNIQUE").alias("technique"), F.col("MITRE_TACTIC").alias("tactic"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return _top(counts, "count", limit, "technique", "tactic")


_SUMS = ("FLOW_DURATION_MILLISECONDS", "IN_BYTES", "OUT_BYTES", "IN_PKTS", "OUT_PKTS")
_MAX_NUMBERS = ("L7_PROTO", "TCP_FLAGS", "MIN_TTL", "MAX_TTL")
_MAX_TEXTS = ("Label", "CONN_STATE", "SERVICE", "COMMUNITY_ID")
_LABELS = ("Attack", "MITRE_TACTIC", "MITRE_TECHNIQUE")
LARGE_SHARE = 0.01  # tuples with this share of all flows are combined before they move
PARTITION_ROWS = 500_000  # flows that one task merges, on average
PAGE_BROADCAST_ROWS = 10_000  # tuples of a page that may be sent to all tasks


def dedup_flows(f: DataFrame, where: Column | None = None) -> DataFrame:
    """One row per five-tuple, labels merged into sorted lists.

    ``Label`` is the greatest text of the group, as in the summary it
    reproduces; ``any_attack`` says whether any flow was an attack.

    One exchange.  Tuples are mostly few flows each: these are moved as they are
    and combined where they arrive, as sorting them by tuple in the reading tasks
    would write them to disk.  Flows of a tuple with a large share of the table
    are combined in each task before they move (:func:`_apart`).  The labels
    travel as one set of the few combinations that occur, from which the three
    lists are read off.
    """
    rows = f.where(all_of(where)).select(*FIVE_TUPLE, START, END, *_SUMS, *_MAX_NUMBERS, *_MAX_TEXTS, *_LABELS)
    return reduce(DataFrame.unionByName, [_merged(part) for part in _apart(rows)])


def _apart(rows: DataFrame) -> list[DataFrame]:
    """Flows laid out by five-tuple, and those of tuples with a large share of the table, if there are any, as they are.

    One pass over the tuple finds the large ones: all with at least ``LARGE_SHARE`` of the rows, and perhaps some more.
    """
    key = F.xxhash64(*FIVE_TUPLE)
    counted = rows.select(key.alias("k"))
    total = counted.count()
    large = counted.freqItems(["k"], LARGE_SHARE).first()[0] if total > PARTITION_ROWS else []
    usual = rows.where(~key.isin(*large)) if large else rows
    spark = rows.sparkSession
    if total > PARTITION_ROWS * int(spark.conf.get("spark.sql.shuffle.partitions")):
        usual = usual.repartition(-(-total // PARTITION_ROWS), *FIVE_TUPLE)
    else:
        usual = usual.repartition(*FIVE_TUPLE)
    return [usual, rows.where(key.isin(*large))] if large else [usual]


def _merged(rows: DataFrame) -> DataFrame:
    technique = F.when(F.col("MITRE_TECHNIQUE") != "", F.col("MITRE_TECHNIQUE")).alias("MITRE_TECHNIQUE")
    rows = rows.withColumn("_labels", F.struct("Attack", "MITRE_TACTIC", technique))
    merged = rows.groupBy(*FIVE_TUPLE).agg(
        F.min(START).alias(START),
        F.max(END).alias(END),
        *[F.sum(c).alias(c) for c in _SUMS],
        *[F.max(c).alias(c) for c in (*_MAX_NUMBERS, *_MAX_TEXTS)],
        F.max(F.coalesce(F.col("Label") == "Attack", F.lit(False))).alias("any_attack"),
        F.collect_set("_labels").alias("_labels"),
    )
    return merged.select(
        *[c for c in merged.columns if c != "_labels"],
        *[_listed(F.col("_labels")[c]).alias(c) for c in ("Attack", "MITRE_TACTIC", "MITRE_TECHNIQUE")],
    )


def _listed(values: Column) -> Column:
    """Distinct values of an array in order as one text; NULL when there is none."""
    known = F.array_sort(F.array_distinct(F.array_compact(values)))
    return F.when(F.size(known) > 0, F.concat_ws(", ", known))


def dedup_page(
    f: DataFrame, where: Column | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """One page of :func:`dedup_flows`, newest first, ties by the tuple.

    Only tuples and start times are laid out to find the tuples of the page; whole flows are read of these alone.
    """
    rows = f.where(all_of(where))
    order = [F.col(START).desc_nulls_last(), *FIVE_TUPLE]
    starts = [part.groupBy(*FIVE_TUPLE).agg(F.min(START).alias(START)) for part in _apart(rows.select(*FIVE_TUPLE, START))]
    ranked = reduce(DataFrame.unionByName, starts).orderBy(*order)
    page = ranked.offset(offset).limit(limit) if offset else ranked.limit(limit)
    wanted = page.select(*[F.col(c).alias(f"_{c}") for c in FIVE_TUPLE])
    wanted = F.broadcast(wanted) if limit <= PAGE_BROADCAST_ROWS else wanted
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in FIVE_TUPLE])
    return _merged(rows.join(wanted, same, "left_semi")).orderBy(*order)


def dedup_count(f: DataFrame, where: Column | None = None, approximate: bool = False) -> DataFrame:
    """Number of distinct five-tuples, tuples holding a NULL included."""
    rows = f.where(all_of(where))
    if approximate:
        key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FIVE_TUPLE])
        return rows.agg(F.approx_count_distinct(key, 0.01).alias("cnt"))
    return rows.select(*FIVE_TUPLE).distinct().agg(F.count(F.lit(1)).alias("cnt"))


def attack_share(f: DataFrame) -> DataFrame:
    """Attack counts with their rounded percent share and the leader marked."""
    counts = f.groupBy(F.col("Attack").alias("attack")).agg(F.count(F.lit(1)).alias("count"))
    # the window sees one row per attack type, not flows
    everything = Window.partitionBy()
    ranked = everything.orderBy(F.col("count").desc(), F.col("attack").asc_nulls_last())
    return counts.select(
        "attack",
        "count",
        round_half_up(100 * F.col("count") / F.sum("count").over(everything)).alias("percent"),
        (F.row_number().over(ranked) == 1).alias("is_top"),
    )


def ip_flows(f: DataFrame, ip: str, limit: int | None = 100) -> DataFrame:
    """Flows with the address at either end, oldest first."""
    rows = f.where((F.col(SRC) == ip) | (F.col(DST) == ip))
    return rows if limit is None else rows.orderBy(START, FLOW_ID).limit(limit)


def _host_aggregates():
    return [
        F.count(F.lit(1)).alias("total_flows"),
        F.min(START).alias("start"),
        F.max(START).alias("end"),
        sorted_set("Attack").alias("attack_types"),
        sorted_set("PROTOCOL").alias("protocols"),
    ]


def investigate_ip(f: DataFrame, ip: str, limit: int = 100) -> dict[str, DataFrame]:
    return {
        "flows": ip_flows(f, ip, limit),
        "summary": ip_flows(f, ip, None).agg(*_host_aggregates()),
    }


def host_summary(f: DataFrame) -> DataFrame:
    """The summary of :func:`investigate_ip` for every address at once."""
    ends = F.explode(F.array_distinct(F.array(SRC, DST))).alias("ip")
    sides = f.select(ends, START, "Attack", "PROTOCOL")
    return sides.groupBy("ip").agg(*_host_aggregates())


def port_scanners(f: DataFrame, min_ports: int = 10, limit: int | None = 20) -> DataFrame:
    ports = f.groupBy(F.col(SRC).alias("ip")).agg(F.count_distinct("L4_DST_PORT").alias("ports"))
    return _top(ports.where(F.col("ports") > min_ports), "ports", limit, "ip")
