"""What each behaviour state looks like: hosts, ports, timing, transitions, profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.columns import bucket_start, or_zero, start_time, total_bytes
from flowlens.functions.slices import SLICE, TimeSlices, gap_sums, time_slices
from flowlens.operators.features import (
    REGISTERED_MAX,
    REJECTED,
    WELL_KNOWN_MAX,
    bytes_per_packet,
    bytes_ratio,
    flag,
    packets_per_second,
)
from flowlens.operators.filters import PREVIEW_COLUMNS
from flowlens.schema import DST, FLOW_ID, SRC, START, STATE

MINUTE_MS = 60_000


def _labelled(f: DataFrame) -> DataFrame:
    return f.where(F.col(STATE).isNotNull())


def top_per_state(f: DataFrame, column: str, n: int, alias: str) -> DataFrame:
    """Most frequent values of a column in every state (ties by value).

    Counts come from a map-side aggregate; each task then keeps ``n`` per state
    before the ranking shuffle.
    """
    counts = f.groupBy(STATE, F.col(column).alias(alias)).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(STATE).orderBy(F.col("count").desc(), F.col(alias).asc_nulls_last())
    return (
        counts.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= n)
        .withColumnRenamed(STATE, "state_id")
    )


def state_top_hosts(f: DataFrame, direction: str = "src", n: int = 5) -> DataFrame:
    return top_per_state(_labelled(f), {"src": SRC, "dst": DST}[direction], n, "ip")


def state_conn_states(f: DataFrame, n: int = 10) -> DataFrame:
    rows = _labelled(f).where(F.col("CONN_STATE").isNotNull())
    return top_per_state(rows, "CONN_STATE", n, "conn_state")


def state_ports(f: DataFrame, n: int = 5) -> DataFrame:
    return top_per_state(_labelled(f), "L4_DST_PORT", n, "port")


def state_services(f: DataFrame, n: int = 5) -> DataFrame:
    return top_per_state(_labelled(f).where(F.col("SERVICE") != ""), "SERVICE", n, "service")


def state_timeline(f: DataFrame, minutes: int = 60) -> DataFrame:
    return (
        _labelled(f)
        .groupBy(
            F.col(STATE).alias("state_id"), bucket_start(START, minutes * MINUTE_MS).alias("bucket")
        )
        .agg(F.count(F.lit(1)).alias("count"))
    )


def state_details(f: DataFrame, state: int) -> dict[str, DataFrame]:
    """Every detail table of one state."""
    rows = f.where(F.col(STATE) == state)
    return {
        "src_hosts": state_top_hosts(rows, "src"),
        "dst_hosts": state_top_hosts(rows, "dst"),
        "timeline": state_timeline(rows),
        "conn_states": state_conn_states(rows),
        "ports": state_ports(rows),
        "services": state_services(rows),
        "samples": state_samples(rows),
    }


def state_samples(f: DataFrame, n: int = 20, seed: int = 42) -> DataFrame:
    """``n`` flows of every state in seeded hash order."""
    w = Window.partitionBy(STATE).orderBy(F.xxhash64(F.col(FLOW_ID), F.lit(seed)), FLOW_ID)
    return (
        _labelled(f)
        .select(STATE, FLOW_ID, *PREVIEW_COLUMNS)
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= n)
    )


def state_transitions(
    f: DataFrame, scope: str = "global", host: str = DST, slices: TimeSlices | None = None
) -> DataFrame:
    """How often one state follows another in time order.

    ``global`` orders all flows together, ``host`` the flows of each host.
    Pairs are counted inside time slices; the pair that crosses from one slice
    to the next non-empty one comes from a table of slice edges.
    """
    rows = _labelled(f)
    slices = slices or time_slices(rows)
    key = [host] if scope == "host" else []
    sliced = slices.attach(rows.select(*key, START, FLOW_ID, F.col(STATE).alias("s")))
    at = F.struct(START, FLOW_ID)
    inner = (
        sliced.withColumn(
            "t", F.lead("s").over(Window.partitionBy(*key, SLICE).orderBy(START, FLOW_ID))
        )
        .where(F.col("t").isNotNull())
        .groupBy(F.col("s").alias("from_state"), F.col("t").alias("to_state"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # one row per (key and) slice: at most 4096 rows in the global case
    edges = sliced.groupBy(*key, SLICE).agg(
        F.min_by("s", at).alias("first"), F.max_by("s", at).alias("last")
    )
    crossing = (
        edges.withColumn("t", F.lead("first").over(Window.partitionBy(*key).orderBy(SLICE)))
        .where(F.col("t").isNotNull())
        .groupBy(F.col("last").alias("from_state"), F.col("t").alias("to_state"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return inner.unionByName(crossing).groupBy("from_state", "to_state").agg(
        F.sum("n").alias("count")
    )


def transition_matrix(transitions: DataFrame, states: list[int] | None = None) -> DataFrame:
    """Counts as a matrix, one row per from-state and one column ``to_<s>`` per state."""
    if states is None:
        rows = transitions.select(
            F.explode(F.array("from_state", "to_state")).alias("s")
        ).distinct().orderBy("s").collect()  # one row per model state
        states = [r.s for r in rows]
    cells = [
        or_zero(F.sum(F.when(F.col("to_state") == s, F.col("count")))).alias(f"to_{s}")
        for s in states
    ]
    return transitions.groupBy("from_state").agg(*cells)


def transition_probabilities(transitions: DataFrame) -> DataFrame:
    total = F.sum("count").over(Window.partitionBy("from_state"))
    return transitions.withColumn("probability", F.col("count") / total)


def state_temporal(f: DataFrame) -> DataFrame:
    """Hourly flow counts per state and their share of the hour."""
    counts = (
        _labelled(f)
        .groupBy(
            F.date_trunc("HOUR", start_time()).alias("bucket"), F.col(STATE).alias("state_id")
        )
        .agg(F.count(F.lit(1)).alias("count"))
    )
    hour = F.sum("count").over(Window.partitionBy("bucket"))
    return counts.withColumn("share", F.col("count") / hour)


def _share(condition: Column) -> Column:
    return F.avg(flag(condition).cast("double"))


def traffic_profiles(
    f: DataFrame, by: str = STATE, slices: TimeSlices | None = None
) -> DataFrame:
    """Seventeen aggregates per state, or per host or service with ``by``.

    Gaps are those between consecutive flows of a destination among the rows
    that have a ``by`` value.  Only what they need is shuffled and ordered.
    """
    key = "state_id" if by == STATE else "entity"
    rows = f.where(F.col(by).isNotNull())
    gaps = gap_sums(rows.select(FLOW_ID, START, DST, F.col(by).alias(key)), [DST], key, "_gaps", slices)
    profile = _plain_profiles(rows.withColumn(key, F.col(by)), key)
    mean = or_zero(F.col("_gaps")) / F.col("flow_count")
    return profile.join(gaps, key, "left").withColumn("avg_inter_flow_gap_ms", mean).drop("_gaps")


def _plain_profiles(flows: DataFrame, key: str) -> DataFrame:
    """The aggregates that need no order."""
    port, conn = F.col("L4_DST_PORT"), F.col("CONN_STATE")
    return flows.groupBy(key).agg(
        F.count(F.lit(1)).alias("flow_count"),
        F.avg("IN_BYTES").alias("avg_in_bytes"),
        F.avg("OUT_BYTES").alias("avg_out_bytes"),
        F.avg(bytes_ratio()).alias("bytes_ratio"),
        F.avg("FLOW_DURATION_MILLISECONDS").alias("avg_duration_ms"),
        F.avg(packets_per_second()).alias("avg_pkts_per_sec"),
        _share(F.col("PROTOCOL") == 6).alias("tcp_pct"),
        _share(F.col("PROTOCOL") == 17).alias("udp_pct"),
        _share(F.col("PROTOCOL") == 1).alias("icmp_pct"),
        _share(port <= WELL_KNOWN_MAX).alias("well_known_pct"),
        _share(port.between(WELL_KNOWN_MAX + 1, REGISTERED_MAX)).alias("registered_pct"),
        _share(port > REGISTERED_MAX).alias("ephemeral_pct"),
        _share(conn == "SF").alias("conn_complete_pct"),
        _share(conn == "S0").alias("no_reply_pct"),
        _share(conn.isin(*REJECTED)).alias("rejected_pct"),
        F.avg(bytes_per_packet()).alias("avg_bytes_per_pkt"),
    )


def with_flow_share(profiles: DataFrame) -> DataFrame:
    """Each profile's part of all profiled flows."""
    total = profiles.agg(F.sum("flow_count")).scalar()
    return profiles.withColumn("flow_share", F.col("flow_count") / total)


COMPARED = (
    "avg_in_bytes", "avg_out_bytes", "avg_duration_ms", "avg_pkts_per_sec",
    "avg_bytes_per_pkt", "avg_inter_flow_gap_ms",
)


def compare_profiles(profiles: DataFrame, a, b, key: str = "state_id") -> DataFrame:
    """Percent change from profile ``a`` to ``b`` per metric; NULL from a zero baseline."""
    def side(k, prefix):
        return profiles.where(F.col(key) == k).select(
            F.lit(1).alias("_pair"),
            F.col(key).alias(f"{prefix}_{key}"),
            *[F.col(c).alias(f"{prefix}_{c}") for c in COMPARED],
        )

    def delta(c):
        base, now = F.col(f"a_{c}"), F.col(f"b_{c}")
        return F.when(base != 0, (now - base) / base * 100).alias(f"{c}_delta")

    pair = side(a, "a").join(F.broadcast(side(b, "b")), "_pair")  # one row each
    return pair.select(f"a_{key}", f"b_{key}", *[delta(c) for c in COMPARED])


# What profiles can be sorted by.
SORT_KEYS = {
    "flowCount": "flow_count",
    "avgBytes": "avg_in_bytes + avg_out_bytes",
    "avgDuration": "avg_duration_ms",
    "pktsPerSec": "avg_pkts_per_sec",
    "bytesRatio": "bytes_ratio",
}


def rank_profiles(
    profiles: DataFrame,
    sort_by: str = "flowCount",
    descending: bool = True,
    min_flow_count: int = 0,
    tactic_filter: str = "all",
    assigned: DataFrame | None = None,
    key: str = "state_id",
) -> DataFrame:
    """Filter profiles by size and by whether a tactic is assigned, then sort.

    ``assigned`` has the ``key`` column of the profiles that have a tactic.
    """
    if min_flow_count > 0:
        profiles = profiles.where(F.col("flow_count") >= min_flow_count)
    if tactic_filter in ("assigned", "unassigned"):
        if assigned is None:
            raise ValueError(f"{tactic_filter!r} needs the table of assigned profiles")
        how = "left_semi" if tactic_filter == "assigned" else "left_anti"
        profiles = profiles.join(assigned.select(key), key, how)
    elif tactic_filter != "all":
        raise ValueError(f"unknown tactic filter {tactic_filter!r}")
    value = F.expr(SORT_KEYS[sort_by])
    return profiles.orderBy(value.desc_nulls_last() if descending else value.asc_nulls_last(), key)
