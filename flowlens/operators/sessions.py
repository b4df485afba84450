"""Attack sessions, kill-chain phases and idle-gap sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.columns import (
    bucket,
    kill_chain_coverage,
    order_tactics,
    smallest_distinct,
    sorted_set,
    total_bytes,
)
from flowlens.functions.slices import SLICE, TimeSlices, time_slices
from flowlens.functions.predicates import all_of, date_bounds, in_range
from flowlens.operators.filters import session_flows
from flowlens.schema import DATE, DST, END, FLOW_ID, SRC, START, STATE
from flowlens.session import materialize
from flowlens.sources.writers import state_tactics

MINUTE_MS = 60_000
BROADCAST_SESSIONS = 10_000  # a session list cut to this size may be broadcast


def _sessions(
    rows: DataFrame,
    window_minutes: int,
    min_tactics: int,
    limit: int | None,
    techniques: Column,
    id_infix: str,
    targets: bool,
    max_targets: int | None,
    max_ports: int | None,
) -> DataFrame:
    """Sessions of ``rows`` (which carry ``_tactic``) per source and time bucket.

    Small facts are aggregated for all buckets; targets and ports, which can be
    many, are looked up only for the sessions that remain (or not at all).
    """
    rows = rows.withColumn("_bucket", bucket(START, window_minutes * MINUTE_MS))
    key = [SRC, "_bucket"]
    found = (
        rows.groupBy(*key)
        .agg(
            F.min(START).alias("start_time"),
            F.max(END).alias("end_time"),
            F.count(F.lit(1)).alias("flow_count"),
            sorted_set("_tactic").alias("tactics"),
            techniques.alias("techniques"),
            F.sum(total_bytes()).alias("total_bytes"),
        )
        .where(F.size("tactics") >= min_tactics)
    )
    if limit is not None:
        found = found.orderBy(F.col("start_time").desc(), *key).limit(limit)
    listed = []
    if targets:
        members = rows  # with no limit most buckets matter: reduce first, the join selects
        if limit is not None:
            # written once instead of found three times; its time span prunes the scans
            found = materialize(found, "sessions")
            first, last = found.agg(F.min("_bucket"), F.max("_bucket")).first()
            width = window_minutes * MINUTE_MS
            if first is not None:
                members = rows.where(
                    in_range(START, first * width, (last + 1) * width - 1)
                )
            wanted = found.select(*key)
            wanted = F.broadcast(wanted) if limit <= BROADCAST_SESSIONS else wanted
            members = members.join(wanted, key, "left_semi")
        for column, n, alias, kind in (
            (DST, max_targets, "target_ips", "string"),
            ("L4_DST_PORT", max_ports, "target_ports", "bigint"),
        ):
            found = found.join(smallest_distinct(members, key, column, n, alias), key, "left")
            listed.append(F.coalesce(alias, F.array().cast(f"array<{kind}>")).alias(alias))
    return found.select(
        F.concat_ws(id_infix, SRC, F.col("_bucket").cast("string")).alias("session_id"),
        F.col(SRC).alias("src_ip"),
        "start_time",
        "end_time",
        ((F.col("end_time") - F.col("start_time")) / 60000.0).alias("duration_minutes"),
        "flow_count",
        "tactics",
        "techniques",
        *listed,
        "total_bytes",
    ).orderBy(F.col("start_time").desc(), "session_id")


def attack_sessions(
    f: DataFrame,
    window: int = 30,
    min_tactics: int = 2,
    limit: int | None = 50,
    targets: bool = True,
    max_targets: int | None = None,
    max_ports: int | None = None,
) -> DataFrame:
    """Sources that show several tactics inside one time bucket, newest first.

    ``targets=False`` leaves out the target lists, where only the spans matter.
    Targets and ports are listed in full unless ``max_targets`` or ``max_ports`` cuts them.
    With targets and a limit, the few sessions are found (one job) when called.
    """
    rows = f.where((F.col("Label") == "Attack") & (F.col("MITRE_TACTIC") != "")).withColumn(
        "_tactic", F.col("MITRE_TACTIC")
    )
    technique = sorted_set(F.when(F.col("MITRE_TECHNIQUE") != "", F.col("MITRE_TECHNIQUE")))
    return _sessions(rows, window, min_tactics, limit, technique, "-", targets, max_targets, max_ports)


def state_sessions(
    f: DataFrame,
    tactics: dict[int, str],
    window: int = 30,
    min_tactics: int = 2,
    limit: int | None = 50,
    targets: bool = True,
    max_targets: int | None = None,
    max_ports: int | None = None,
) -> DataFrame:
    """Sessions read off the discovered states instead of the labels."""
    names = state_tactics(f.sparkSession, tactics)
    rows = (
        f.where(F.col(STATE).isNotNull())
        .join(F.broadcast(names), STATE, "left")
        .withColumn("_tactic", F.coalesce("tactic", F.lit("Unknown")))
    )
    no_techniques = F.first(F.array().cast("array<string>"))
    return _sessions(rows, window, min_tactics, limit, no_techniques, "-hmm-", targets, max_targets, max_ports)


def _phase_aggregates():
    return [
        F.min(START).alias("phase_start"),
        F.max(END).alias("phase_end"),
        F.count(F.lit(1)).alias("flow_count"),
        F.sum(total_bytes()).alias("bytes_transferred"),
    ]


def _phases(rows: DataFrame, key: list[str], max_targets: int | None) -> DataFrame:
    """Phase rows by ``key`` + tactic + technique with their targets (None: all of them)."""
    rows = rows.select(
        *key,
        F.col("MITRE_TACTIC").alias("tactic"),
        # NULL technique is a group of its own; give it a joinable spelling
        F.coalesce("MITRE_TECHNIQUE", F.lit("\u0000")).alias("technique"),
        START, END, DST, "IN_BYTES", "OUT_BYTES",
    )
    phase = [*key, "tactic", "technique"]
    targets = smallest_distinct(rows, phase, DST, max_targets, "target_ips")
    found = rows.groupBy(*phase).agg(*_phase_aggregates()).join(targets, phase, "left")
    return found.withColumn("technique", F.nullif("technique", F.lit("\u0000"))).withColumn(
        "target_ips", F.coalesce("target_ips", F.array().cast("array<string>"))
    )


def kill_chain_phases(
    f: DataFrame, src_ip: str, start: int, end: int, max_targets: int | None = None
) -> DataFrame:
    """Tactic / technique steps of one source in a time span, in order."""
    rows = session_flows(f, src_ip, start, end).where(F.col("MITRE_TACTIC") != "")
    rows = rows.withColumn("src_ip", F.col(SRC)).withColumn("session_id", F.col(SRC))
    return _phases(rows, ["session_id", "src_ip"], max_targets).orderBy("phase_start", "tactic", "technique")


ROWS_PER_SALT = 1_000_000  # flows of one source and time bucket that one task may join


def hot_buckets(f: DataFrame, width_ms: int, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """(source, _bucket, _salts): the time buckets of sources with more flows than one task should join.

    Counted, not guessed: two columns, summed in each task before the shuffle.
    """
    counts = f.groupBy(F.col(SRC), bucket(START, width_ms).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    salts = F.ceil(F.col("_n") / F.lit(rows_per_salt)).cast("int")
    return counts.where(F.col("_n") > rows_per_salt).select(SRC, "_bucket", salts.alias("_salts"))


def flows_in_sessions(
    f: DataFrame, sessions: DataFrame, window: int = 30, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """Flows inside the time span of a session of their source.

    Range join as an equi join on (source, time bucket).  When called, small jobs find the span of all sessions,
    which prunes the scan, their sources, which thin the flows out before any shuffle while they are few enough
    to be broadcast, and the (source, bucket) pairs with so many flows that they are dealt over several salts, as
    many as their rows need.  A small session list is still broadcast by the optimizer.
    """
    width = window * MINUTE_MS
    sessions = materialize(sessions.select("session_id", "src_ip", "start_time", "end_time"), "spans")
    first, last, sources = sessions.agg(
        F.min("start_time"), F.max("end_time"), F.approx_count_distinct("src_ip")
    ).first()
    latest = None if last is None else (last // width + 1) * width - 1  # the end of the last bucket
    rows = f.where(all_of(in_range(START, first, latest), in_range(END, high=last)))
    if first is not None and DATE in f.columns:
        rows = rows.where(date_bounds(DATE, first, latest))
    if sources <= BROADCAST_SESSIONS:  # a sketch: off by a few per cent
        rows = rows.join(F.broadcast(sessions.select(F.col("src_ip").alias(SRC)).distinct()), SRC, "left_semi")
    listed = sessions.select(
        "session_id",
        F.col("src_ip").alias(SRC),
        F.col("start_time").alias("_from"),
        F.col("end_time").alias("_to"),
        F.explode(
            F.sequence(bucket("start_time", width), bucket("end_time", width))
        ).alias("_bucket"),
    )
    keyed = rows.withColumn("_bucket", bucket(START, width))
    key = [SRC, "_bucket"]
    hot = materialize(hot_buckets(rows, width, rows_per_salt), "hot")
    if hot.limit(1).count():
        hash_ = F.xxhash64(FLOW_ID)
        keyed = keyed.join(hot, key, "left").withColumn("_salt", F.pmod(hash_, F.coalesce("_salts", F.lit(1))).cast("int"))
        last_salt = F.coalesce("_salts", F.lit(1)) - 1
        listed = listed.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last_salt)))
        key = [*key, "_salt"]
    inside = (F.col(START) >= F.col("_from")) & (F.col(END) <= F.col("_to"))
    return (
        keyed.drop("_salts").join(listed.drop("_salts"), key)
        .where(inside)
        .drop("_bucket", "_salt", "_from", "_to")
    )


def kill_chain_phases_all(
    f: DataFrame,
    sessions: DataFrame,
    window: int = 30,
    rows_per_salt: int = ROWS_PER_SALT,
    max_targets: int | None = None,
) -> DataFrame:
    """:func:`kill_chain_phases` for every session of a list in one job."""
    rows = flows_in_sessions(f.where(F.col("MITRE_TACTIC") != ""), sessions, window, rows_per_salt)
    rows = rows.withColumn("src_ip", F.col(SRC))
    return _phases(rows, ["session_id", "src_ip"], max_targets)


def with_ordered_tactics(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("tactics", order_tactics("tactics"))


def with_coverage(sessions: DataFrame) -> DataFrame:
    """Percent of the kill chain each session touches."""
    return sessions.withColumn("kill_chain_coverage", kill_chain_coverage("tactics"))


def _merge(rows: DataFrame, by: list[str], gap_ms: int, first: str, last: str) -> DataFrame:
    """Group rows into runs whose next ``first`` is at most ``gap_ms`` after ``last``."""
    w = Window.partitionBy(*by).orderBy(first, last)
    away = F.col(first) - F.lag(last).over(w)
    return (
        rows.withColumn("_new", F.when(away <= gap_ms, 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(w))
        .drop("_new")
    )


def gap_sessions(
    f: DataFrame, gap: int = 30, by: str = SRC, slices: TimeSlices | None = None
) -> DataFrame:
    """Sessions of a source that end after ``gap`` idle minutes between starts.

    Flows are merged inside (source, time slice) first; what is left per source
    (at most one run per slice plus one per real gap) is merged across slices.
    """
    gap_ms = gap * MINUTE_MS
    slices = slices or time_slices(f)
    tie = [FLOW_ID] if slices.crowded else []
    rows = slices.attach(f.select(by, *tie, START, END, "IN_BYTES", "OUT_BYTES"))
    local = (
        _merge(rows, [by, SLICE], gap_ms, START, START)
        .groupBy(by, SLICE, "_run")
        .agg(
            F.min(START).alias("session_start"),
            F.max(START).alias("last_start"),
            F.max(END).alias("session_end"),
            F.count(F.lit(1)).alias("flow_count"),
            F.sum(total_bytes()).alias("total_bytes"),
        )
        .drop("_run")
    )
    return (
        _merge(local, [by], gap_ms, "session_start", "last_start")
        .groupBy(F.col(by).alias("src_ip"), F.col("_run").alias("session_no"))
        .agg(
            F.min("session_start").alias("session_start"),
            F.max("last_start").alias("last_start"),
            F.max("session_end").alias("session_end"),
            F.sum("flow_count").alias("flow_count"),
            F.sum("total_bytes").alias("total_bytes"),
        )
    )
