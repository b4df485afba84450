"""Model features per flow, eligible groups and scaling."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.columns import or_zero, total_bytes
from flowlens.functions.slices import TimeSlices, with_previous_start
from flowlens.schema import DST, FLOW_ID, START
from flowlens.session import materialize

# Feature names, in the order of the model vector.
FEATURES = (
    "log1p_in_bytes",
    "log1p_out_bytes",
    "log1p_in_pkts",
    "log1p_out_pkts",
    "log1p_duration_ms",
    "log1p_iat_avg",
    "bytes_ratio",
    "pkts_per_second",
    "is_tcp",
    "is_udp",
    "is_icmp",
    "port_category",
    "is_conn_complete",
    "is_conn_no_reply",
    "is_conn_rejected",
    "log1p_bytes_per_pkt",
    "log1p_inter_flow_gap",
)
REJECTED = ("REJ", "RSTO", "RSTR")
WELL_KNOWN_MAX, REGISTERED_MAX = 1023, 49151


def bytes_ratio() -> Column:
    return F.col("IN_BYTES").cast("double") / (F.col("OUT_BYTES") + 1)


def packets_per_second() -> Column:
    seconds = F.greatest(F.col("FLOW_DURATION_MILLISECONDS") / F.lit(1000.0), F.lit(0.001))
    return (F.col("IN_PKTS") + F.col("OUT_PKTS")).cast("double") / seconds


def bytes_per_packet() -> Column:
    return total_bytes().cast("double") / F.greatest(
        F.col("IN_PKTS") + F.col("OUT_PKTS"), F.lit(1)
    )


def flag(condition: Column) -> Column:
    """1 when true, 0 when false or unknown."""
    return F.when(condition, 1).otherwise(0)


def inter_flow_gap(
    f: DataFrame, by: str = DST, alias: str = "inter_flow_gap_ms", slices: TimeSlices | None = None
) -> DataFrame:
    """Milliseconds since the previous flow with the same ``by``; first flow 0."""
    rows = with_previous_start(f, [by], "_previous", slices)
    return rows.withColumn(alias, or_zero(F.col(START) - F.col("_previous"))).drop("_previous")


# columns the features are computed from; anything else is dropped before the shuffle
INPUTS = (
    FLOW_ID, START, DST, "IN_BYTES", "OUT_BYTES", "IN_PKTS", "OUT_PKTS",
    "FLOW_DURATION_MILLISECONDS", "SRC_TO_DST_IAT_AVG", "PROTOCOL", "L4_DST_PORT", "CONN_STATE",
)


def flow_features(
    f: DataFrame, slices: TimeSlices | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The seventeen model features of every flow."""
    rows = inter_flow_gap(f.select(*INPUTS, *keep), slices=slices)
    log = lambda c: F.log1p(F.col(c) if isinstance(c, str) else c)
    port = F.col("L4_DST_PORT")
    return rows.select(
        FLOW_ID,
        F.col(DST).alias("dst_ip"),
        START,
        *keep,
        log("IN_BYTES").alias("log1p_in_bytes"),
        log("OUT_BYTES").alias("log1p_out_bytes"),
        log("IN_PKTS").alias("log1p_in_pkts"),
        log("OUT_PKTS").alias("log1p_out_pkts"),
        log("FLOW_DURATION_MILLISECONDS").alias("log1p_duration_ms"),
        log(or_zero("SRC_TO_DST_IAT_AVG")).alias("log1p_iat_avg"),
        bytes_ratio().alias("bytes_ratio"),
        packets_per_second().alias("pkts_per_second"),
        flag(F.col("PROTOCOL") == 6).alias("is_tcp"),
        flag(F.col("PROTOCOL") == 17).alias("is_udp"),
        flag(F.col("PROTOCOL") == 1).alias("is_icmp"),
        F.when(port <= WELL_KNOWN_MAX, 0)
        .when(port <= REGISTERED_MAX, 1)
        .otherwise(2)
        .alias("port_category"),
        flag(F.col("CONN_STATE") == "SF").alias("is_conn_complete"),
        flag(F.col("CONN_STATE") == "S0").alias("is_conn_no_reply"),
        flag(F.col("CONN_STATE").isin(*REJECTED)).alias("is_conn_rejected"),
        log(bytes_per_packet()).alias("log1p_bytes_per_pkt"),
        log(F.greatest("inter_flow_gap_ms", F.lit(0))).alias("log1p_inter_flow_gap"),
    )


def eligible(
    f: DataFrame, min_flows: int = 3, max_groups: int | None = None, by: str = DST
) -> DataFrame:
    """Flows of destinations with at least ``min_flows`` flows.

    ``max_groups`` keeps the busiest ones (ties by address).  The list of
    destinations is written out first: with its size known, the optimizer sends
    a short list to the flows and shuffles only for a long one.
    """
    counts = f.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_flows)
    if max_groups is not None:
        counts = counts.orderBy(F.col("_n").desc(), by).limit(max_groups)
    kept = materialize(counts.select(by), "eligible")
    return f.join(kept, by, "left_semi").select(*f.columns)


@dataclass
class Scaler:
    """Means and population standard deviations of named columns."""

    columns: list[str]
    mean: list[float]
    std: list[float]

    @classmethod
    def fit(cls, df: DataFrame, columns=FEATURES) -> "Scaler":
        """One aggregate pass; two numbers per column reach the driver."""
        row = df.agg(
            *[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]
        ).first()
        n = len(columns)
        if row[0] is None:
            raise ValueError("cannot fit a scaler on no rows")
        return cls(list(columns), [float(v) for v in row[:n]], [float(v) for v in row[n:]])

    def scaled(self) -> list[Column]:
        """Scaled columns; a constant column becomes 0."""
        return [
            (F.lit(0.0) if s == 0 else (F.col(c) - F.lit(m)) / F.lit(s)).alias(c)
            for c, m, s in zip(self.columns, self.mean, self.std)
        ]

    def transform(self, df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c not in self.columns]
        return df.select(*kept, *self.scaled())

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def from_json(cls, text: str) -> "Scaler":
        return cls(**json.loads(text))


def scale(df: DataFrame, columns=FEATURES) -> DataFrame:
    return Scaler.fit(df, columns).transform(df)
