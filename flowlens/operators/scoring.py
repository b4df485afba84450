"""Scores and text for traffic profiles: anomalies, tactics, descriptions.

Profiles come from :func:`flowlens.operators.states.traffic_profiles`, per state
or per host; all rules are column expressions, so they run on any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.selection import upper_medians
from flowlens.session import materialize

# Fixed values of the anomaly score.
ANOMALY_METRICS = ("bytes_ratio", "duration", "pkts_per_sec", "protocol_skew")
MAD_SCALE, Z_CUT, POINTS_PER_Z, MAX_FACTORS = 1.4826, 2.0, 20, 3


def protocol_skew() -> Column:
    away = [F.abs(F.col(c) - F.lit(1 / 3)) for c in ("tcp_pct", "udp_pct", "icmp_pct")]
    return F.greatest(*away)


def _metric_columns() -> dict[str, Column]:
    return {
        "bytes_ratio": F.col("bytes_ratio"),
        "duration": F.col("avg_duration_ms"),
        "pkts_per_sec": F.col("avg_pkts_per_sec"),
        "protocol_skew": protocol_skew(),
    }


def anomaly_scores(profiles: DataFrame, key: str = "state_id") -> DataFrame:
    """Robust outlier score (0-100) of every profile and the metrics behind it."""
    columns = _metric_columns()
    names = list(ANOMALY_METRICS)
    values = materialize(
        profiles.select(key, *[columns[m].cast("double").alias(m) for m in names]), "anomaly"
    )
    middle = upper_medians(values, names)
    away = values.select(
        key,
        *[F.abs(F.col(m) - F.lit(mid)).alias(m) for m, mid in zip(names, middle)],
    )
    spread = upper_medians(away, names)
    z = [
        F.col(m) / F.lit(s * MAD_SCALE) if s else F.lit(0.0) for m, s in zip(names, spread)
    ]
    scored = away.select(key, *[c.alias(m) for m, c in zip(names, z)])
    # largest first; equal ones stay in metric order
    ranked = F.array_sort(
        F.array(
            *[
                F.struct((-F.col(m)).alias("z"), F.lit(i).alias("i"), F.lit(m).alias("name"))
                for i, m in enumerate(names)
            ]
        )
    )
    strong = F.filter(ranked, lambda s: s["z"] < -Z_CUT)
    top = F.greatest(*[F.col(m) for m in names])
    return scored.select(
        key,
        F.least(F.lit(100), F.floor(top * POINTS_PER_Z + F.lit(0.5)).cast("int")).alias(
            "anomaly_score"
        ),
        F.transform(F.slice(strong, 1, MAX_FACTORS), lambda s: s["name"]).alias("anomaly_factors"),
    )


# ------------------------------------------------------------ tactic rules

# Names used in the rules -> profile columns; an absent value counts as 0.
RULE_INPUTS = {
    "no_reply": "no_reply_pct",
    "rejected": "rejected_pct",
    "complete": "conn_complete_pct",
    "duration": "avg_duration_ms",
    "avg_in": "avg_in_bytes",
    "avg_out": "avg_out_bytes",
    "total": "avg_in_bytes + avg_out_bytes",
    "bytes_per_pkt": "avg_bytes_per_pkt",
    "ratio": "bytes_ratio",
    "gap": "avg_inter_flow_gap_ms",
    "pps": "avg_pkts_per_sec",
    "flows": "flow_count",
    "tcp": "tcp_pct",
    "udp": "udp_pct",
    "well_known": "well_known_pct",
    "registered": "registered_pct",
    "ephemeral": "ephemeral_pct",
}

# Per tactic its tests, in order.  A test is a list of
# (condition, score, reason, number shown in the reason); the first condition
# that holds counts.  The last entry is the reason when no test holds.
TRAFFIC_RULES = [
    ("Reconnaissance", [
        [("no_reply > 0.3", 0.35, "High no-reply rate ({}%)", "no_reply * 100"),
         ("no_reply > 0.1", 0.15, "Elevated no-reply rate ({}%)", "no_reply * 100")],
        [("rejected > 0.1", 0.25, "High rejected connection rate ({}%)", "rejected * 100")],
        [("duration < 100", 0.2, "Very short connection duration", None),
         ("duration < 500", 0.1, "Short connection duration", None)],
        [("total < 500", 0.15, "Low bytes per flow", None)],
    ], "No strong reconnaissance indicators"),
    ("Command and Control", [
        [("bytes_per_pkt > 0 AND bytes_per_pkt < 200", 0.3, "Low bytes-per-pkt ({})", "bytes_per_pkt")],
        [("tcp > 0.8", 0.15, "TCP-dominant traffic", None)],
        [("total < 1000", 0.15, "Low volume traffic", None)],
        [("gap > 5000", 0.2, "Regular inter-flow timing (beaconing)", None)],
        [("complete > 0.7", 0.1, "Connections complete successfully", None)],
    ], "No strong C2 indicators"),
    ("Exfiltration", [
        [("avg_out > 10000", 0.3, "High outbound volume ({} bytes)", "avg_out"),
         ("avg_out > 5000", 0.15, "Elevated outbound volume ({} bytes)", "avg_out")],
        [("ratio < 0.5", 0.25, "Outbound-heavy byte ratio", None),
         ("ratio < 1.0", 0.1, "Slightly outbound-heavy ratio", None)],
        [("bytes_per_pkt > 1000", 0.25, "Large packets ({} bytes/pkt)", "bytes_per_pkt")],
    ], "No strong exfiltration indicators"),
    ("Lateral Movement", [
        [("well_known > 0.6", 0.25, "Targeting well-known service ports", None)],
        [("tcp > 0.8", 0.2, "TCP-dominant (service connections)", None)],
        [("complete > 0.5", 0.2, "Moderate-to-high connection completion", None)],
        [("duration > 1000 AND duration < 30000", 0.15, "Medium-duration sessions", None)],
    ], "No strong lateral movement indicators"),
    ("Discovery", [
        [("ephemeral > 0.6", 0.25, "High ephemeral port usage (port scanning)", None)],
        [("duration < 100", 0.2, "Very short-lived connections", None)],
        [("complete < 0.4", 0.2, "Low connection completion rate", None)],
        [("total < 500", 0.15, "Minimal data exchange", None)],
    ], "No strong discovery indicators"),
    ("Initial Access", [
        [("well_known > 0.5", 0.15, "Targeting well-known ports", None)],
        [("bytes_per_pkt > 500", 0.2, "Large packet payloads (potential exploit delivery)", None)],
        [("ratio < 0.5", 0.15, "Outbound-heavy traffic (payload delivery)", None)],
        [("complete > 0.2 AND complete < 0.6", 0.15, "Partial connection success", None)],
        [("rejected > 0.02 AND rejected < 0.15", 0.1, "Some connections rejected", None)],
        [("duration > 200 AND duration < 2000", 0.1,
          "Short-to-medium duration (exploit window)", None)],
    ], "No strong initial access indicators"),
    ("Normal", [
        [("complete > 0.8", 0.3, "High connection completion rate", None),
         ("complete > 0.6", 0.15, "Moderate connection completion", None)],
        [("ratio > 0.5 AND ratio < 5.0", 0.2, "Balanced bidirectional traffic", None)],
        [("well_known > 0.4", 0.15, "Standard port usage", None)],
        [("no_reply < 0.05 AND rejected < 0.05", 0.15, "Low error rates", None)],
        [("duration > 1000", 0.1, "Sustained connections", None)],
    ], "Default classification"),
]

# The older rule set, without reasons.
_SCAN = [
    [("avg_in < 500 AND avg_out < 500", 0.3, None, None)],
    [("duration < 1000", 0.2, None, None)],
    [("pps > 10", 0.2, None, None)],
    [("well_known > 0.5", 0.3, None, None)],
]
SIGNATURE_RULES = [
    ("Reconnaissance", _SCAN, None),
    ("Discovery", _SCAN, None),
    ("Credential Access", [
        [("avg_in < 1000 AND avg_out < 1000", 0.3, None, None)],
        [("well_known > 0.6", 0.3, None, None)],
        [("duration < 5000", 0.2, None, None)],
        [("tcp > 0.9", 0.2, None, None)],
    ], None),
    ("Lateral Movement", [
        [("avg_in > 1000 AND avg_in < 100000", 0.2, None, None)],
        [("well_known > 0.2 AND registered > 0.2", 0.3, None, None)],
        [("duration > 1000 AND duration < 30000", 0.2, None, None)],
        [("tcp > 0.7", 0.3, None, None)],
    ], None),
    ("Command and Control", [
        [("duration > 30000", 0.3, None, None)],
        [("pps < 2", 0.2, None, None)],
        [("ratio > 0.5 AND ratio < 2.0", 0.1, None, None)],
        [("ephemeral > 0.5", 0.2, None, None)],
        [("tcp > 0.8", 0.2, None, None)],
    ], None),
    ("Exfiltration", [
        [("avg_out > 10000", 0.3, None, None)],
        [("ratio < 0.1", 0.3, None, None)],
        [("duration > 10000", 0.2, None, None)],
        [("ephemeral > 0.5", 0.2, None, None)],
    ], None),
    ("Benign", [
        [("ratio > 0.5 AND ratio < 2.0", 0.3, None, None)],
        [("tcp < 0.9 AND udp > 0.1", 0.2, None, None)],
        [("flows > 1000", 0.2, None, None)],
        [("well_known > 0.2 AND registered > 0.2", 0.3, None, None)],
    ], None),
]

RULE_SETS = {"traffic": (TRAFFIC_RULES, "Normal"), "signature": (SIGNATURE_RULES, "Unknown")}


def _first_of(test, pick, default) -> Column:
    """The value of the first alternative whose condition holds."""
    chain = default
    for alternative in reversed(test):
        chain = F.when(F.expr(alternative[0]), pick(alternative)).otherwise(chain)
    return chain


def _reason(alternative) -> Column:
    _, _, text, number = alternative
    if number is None:
        return F.lit(text)
    return F.format_string(text.replace("%", "%%").replace("{}", "%.0f"), F.expr(number))


def suggest_tactics(profiles: DataFrame, key: str = "state_id", rules: str = "traffic") -> DataFrame:
    """The best-scoring tactic of each profile; the first listed wins a tie.

    Scores are rounded to six digits so that the order of additions cannot
    decide between equal sums.
    """
    table, default = RULE_SETS[rules]
    have = set(profiles.columns)
    inputs = profiles.select(
        key,
        *[
            F.coalesce(F.expr(source).cast("double"), F.lit(0.0)).alias(name)
            if all(part in have for part in source.split(" + "))
            else F.lit(0.0).alias(name)
            for name, source in RULE_INPUTS.items()
        ],
    )
    candidates = []
    for place, (tactic, tests, otherwise) in enumerate(table):
        score = sum(
            (_first_of(t, lambda a: F.lit(a[1]), F.lit(0.0)) for t in tests), F.lit(0.0)
        )
        no_text = F.lit(None).cast("string")
        if otherwise is None:
            reasons = F.array().cast("array<string>")
        else:
            found = F.array_compact(F.array(*[_first_of(t, _reason, no_text) for t in tests]))
            reasons = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(otherwise)))
        candidates.append(
            F.struct(
                F.least(F.lit(1.0), F.round(score, 6)).alias("confidence"),
                F.lit(-place).alias("place"),
                F.lit(tactic).alias("tactic"),
                reasons.alias("reasons"),
            )
        )
    best = inputs.select(key, F.array_max(F.array(*candidates)).alias("b"))
    scored = F.col("b.confidence") > 0
    fallback = (
        F.array(F.lit("Default classification"))
        if rules == "traffic"
        else F.array().cast("array<string>")
    )
    return best.select(
        key,
        F.when(scored, F.col("b.tactic")).otherwise(default).alias("tactic"),
        F.when(scored, F.col("b.confidence")).otherwise(0.0).alias("confidence"),
        F.when(scored, F.col("b.reasons")).otherwise(fallback).alias("reasons"),
    )


# -------------------------------------------------------------- description


def _choose(*cases, otherwise=None) -> Column:
    """CASE over SQL conditions; NULL when none holds and there is no other text."""
    chain = F.lit(otherwise).cast("string")
    for condition, text in reversed(cases):
        chain = F.when(F.expr(condition), text).otherwise(chain)
    return chain


# Thresholds and wording of the description, part by part.
_DURATION = ([("avg_duration_ms < 100", "short-duration"),
              ("avg_duration_ms < 10000", "medium-duration")], "long-duration")
_VOLUME = ([("total < 1000", "low-volume"), ("total < 50000", "medium-volume")], "high-volume")
_PROTOCOL = ([
    ("tcp_pct = 0 AND udp_pct = 0 AND icmp_pct = 0", "flows with unknown protocol"),
    ("tcp_pct > 0.8", "TCP flows"),
    ("udp_pct > 0.8", "UDP flows"),
    ("icmp_pct > 0.8", "ICMP flows"),
    ("tcp_pct > 0.4 AND udp_pct > 0.4", "mixed protocol (TCP/UDP) flows"),
    ("tcp_pct > 0.4 AND icmp_pct > 0.2", "mixed protocol (TCP/ICMP) flows"),
    ("udp_pct > 0.4 AND icmp_pct > 0.2", "mixed protocol (UDP/ICMP) flows"),
    ("tcp_pct >= udp_pct AND tcp_pct >= icmp_pct", "predominantly TCP flows"),
    ("udp_pct >= tcp_pct AND udp_pct >= icmp_pct", "predominantly UDP flows"),
], "predominantly ICMP flows")
_DIRECTION = ([
    ("in_share > 0.4 AND in_share < 0.6", "bidirectional flows"),
    ("in_share > 0.7", "inbound-heavy flows"),
    ("out_share > 0.7", "outbound-heavy flows"),
], None)
_PORTS = ([
    ("well_known_pct = 0 AND registered_pct = 0 AND ephemeral_pct = 0", None),
    ("well_known_pct > 0.6", "targeting well-known ports"),
    ("ephemeral_pct > 0.6", "targeting ephemeral ports"),
    ("registered_pct > 0.6", "targeting registered ports"),
], "targeting mixed port ranges")
_OPTIONAL = [
    [("conn_complete_pct > 0.8", "with mostly completed connections"),
     ("conn_complete_pct < 0.3", "with predominantly failed connections")],
    [("no_reply_pct > 0.1", "with significant unanswered connection attempts")],
    [("rejected_pct > 0.05", "with notable connection rejections")],
    [("avg_bytes_per_pkt < 200", "with small packets consistent with signaling"),
     ("avg_bytes_per_pkt > 1000", "with large packets suggesting bulk transfer")],
    [("avg_inter_flow_gap_ms < 500", "in rapid bursts"),
     ("avg_inter_flow_gap_ms > 30000", "with long pauses between flows")],
]


def describe(profiles: DataFrame, key: str = "state_id") -> DataFrame:
    """One sentence per profile."""
    for name in ("conn_complete_pct", "no_reply_pct", "rejected_pct", "avg_bytes_per_pkt",
                 "avg_inter_flow_gap_ms"):
        if name not in profiles.columns:
            profiles = profiles.withColumn(name, F.lit(None).cast("double"))
    total = F.col("avg_in_bytes") + F.col("avg_out_bytes")
    share = lambda c: F.when(total != 0, F.col(c) / total)
    p = profiles.withColumn("total", total).withColumns(
        {"in_share": share("avg_in_bytes"), "out_share": share("avg_out_bytes")}
    )
    parts = [
        _choose(*cases, otherwise=other)
        for cases, other in (_DURATION, _VOLUME, _PROTOCOL, _DIRECTION, _PORTS)
    ] + [_choose(*cases) for cases in _OPTIONAL]
    # concat_ws skips the parts that are NULL
    return p.select(key, F.concat(F.concat_ws(" ", *parts), F.lit(".")).alias("description"))
