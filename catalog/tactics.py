"""Check SQL of the tactic rules: ranges of profile values as a table, joined to the profiles.

Written on its own, not from the rule table that the operator runs on, so that a wrong threshold, score or wording on
either side shows.
"""

from __future__ import annotations

# Profile columns that the rules look at.
INPUTS = {
    "no_reply": "no_reply_pct", "rejected": "rejected_pct", "complete": "conn_complete_pct",
    "duration": "avg_duration_ms", "inbound": "avg_in_bytes", "outbound": "avg_out_bytes",
    "bytes": "avg_in_bytes + avg_out_bytes", "packet": "avg_bytes_per_pkt", "ratio": "bytes_ratio",
    "gap": "avg_inter_flow_gap_ms", "pace": "avg_pkts_per_sec", "flows": "flow_count", "tcp": "tcp_pct",
    "udp": "udp_pct", "low_ports": "well_known_pct", "mid_ports": "registered_pct", "high_ports": "ephemeral_pct",
}

# Fixed values of the traffic rules: tactic, test, alternative (the first that holds counts), points, input, above,
# below, reason, factor of the input in the reason.  Ranges are open; an alternative with several ranges needs all.
TRAFFIC = (
    ("Reconnaissance", 1, 1, 0.35, "no_reply", 0.3, None, "High no-reply rate ({}%)", 100),
    ("Reconnaissance", 1, 2, 0.15, "no_reply", 0.1, None, "Elevated no-reply rate ({}%)", 100),
    ("Reconnaissance", 2, 1, 0.25, "rejected", 0.1, None, "High rejected connection rate ({}%)", 100),
    ("Reconnaissance", 3, 1, 0.2, "duration", None, 100, "Very short connection duration", None),
    ("Reconnaissance", 3, 2, 0.1, "duration", None, 500, "Short connection duration", None),
    ("Reconnaissance", 4, 1, 0.15, "bytes", None, 500, "Low bytes per flow", None),
    ("Command and Control", 1, 1, 0.3, "packet", 0, 200, "Low bytes-per-pkt ({})", 1),
    ("Command and Control", 2, 1, 0.15, "tcp", 0.8, None, "TCP-dominant traffic", None),
    ("Command and Control", 3, 1, 0.15, "bytes", None, 1000, "Low volume traffic", None),
    ("Command and Control", 4, 1, 0.2, "gap", 5000, None, "Regular inter-flow timing (beaconing)", None),
    ("Command and Control", 5, 1, 0.1, "complete", 0.7, None, "Connections complete successfully", None),
    ("Exfiltration", 1, 1, 0.3, "outbound", 10000, None, "High outbound volume ({} bytes)", 1),
    ("Exfiltration", 1, 2, 0.15, "outbound", 5000, None, "Elevated outbound volume ({} bytes)", 1),
    ("Exfiltration", 2, 1, 0.25, "ratio", None, 0.5, "Outbound-heavy byte ratio", None),
    ("Exfiltration", 2, 2, 0.1, "ratio", None, 1.0, "Slightly outbound-heavy ratio", None),
    ("Exfiltration", 3, 1, 0.25, "packet", 1000, None, "Large packets ({} bytes/pkt)", 1),
    ("Lateral Movement", 1, 1, 0.25, "low_ports", 0.6, None, "Targeting well-known service ports", None),
    ("Lateral Movement", 2, 1, 0.2, "tcp", 0.8, None, "TCP-dominant (service connections)", None),
    ("Lateral Movement", 3, 1, 0.2, "complete", 0.5, None, "Moderate-to-high connection completion", None),
    ("Lateral Movement", 4, 1, 0.15, "duration", 1000, 30000, "Medium-duration sessions", None),
    ("Discovery", 1, 1, 0.25, "high_ports", 0.6, None, "High ephemeral port usage (port scanning)", None),
    ("Discovery", 2, 1, 0.2, "duration", None, 100, "Very short-lived connections", None),
    ("Discovery", 3, 1, 0.2, "complete", None, 0.4, "Low connection completion rate", None),
    ("Discovery", 4, 1, 0.15, "bytes", None, 500, "Minimal data exchange", None),
    ("Initial Access", 1, 1, 0.15, "low_ports", 0.5, None, "Targeting well-known ports", None),
    ("Initial Access", 2, 1, 0.2, "packet", 500, None, "Large packet payloads (potential exploit delivery)", None),
    ("Initial Access", 3, 1, 0.15, "ratio", None, 0.5, "Outbound-heavy traffic (payload delivery)", None),
    ("Initial Access", 4, 1, 0.15, "complete", 0.2, 0.6, "Partial connection success", None),
    ("Initial Access", 5, 1, 0.1, "rejected", 0.02, 0.15, "Some connections rejected", None),
    ("Initial Access", 6, 1, 0.1, "duration", 200, 2000, "Short-to-medium duration (exploit window)", None),
    ("Normal", 1, 1, 0.3, "complete", 0.8, None, "High connection completion rate", None),
    ("Normal", 1, 2, 0.15, "complete", 0.6, None, "Moderate connection completion", None),
    ("Normal", 2, 1, 0.2, "ratio", 0.5, 5.0, "Balanced bidirectional traffic", None),
    ("Normal", 3, 1, 0.15, "low_ports", 0.4, None, "Standard port usage", None),
    ("Normal", 4, 1, 0.15, "no_reply", None, 0.05, "Low error rates", None),
    ("Normal", 4, 1, 0.15, "rejected", None, 0.05, "Low error rates", None),
    ("Normal", 5, 1, 0.1, "duration", 1000, None, "Sustained connections", None),
)

# Fixed values of the older rules; they give no reasons.
SIGNATURES = (
    ("Reconnaissance", 1, 1, 0.3, "inbound", None, 500, None, None),
    ("Reconnaissance", 1, 1, 0.3, "outbound", None, 500, None, None),
    ("Reconnaissance", 2, 1, 0.2, "duration", None, 1000, None, None),
    ("Reconnaissance", 3, 1, 0.2, "pace", 10, None, None, None),
    ("Reconnaissance", 4, 1, 0.3, "low_ports", 0.5, None, None, None),
    ("Credential Access", 1, 1, 0.3, "inbound", None, 1000, None, None),
    ("Credential Access", 1, 1, 0.3, "outbound", None, 1000, None, None),
    ("Credential Access", 2, 1, 0.3, "low_ports", 0.6, None, None, None),
    ("Credential Access", 3, 1, 0.2, "duration", None, 5000, None, None),
    ("Credential Access", 4, 1, 0.2, "tcp", 0.9, None, None, None),
    ("Lateral Movement", 1, 1, 0.2, "inbound", 1000, 100000, None, None),
    ("Lateral Movement", 2, 1, 0.3, "low_ports", 0.2, None, None, None),
    ("Lateral Movement", 2, 1, 0.3, "mid_ports", 0.2, None, None, None),
    ("Lateral Movement", 3, 1, 0.2, "duration", 1000, 30000, None, None),
    ("Lateral Movement", 4, 1, 0.3, "tcp", 0.7, None, None, None),
    ("Command and Control", 1, 1, 0.3, "duration", 30000, None, None, None),
    ("Command and Control", 2, 1, 0.2, "pace", None, 2, None, None),
    ("Command and Control", 3, 1, 0.1, "ratio", 0.5, 2.0, None, None),
    ("Command and Control", 4, 1, 0.2, "high_ports", 0.5, None, None, None),
    ("Command and Control", 5, 1, 0.2, "tcp", 0.8, None, None, None),
    ("Exfiltration", 1, 1, 0.3, "outbound", 10000, None, None, None),
    ("Exfiltration", 2, 1, 0.3, "ratio", None, 0.1, None, None),
    ("Exfiltration", 3, 1, 0.2, "duration", 10000, None, None, None),
    ("Exfiltration", 4, 1, 0.2, "high_ports", 0.5, None, None, None),
    ("Benign", 1, 1, 0.3, "ratio", 0.5, 2.0, None, None),
    ("Benign", 2, 1, 0.2, "tcp", None, 0.9, None, None),
    ("Benign", 2, 1, 0.2, "udp", 0.1, None, None, None),
    ("Benign", 3, 1, 0.2, "flows", 1000, None, None, None),
    ("Benign", 4, 1, 0.3, "low_ports", 0.2, None, None, None),
    ("Benign", 4, 1, 0.3, "mid_ports", 0.2, None, None, None),
)


def _literal(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else f"{value}::DOUBLE"


def tactic_sql(profiles: str, key: str, rules: tuple, default: str) -> str:
    """Tactic, confidence and reasons of each profile: points of ranges that hold, added up by tactic."""
    order = list(dict.fromkeys(r[0] for r in rules))
    ranges = ", ".join(
        f"({order.index(t)}, '{t}', {test}, {alt}, {', '.join(map(_literal, rest))})" for t, test, alt, *rest in rules
    )
    values = ", ".join(f"coalesce(CAST({source} AS DOUBLE), 0.0::DOUBLE) AS {name}" for name, source in INPUTS.items())
    return f"""{profiles},
 wide AS (SELECT {key}, {values} FROM profiles),
 vals AS (UNPIVOT wide ON {", ".join(INPUTS)} INTO NAME input VALUE v),
 ranges AS (SELECT * FROM (VALUES {ranges}) AS r(place, tactic, test, alt, points, input, above, below, reason, factor)),
 alts AS (SELECT {key}, place, tactic, test, alt, points,
   any_value(replace(reason, '{{}}', CAST(CAST(floor(v * coalesce(factor, 1) + 0.5) AS BIGINT) AS VARCHAR))) AS reason,
   bool_and((above IS NULL OR v > above) AND (below IS NULL OR v < below)) AS holds
  FROM ranges JOIN vals USING (input) GROUP BY {key}, place, tactic, test, alt, points),
 firsts AS (SELECT * FROM alts WHERE holds
  QUALIFY row_number() OVER (PARTITION BY {key}, place, test ORDER BY alt) = 1),
 sums AS (SELECT {key}, place, tactic, least(1.0::DOUBLE, round(sum(points), 6)) AS confidence,
   string_agg(reason, '; ' ORDER BY test) AS reasons FROM firsts GROUP BY {key}, place, tactic),
 best AS (SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY confidence DESC, place) = 1)
 SELECT {key}, coalesce(tactic, '{default}') AS tactic, coalesce(confidence, 0.0::DOUBLE) AS confidence,
  coalesce(reasons, {"'Default classification'" if rules is TRAFFIC else "''"}) AS reasons
 FROM (SELECT {key} FROM profiles) LEFT JOIN best USING ({key})"""
