"""Sessions, windows, model features, states, scoring, hunts and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window, functions as F

from catalog import check, tactics
from flow_fixture import STATE_TACTICS, flows, state_flows as labelled_flows
from flowlens.operators import features, hunts, scoring, sessions, states
from flowlens.plans import discovery, hmm
from flowlens.schema import FLOW_ID, STATE
from flowlens.session import located, materialize, scratch_path
from flowlens.sources import writers
from flowlens.streaming import jobs

BYTES = "CAST(sum(IN_BYTES + OUT_BYTES) AS BIGINT)"
MS = "FLOW_START_MILLISECONDS"


def _list(column, n=None, where="TRUE"):
    values = f"list_sort(list(DISTINCT {column}) FILTER (WHERE {column} IS NOT NULL AND {where}))"
    cut = f"{values}[:{n}]" if n else values
    return f"coalesce(array_to_string({cut}, '|'), '')"


# ---------------------------------------------------------------- sessions


def _session_sql(tactic, technique, condition, infix, limit="LIMIT 50", columns=None):
    columns = columns or """session_id, src_ip, start_time, end_time,
 round((end_time - start_time) / 60000::DOUBLE, 6) AS duration_minutes, flow_count, tactics, techniques,
 target_ips, target_ports, total_bytes"""
    return f""", tagged AS (SELECT *, {tactic} AS tactic, {MS} // 1800000 AS bucket FROM flows
 WHERE {condition}), sessions AS (
 SELECT IPV4_SRC_ADDR || '{infix}' || CAST(bucket AS VARCHAR) AS session_id, IPV4_SRC_ADDR AS src_ip,
  min({MS}) AS start_time, max(FLOW_END_MILLISECONDS) AS end_time, count(*) AS flow_count,
  {_list('tactic')} AS tactics, {technique} AS techniques, {_list('IPV4_DST_ADDR')} AS target_ips,
  {_list('L4_DST_PORT')} AS target_ports, {BYTES} AS total_bytes
 FROM tagged GROUP BY IPV4_SRC_ADDR, bucket HAVING count(DISTINCT tactic) >= 2
 ORDER BY start_time DESC, IPV4_SRC_ADDR, bucket {limit}) SELECT {columns} FROM sessions"""


ATTACK = "Label = 'Attack' AND MITRE_TACTIC <> ''"
TECHNIQUES = _list("MITRE_TECHNIQUE", where="MITRE_TECHNIQUE <> ''")
STATE_TACTIC = (
    "CASE HMM_STATE WHEN 0 THEN 'Reconnaissance' WHEN 1 THEN 'Credential Access'"
    " WHEN 2 THEN 'Exfiltration' WHEN 3 THEN 'Lateral Movement' ELSE 'Unknown' END"
)


@check("K1_attack_sessions", _session_sql("MITRE_TACTIC", TECHNIQUES, ATTACK, "-"))
def _(spark, sf):
    return sessions.attack_sessions(flows(spark, sf))


@check("K1_attack_sessions_all", _session_sql("MITRE_TACTIC", TECHNIQUES, ATTACK, "-", ""))
def _(spark, sf):
    return sessions.attack_sessions(flows(spark, sf), limit=None)


PHASES = f"""MITRE_TACTIC AS tactic, MITRE_TECHNIQUE AS technique, min({MS}) AS phase_start,
 max(FLOW_END_MILLISECONDS) AS phase_end, count(*) AS flow_count, {BYTES} AS bytes_transferred,
 {_list('IPV4_DST_ADDR')} AS target_ips"""


@check("K2_kill_chain_phases", f"SELECT '10.0.0.5' AS session_id, '10.0.0.5' AS src_ip, {PHASES} FROM flows"
       f" WHERE IPV4_SRC_ADDR = '10.0.0.5' AND {MS} >= 1709300000000"
       " AND FLOW_END_MILLISECONDS <= 1709700000000 AND MITRE_TACTIC <> '' GROUP BY ALL")
def _(spark, sf):
    return sessions.kill_chain_phases(flows(spark, sf), "10.0.0.5", 1709300000000, 1709700000000)


PHASES_ALL = _session_sql("MITRE_TACTIC", "''", ATTACK, "-", "", "*").replace(
    "SELECT * FROM sessions",
    f""", spans AS (SELECT session_id, src_ip, start_time, end_time FROM sessions)
 SELECT s.session_id, s.src_ip, {PHASES} FROM flows f JOIN spans s
 ON f.IPV4_SRC_ADDR = s.src_ip AND f.{MS} >= s.start_time AND f.FLOW_END_MILLISECONDS <= s.end_time
 WHERE f.MITRE_TACTIC <> '' GROUP BY s.session_id, s.src_ip, MITRE_TACTIC, MITRE_TECHNIQUE""",
)


@check("K2_J2_phases_of_all_sessions", PHASES_ALL)
def _(spark, sf):
    f = flows(spark, sf)
    return sessions.kill_chain_phases_all(
        f, sessions.attack_sessions(f, limit=None, targets=False)
    )


FLOWS_IN = _session_sql("MITRE_TACTIC", "''", ATTACK, "-", "", "*").replace(
    "SELECT * FROM sessions",
    f"SELECT s.session_id, f.FLOW_ID FROM flows f JOIN sessions s ON f.IPV4_SRC_ADDR = s.src_ip"
    f" AND f.{MS} >= s.start_time AND f.FLOW_END_MILLISECONDS <= s.end_time",
)


@check("P10_J2_flows_of_all_sessions", FLOWS_IN)
def _(spark, sf):
    f = flows(spark, sf)
    found = sessions.flows_in_sessions(
        f, sessions.attack_sessions(f, limit=None, targets=False)
    )
    return found.select("session_id", FLOW_ID)


@check("K3_state_sessions", _session_sql(STATE_TACTIC, "''", "HMM_STATE IS NOT NULL", "-hmm-"))
def _(spark, sf):
    return sessions.state_sessions(labelled_flows(spark, sf), STATE_TACTICS)


CHAIN = (
    "['Reconnaissance', 'Initial Access', 'Execution', 'Persistence', 'Privilege Escalation',"
    " 'Defense Evasion', 'Credential Access', 'Discovery', 'Lateral Movement', 'Collection',"
    " 'Command and Control', 'Exfiltration', 'Impact']"
)
ORDERED = _session_sql(STATE_TACTIC, "''", "HMM_STATE IS NOT NULL", "-hmm-", "", "*").replace(
    "SELECT * FROM sessions",
    f"""SELECT session_id, array_to_string(list_concat(
 list_filter({CHAIN}, lambda t: list_contains(string_split(tactics, '|'), t)),
 list_filter(string_split(tactics, '|'), lambda t: NOT list_contains({CHAIN}, t))), '|') AS tactics
 FROM sessions""",
)


@check("K4_order_tactics", ORDERED)
def _(spark, sf):
    found = sessions.state_sessions(labelled_flows(spark, sf), STATE_TACTICS, limit=None, targets=False)
    return sessions.with_ordered_tactics(found).select("session_id", "tactics")


@check("K5_coverage", _session_sql("MITRE_TACTIC", "''", ATTACK, "-", "", "*").replace(
    "SELECT * FROM sessions",
    f"""SELECT session_id, round(len(list_filter({CHAIN},
 lambda t: list_contains(string_split(tactics, '|'), t))) * 100::DOUBLE / 13, 6) AS kill_chain_coverage
 FROM sessions"""))
def _(spark, sf):
    found = sessions.with_coverage(sessions.attack_sessions(flows(spark, sf), limit=None))
    return found.select("session_id", "kill_chain_coverage")


GAP_RUNS = f""", marked AS (SELECT *, CASE WHEN {MS} - lag({MS}) OVER w <= 1800000 THEN 0 ELSE 1 END AS fresh
 FROM flows WINDOW w AS (PARTITION BY IPV4_SRC_ADDR ORDER BY {MS}, FLOW_ID)),
 runs AS (SELECT *, sum(fresh) OVER (PARTITION BY IPV4_SRC_ADDR ORDER BY {MS}, FLOW_ID) AS run FROM marked),
 gap AS (SELECT IPV4_SRC_ADDR AS src_ip, CAST(run AS BIGINT) AS session_no, min({MS}) AS session_start,
 max({MS}) AS last_start, max(FLOW_END_MILLISECONDS) AS session_end, count(*) AS flow_count,
 {BYTES} AS total_bytes FROM runs GROUP BY IPV4_SRC_ADDR, run)"""


@check("K6_gap_sessions", GAP_RUNS + " SELECT * FROM gap")
def _(spark, sf):
    return sessions.gap_sessions(flows(spark, sf))


# ----------------------------------------------------------------- windows

GAPS = f"""coalesce({MS} - lag({MS}) OVER (PARTITION BY IPV4_DST_ADDR ORDER BY {MS}, FLOW_ID), 0)"""


@check("W1_inter_flow_gap", f"SELECT FLOW_ID, {GAPS} AS inter_flow_gap_ms FROM flows")
def _(spark, sf):
    f = features.inter_flow_gap(flows(spark, sf))
    return f.select(FLOW_ID, "inter_flow_gap_ms")


@check("W2_gap_of_labelled_flows",
       f"SELECT FLOW_ID, {GAPS} AS inter_flow_gap_ms FROM flows WHERE HMM_STATE IS NOT NULL")
def _(spark, sf):
    f = labelled_flows(spark, sf).where(F.col(STATE).isNotNull())
    return features.inter_flow_gap(f).select(FLOW_ID, "inter_flow_gap_ms")


TRANSITIONS = f"""SELECT HMM_STATE AS from_state, next AS to_state, count(*) AS count FROM (
 SELECT HMM_STATE, lead(HMM_STATE) OVER ({{by}} ORDER BY {MS}, FLOW_ID) AS next
 FROM flows WHERE HMM_STATE IS NOT NULL) WHERE next IS NOT NULL GROUP BY ALL"""


@check("W3_M9_state_transitions", TRANSITIONS.format(by=""))
def _(spark, sf):
    return states.state_transitions(labelled_flows(spark, sf))


@check("M9_state_transitions_per_host", TRANSITIONS.format(by="PARTITION BY IPV4_DST_ADDR"))
def _(spark, sf):
    return states.state_transitions(labelled_flows(spark, sf), scope="host")


# ---------------------------------------------------------------- features

# What the features and profiles need of each flow; the port band is 0, 1 or 2, NULL without a port.
FACTS = f"""SELECT *, IN_BYTES + OUT_BYTES AS bytes, IN_PKTS + OUT_PKTS AS pkts,
 {MS} - coalesce(lag({MS}) OVER earlier, {MS}) AS gap,
 IN_BYTES / (1 + OUT_BYTES) AS ratio, 1e3 * pkts / greatest(1, FLOW_DURATION_MILLISECONDS) AS pace,
 bytes / greatest(1, pkts) AS weight, (L4_DST_PORT > 1023)::INT + (L4_DST_PORT > 49151)::INT AS band,
 coalesce(CONN_STATE, '') AS conn FROM flows {{where}}
 WINDOW earlier AS (PARTITION BY IPV4_DST_ADDR ORDER BY {MS}, FLOW_ID)"""
_LOGS = (
    ("in_bytes", "IN_BYTES"), ("out_bytes", "OUT_BYTES"), ("in_pkts", "IN_PKTS"), ("out_pkts", "OUT_PKTS"),
    ("duration_ms", "FLOW_DURATION_MILLISECONDS"), ("iat_avg", "coalesce(SRC_TO_DST_IAT_AVG, 0)"),
    ("bytes_per_pkt", "weight"), ("inter_flow_gap", "gap"),
)
_FLAGS = (
    ("is_tcp", "PROTOCOL IS NOT DISTINCT FROM 6"), ("is_udp", "PROTOCOL IS NOT DISTINCT FROM 17"),
    ("is_icmp", "PROTOCOL IS NOT DISTINCT FROM 1"), ("is_conn_complete", "conn = 'SF'"),
    ("is_conn_no_reply", "conn = 'S0'"), ("is_conn_rejected", "conn IN ('REJ', 'RSTO', 'RSTR')"),
)
FEATURE_SQL = f"""SELECT FLOW_ID, IPV4_DST_ADDR AS dst_ip, {MS}, ratio AS bytes_ratio, pace AS pkts_per_second,
 coalesce(band, 2) AS port_category, {", ".join(f"ln({c} + 1) AS log1p_{n}" for n, c in _LOGS)},
 {", ".join(f"({c})::INT AS {n}" for n, c in _FLAGS)} FROM ({FACTS.format(where="")})"""
DOUBLES = [
    c for c in features.FEATURES if not c.startswith("is_") and c != "port_category"
]
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in DOUBLES)


@check("M1_flow_features", f", x AS ({FEATURE_SQL}) SELECT * REPLACE ({ROUNDED}) FROM x")
def _(spark, sf):
    return features.flow_features(flows(spark, sf))


@check("M2_J3_eligible", "SELECT FLOW_ID FROM flows WHERE IPV4_DST_ADDR IN"
       " (SELECT IPV4_DST_ADDR FROM flows GROUP BY IPV4_DST_ADDR HAVING count(*) >= 3)")
def _(spark, sf):
    return features.eligible(flows(spark, sf)).select(FLOW_ID)


@check("M2_eligible_busiest", "SELECT FLOW_ID FROM flows WHERE IPV4_DST_ADDR IN"
       " (SELECT IPV4_DST_ADDR FROM flows GROUP BY IPV4_DST_ADDR HAVING count(*) >= 3"
       " ORDER BY count(*) DESC, IPV4_DST_ADDR LIMIT 500)")
def _(spark, sf):
    return features.eligible(flows(spark, sf), max_groups=500).select(FLOW_ID)


SCALED = ", ".join(
    f"round(coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0), 5) + 0 AS {c}"
    for c in features.FEATURES
)


@check("M3_scale", f", x AS ({FEATURE_SQL}) SELECT FLOW_ID, {SCALED} FROM x")
def _(spark, sf):
    scaled = features.scale(features.flow_features(flows(spark, sf)))
    return scaled.select(FLOW_ID, *[F.round(c, 5).alias(c) for c in features.FEATURES])


# ------------------------------------------------------------------- model


def _sequences(spark, sf):
    """All flows of destinations with at least three, laid out and scaled."""
    table = materialize(features.flow_features(flows(spark, sf)), "features", drop_shuffles=True)
    return discovery.training_sequences(table, sample=None)[0]


def _model_rows(spark, model):
    rows = [
        (s, name, float(model.means[s, i]), float(model.variances[s, i]))
        for s in range(model.k)
        for i, name in enumerate(features.FEATURES)
    ]
    return spark.createDataFrame(rows, "state int, feature string, mean double, variance double")


@check("M4_init_model", """SELECT CAST(s AS INT) AS state, CAST(t AS INT) AS next_state, 0.25::DOUBLE AS initial,
 CASE WHEN s = t THEN 0.7::DOUBLE ELSE 0.1::DOUBLE END AS move, true AS floored, true AS centred
 FROM range(4) a(s), range(4) b(t)""")
def _(spark, sf):
    """Start values: uniform, sticky, no variance below the floor, mean of the means (by size) that of all flows."""
    seqs = _sequences(spark, sf)
    model = hmm.init_model(seqs, 4)
    x = seqs.rows.select(*[F.avg(c) for c in features.FEATURES], *[F.min(c) for c in features.FEATURES],
                         *[F.max(c) for c in features.FEATURES]).first()
    seqs.unpersist()
    d = len(features.FEATURES)
    inside = all(lo - 1e-9 <= m <= hi + 1e-9 for row in model.means for m, lo, hi in zip(row, x[d:2 * d], x[2 * d:]))
    rows = [
        (s, t, float(model.initial[s]), round(float(model.transition[s, t]), 9),
         bool((model.variances[s] >= hmm.MIN_VARIANCE).all()), inside)
        for s in range(4) for t in range(4)
    ]
    return spark.createDataFrame(rows, "state int, next_state int, initial double, move double, floored boolean, centred boolean")


@check("M5_fit_hmm")
def _(spark, sf):
    seqs = _sequences(spark, sf)
    fit = hmm.fit_hmm(seqs, 4, max_iter=10, tol=1e-2)
    seqs.unpersist()
    return _model_rows(spark, fit.model)


@check("M6_decode")
def _(spark, sf):
    seqs = _sequences(spark, sf)
    fit = hmm.fit_hmm(seqs, 4, max_iter=3, tol=1e-2)
    return hmm.decode(seqs, fit.model)


@check("M6_select_k")
def _(spark, sf):
    seqs = _sequences(spark, sf)
    best, scores = hmm.select_k(seqs)
    seqs.unpersist()
    rows = [(k, float(s), k == best) for k, s in scores.items()]
    return spark.createDataFrame(rows, "k int, bic double, chosen boolean")


@check("M19_discover_states")
def _(spark, sf):
    found = discovery.discover_states(flows(spark, sf), k=4)
    return (
        found.profiles.join(found.tactics, "state_id")
        .join(found.anomalies, "state_id")
        .join(found.descriptions, "state_id")
    )


# ------------------------------------------------------------------ states


def _top_sql(column, alias, n, condition="TRUE"):
    return f"""SELECT HMM_STATE AS state_id, {column} AS {alias}, count(*) AS count,
 CAST(row_number() OVER (PARTITION BY HMM_STATE ORDER BY count(*) DESC, {column}) AS INT) AS rank FROM flows
 WHERE HMM_STATE IS NOT NULL AND {condition} GROUP BY HMM_STATE, {column} QUALIFY rank <= {n}"""


@check("M7_state_top_sources", _top_sql("IPV4_SRC_ADDR", "ip", 5))
def _(spark, sf):
    return states.state_top_hosts(labelled_flows(spark, sf), "src")


@check("M7_state_top_destinations", _top_sql("IPV4_DST_ADDR", "ip", 5))
def _(spark, sf):
    return states.state_top_hosts(labelled_flows(spark, sf), "dst")


@check("M7_state_conn_states", _top_sql("CONN_STATE", "conn_state", 10, "CONN_STATE IS NOT NULL"))
def _(spark, sf):
    return states.state_conn_states(labelled_flows(spark, sf))


@check("M7_state_ports", _top_sql("L4_DST_PORT", "port", 5))
def _(spark, sf):
    return states.state_ports(labelled_flows(spark, sf))


@check("M7_state_services", _top_sql("SERVICE", "service", 5, "SERVICE <> ''"))
def _(spark, sf):
    return states.state_services(labelled_flows(spark, sf))


@check("M7_state_timeline", f"SELECT HMM_STATE AS state_id, {MS} // 3600000 * 3600000 AS bucket,"
       " count(*) AS count FROM flows WHERE HMM_STATE IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    return states.state_timeline(labelled_flows(spark, sf))


@check("M8_state_samples", """SELECT HMM_STATE, least(20, count(*)) AS cnt, least(20, count(*)) AS last_rank,
 true AS members, true AS repeats FROM flows WHERE HMM_STATE IS NOT NULL GROUP BY HMM_STATE""")
def _(spark, sf):
    """Of every state the asked number of its own flows, ranked without gaps, the same each time."""
    f = labelled_flows(spark, sf)
    sample = states.state_samples(f)
    again = states.state_samples(f.repartition(3)).select(FLOW_ID, F.lit(1).alias("again"))
    known = f.select(FLOW_ID, F.col(STATE).alias("own"))
    joined = sample.join(known, FLOW_ID, "left").join(again, FLOW_ID, "left")
    return joined.groupBy(STATE).agg(
        F.count_distinct(FLOW_ID).alias("cnt"),
        F.max("rank").cast("long").alias("last_rank"),
        F.bool_and(F.col("own").eqNullSafe(F.col(STATE))).alias("members"),
        F.bool_and(F.col("again").isNotNull()).alias("repeats"),
    )


def _detail_sql(part, column, n, condition="TRUE"):
    return f"""(SELECT '{part}' AS part, CAST({column} AS VARCHAR) AS value, count(*) AS count FROM mine
 WHERE {condition} GROUP BY {column} ORDER BY count DESC, {column} LIMIT {n})"""


@check("M7_state_details", ", mine AS (SELECT * FROM flows WHERE HMM_STATE = 1) " + " UNION ALL ".join((
    _detail_sql("src_hosts", "IPV4_SRC_ADDR", 5), _detail_sql("dst_hosts", "IPV4_DST_ADDR", 5),
    _detail_sql("timeline", f"{MS} // 3600000 * 3600000", 1000000),
    _detail_sql("conn_states", "CONN_STATE", 10, "CONN_STATE IS NOT NULL"),
    _detail_sql("ports", "L4_DST_PORT", 5), _detail_sql("services", "SERVICE", 5, "SERVICE <> ''"),
    "(SELECT 'samples' AS part, 'flows' AS value, least(20, count(*)) AS count FROM mine)",
)))
def _(spark, sf):
    """The bundle of one state as one long table."""
    found = states.state_details(labelled_flows(spark, sf), 1)
    columns = {"src_hosts": "ip", "dst_hosts": "ip", "timeline": "bucket", "conn_states": "conn_state",
               "ports": "port", "services": "service"}
    parts = [
        found[part].select(F.lit(part).alias("part"), F.col(c).cast("string").alias("value"), "count")
        for part, c in columns.items()
    ]
    sampled = found["samples"].agg(F.count("*").alias("count"))
    parts.append(sampled.select(F.lit("samples").alias("part"), F.lit("flows").alias("value"), "count"))
    return reduce(lambda a, b: a.unionByName(b), parts)


MATRIX = ", ".join(
    f"CAST(coalesce(sum(count) FILTER (WHERE to_state = {s}), 0) AS BIGINT) AS to_{s}" for s in range(5)
)


@check("M10_transition_matrix",
       f", t AS ({TRANSITIONS.format(by='')}) SELECT from_state, {MATRIX} FROM t GROUP BY from_state")
def _(spark, sf):
    counts = states.state_transitions(labelled_flows(spark, sf))
    return states.transition_matrix(counts, list(range(5)))


@check("M10_transition_probabilities", f", t AS ({TRANSITIONS.format(by='')}) SELECT *,"
       " round(count / sum(count) OVER (PARTITION BY from_state), 6) AS probability FROM t")
def _(spark, sf):
    return states.transition_probabilities(states.state_transitions(labelled_flows(spark, sf)))


@check("M11_state_temporal", f""", t AS (SELECT {MS} // 3600000 * 3600000 AS bucket,
 HMM_STATE AS state_id, count(*) AS count FROM flows WHERE HMM_STATE IS NOT NULL GROUP BY ALL)
 SELECT *, round(count / sum(count) OVER (PARTITION BY bucket), 6) AS share FROM t""")
def _(spark, sf):
    f = states.state_temporal(labelled_flows(spark, sf))
    return f.withColumn("bucket", F.unix_millis("bucket"))


def _profile_sql(by, key):
    means = dict(
        avg_in_bytes="IN_BYTES", avg_out_bytes="OUT_BYTES", bytes_ratio="ratio", avg_pkts_per_sec="pace",
        avg_duration_ms="FLOW_DURATION_MILLISECONDS", avg_bytes_per_pkt="weight", avg_inter_flow_gap_ms="gap",
    )
    bands = ("well_known_pct", "registered_pct", "ephemeral_pct")
    means |= {name: f"(band IS NOT DISTINCT FROM {i})::INT" for i, name in enumerate(bands)}
    shares = ("tcp_pct", "udp_pct", "icmp_pct", "conn_complete_pct", "no_reply_pct", "rejected_pct")
    means |= {name: f"({flag})::INT" for name, (_, flag) in zip(shares, _FLAGS)}
    return f""", facts AS ({FACTS.format(where=f"WHERE {by} IS NOT NULL")}),
 profiles AS (SELECT {by} AS {key}, count(*) AS flow_count,
 {", ".join(f"avg({value}) AS {name}" for name, value in means.items())} FROM facts GROUP BY 1)"""


PROFILE_DOUBLES = (
    "avg_in_bytes avg_out_bytes bytes_ratio avg_duration_ms avg_pkts_per_sec tcp_pct udp_pct icmp_pct"
    " well_known_pct registered_pct ephemeral_pct conn_complete_pct no_reply_pct rejected_pct"
    " avg_bytes_per_pkt avg_inter_flow_gap_ms"
).split()
PROFILE_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in PROFILE_DOUBLES)
STATE_PROFILES = _profile_sql("HMM_STATE", "state_id")
HOST_PROFILES = _profile_sql("IPV4_SRC_ADDR", "entity")


def _profiles(spark, sf):
    return states.traffic_profiles(labelled_flows(spark, sf))


def _host_profiles(spark, sf):
    return states.traffic_profiles(labelled_flows(spark, sf), by="IPV4_SRC_ADDR")


@check("M12_state_profiles", f"{STATE_PROFILES} SELECT * REPLACE ({PROFILE_ROUNDED}),"
       " round(flow_count / sum(flow_count) OVER (), 6) AS flow_share FROM profiles")
def _(spark, sf):
    return states.with_flow_share(_profiles(spark, sf))


@check("M12_source_profiles", f"{HOST_PROFILES} SELECT * REPLACE ({PROFILE_ROUNDED}) FROM profiles")
def _(spark, sf):
    return _host_profiles(spark, sf)


@check("M12_service_profiles",
       f"{_profile_sql('SERVICE', 'entity')} SELECT * REPLACE ({PROFILE_ROUNDED}) FROM profiles")
def _(spark, sf):
    return states.traffic_profiles(labelled_flows(spark, sf), by="SERVICE")


# Names of the exported fields.
EXPORTED = """state_id AS stateId, flow_count AS flowCount, round(avg_in_bytes, 6) AS avgInBytes,
 round(avg_out_bytes, 6) AS avgOutBytes, round(bytes_ratio, 6) AS bytesRatio, round(avg_duration_ms, 6) AS avgDurationMs,
 round(avg_pkts_per_sec, 6) AS avgPktsPerSec, round(tcp_pct, 6) AS tcp, round(udp_pct, 6) AS udp,
 round(icmp_pct, 6) AS icmp, round(well_known_pct, 6) AS wellKnown, round(registered_pct, 6) AS registered,
 round(ephemeral_pct, 6) AS ephemeral"""


@check("S14_export_profiles", f"""{STATE_PROFILES} SELECT {EXPORTED}, CASE state_id WHEN 0 THEN 'Reconnaissance'
 WHEN 1 THEN 'Credential Access' WHEN 2 THEN 'Exfiltration' WHEN 3 THEN 'Lateral Movement'
 ELSE 'Unassigned' END AS tactic FROM profiles""")
def _(spark, sf):
    out = scratch_path(spark, "s14")
    writers.export_profiles(_profiles(spark, sf), STATE_TACTICS, out)
    flat = spark.read.json(out).select("*", "protocolDist.*", "portCategoryDist.*")
    return flat.drop("protocolDist", "portCategoryDist").withColumn(
        "stateId", F.col("stateId").cast("int")
    )


# ----------------------------------------------------------------- scoring


def _anomaly_sql(profiles, key):
    skew = "greatest(abs(tcp_pct - 1.0::DOUBLE / 3), abs(udp_pct - 1.0::DOUBLE / 3), abs(icmp_pct - 1.0::DOUBLE / 3))"
    return f"""{profiles}, metrics AS (
 SELECT {key}, 1 AS m, 'bytes_ratio' AS name, bytes_ratio AS v FROM profiles
 UNION ALL SELECT {key}, 2, 'duration', avg_duration_ms FROM profiles
 UNION ALL SELECT {key}, 3, 'pkts_per_sec', avg_pkts_per_sec FROM profiles
 UNION ALL SELECT {key}, 4, 'protocol_skew', {skew} FROM profiles),
 mid AS (SELECT m, list_sort(list(v))[count(*) // 2 + 1] AS med FROM metrics GROUP BY m),
 away AS (SELECT {key}, m, name, abs(v - med) AS d FROM metrics JOIN mid USING (m)),
 mads AS (SELECT m, list_sort(list(d))[count(*) // 2 + 1] * 1.4826::DOUBLE AS mad FROM away GROUP BY m),
 z AS (SELECT {key}, m, name, CASE WHEN mad = 0 THEN 0 ELSE d / mad END AS z FROM away JOIN mads USING (m))
 SELECT {key}, CAST(least(100, floor(max(z) * 20 + 0.5)) AS INT) AS anomaly_score,
 coalesce(array_to_string((list(name ORDER BY z DESC, m) FILTER (WHERE z > 2))[:3], '|'), '')
 AS anomaly_factors FROM z GROUP BY {key}"""


@check("M13_anomaly_scores", _anomaly_sql(STATE_PROFILES, "state_id"))
def _(spark, sf):
    return scoring.anomaly_scores(_profiles(spark, sf))


@check("M13_anomaly_scores_per_source", _anomaly_sql(HOST_PROFILES, "entity"))
def _(spark, sf):
    return scoring.anomaly_scores(_host_profiles(spark, sf), "entity")


@check("M13_anomaly_scores_narrowed", _anomaly_sql(_profile_sql("L4_DST_PORT", "entity"), "entity"))
def _(spark, sf):
    by_port = states.traffic_profiles(labelled_flows(spark, sf), by="L4_DST_PORT")
    return scoring.anomaly_scores(by_port, "entity")


def _tactics(name, profiles_sql, make, key, rules):
    table, default = {"traffic": (tactics.TRAFFIC, "Normal"), "signature": (tactics.SIGNATURES, "Unknown")}[rules]

    @check(name, tactics.tactic_sql(profiles_sql, key, table, default))
    def _(spark, sf):
        found = scoring.suggest_tactics(make(spark, sf), key, rules)
        return found.withColumn("reasons", F.array_join("reasons", "; "))


_tactics("M14_suggest_tactics", STATE_PROFILES, _profiles, "state_id", "traffic")
_tactics("M14_suggest_tactics_per_source", HOST_PROFILES, _host_profiles, "entity", "traffic")
_tactics("M15_signature_tactics", STATE_PROFILES, _profiles, "state_id", "signature")
_tactics("M15_signature_tactics_per_source", HOST_PROFILES, _host_profiles, "entity", "signature")


def _describe_sql(profiles, key):
    # Thresholds and wording.
    return f"""{profiles}, p AS (SELECT *, avg_in_bytes + avg_out_bytes AS total FROM profiles)
 SELECT {key}, concat_ws(' ',
 CASE WHEN avg_duration_ms < 100 THEN 'short-duration' WHEN avg_duration_ms < 10000 THEN 'medium-duration'
  ELSE 'long-duration' END,
 CASE WHEN total < 1000 THEN 'low-volume' WHEN total < 50000 THEN 'medium-volume' ELSE 'high-volume' END,
 CASE WHEN tcp_pct = 0 AND udp_pct = 0 AND icmp_pct = 0 THEN 'flows with unknown protocol'
  WHEN tcp_pct > 0.8 THEN 'TCP flows' WHEN udp_pct > 0.8 THEN 'UDP flows' WHEN icmp_pct > 0.8 THEN 'ICMP flows'
  WHEN tcp_pct > 0.4 AND udp_pct > 0.4 THEN 'mixed protocol (TCP/UDP) flows'
  WHEN tcp_pct > 0.4 AND icmp_pct > 0.2 THEN 'mixed protocol (TCP/ICMP) flows'
  WHEN udp_pct > 0.4 AND icmp_pct > 0.2 THEN 'mixed protocol (UDP/ICMP) flows'
  WHEN tcp_pct >= udp_pct AND tcp_pct >= icmp_pct THEN 'predominantly TCP flows'
  WHEN udp_pct >= tcp_pct AND udp_pct >= icmp_pct THEN 'predominantly UDP flows'
  ELSE 'predominantly ICMP flows' END,
 CASE WHEN total = 0 THEN NULL WHEN avg_in_bytes / total > 0.4 AND avg_in_bytes / total < 0.6
  THEN 'bidirectional flows' WHEN avg_in_bytes / total > 0.7 THEN 'inbound-heavy flows'
  WHEN avg_out_bytes / total > 0.7 THEN 'outbound-heavy flows' END,
 CASE WHEN well_known_pct = 0 AND registered_pct = 0 AND ephemeral_pct = 0 THEN NULL
  WHEN well_known_pct > 0.6 THEN 'targeting well-known ports'
  WHEN ephemeral_pct > 0.6 THEN 'targeting ephemeral ports'
  WHEN registered_pct > 0.6 THEN 'targeting registered ports' ELSE 'targeting mixed port ranges' END,
 CASE WHEN conn_complete_pct > 0.8 THEN 'with mostly completed connections'
  WHEN conn_complete_pct < 0.3 THEN 'with predominantly failed connections' END,
 CASE WHEN no_reply_pct > 0.1 THEN 'with significant unanswered connection attempts' END,
 CASE WHEN rejected_pct > 0.05 THEN 'with notable connection rejections' END,
 CASE WHEN avg_bytes_per_pkt < 200 THEN 'with small packets consistent with signaling'
  WHEN avg_bytes_per_pkt > 1000 THEN 'with large packets suggesting bulk transfer' END,
 CASE WHEN avg_inter_flow_gap_ms < 500 THEN 'in rapid bursts'
  WHEN avg_inter_flow_gap_ms > 30000 THEN 'with long pauses between flows' END) || '.' AS description FROM p"""


@check("M16_describe", _describe_sql(STATE_PROFILES, "state_id"))
def _(spark, sf):
    return scoring.describe(_profiles(spark, sf))


@check("M16_describe_per_port", _describe_sql(_profile_sql("L4_DST_PORT", "entity"), "entity"))
def _(spark, sf):
    by_port = states.traffic_profiles(labelled_flows(spark, sf), by="L4_DST_PORT")
    return scoring.describe(by_port, "entity")


# The compared columns.
DELTAS = ", ".join(
    f"round((b.{c} - a.{c}) / nullif(a.{c}, 0) * 100, 6) + 0 AS {c}_delta"
    for c in ("avg_in_bytes", "avg_out_bytes", "avg_duration_ms", "avg_pkts_per_sec", "avg_bytes_per_pkt",
              "avg_inter_flow_gap_ms")
)


@check("M17_compare_profiles", f"{STATE_PROFILES} SELECT a.state_id AS a_state_id, b.state_id AS b_state_id,"
       f" {DELTAS} FROM profiles a JOIN profiles b ON a.state_id = 0 AND b.state_id = 3")
def _(spark, sf):
    return states.compare_profiles(_profiles(spark, sf), 0, 3)


@check("M18_rank_profiles", f"""{HOST_PROFILES} SELECT entity, flow_count,
 row_number() OVER (ORDER BY avg_in_bytes + avg_out_bytes DESC, entity) AS place FROM profiles
 WHERE flow_count >= 100 AND entity NOT IN ('10.0.0.1', '10.0.0.2')""")
def _(spark, sf):
    assigned = spark.createDataFrame([("10.0.0.1",), ("10.0.0.2",)], "entity string")
    found = states.rank_profiles(
        _host_profiles(spark, sf), "avgBytes", True, 100, "unassigned", assigned, "entity"
    )
    # the order that the operator gives, as a number
    placed = found.select("entity", "flow_count", F.monotonically_increasing_id().alias("at"))
    place = F.row_number().over(Window.orderBy("at")).cast("long")
    return placed.withColumn("place", place).drop("at")


# ------------------------------------------------------------------- hunts


@check("H1_remote_admin", "SELECT FLOW_ID, L4_DST_PORT FROM flows WHERE L4_DST_PORT IN (445, 3389, 22, 5985)")
def _(spark, sf):
    return hunts.remote_admin(flows(spark, sf)).select(FLOW_ID, "L4_DST_PORT")


@check("H2_large_outbound", "SELECT FLOW_ID, OUT_BYTES FROM flows WHERE OUT_BYTES > 100000")
def _(spark, sf):
    return hunts.large_outbound(flows(spark, sf), 100_000).select(FLOW_ID, "OUT_BYTES")


PAIR = "IPV4_SRC_ADDR, IPV4_DST_ADDR, L4_DST_PORT"


@check("H3_beaconing", f""", g AS (SELECT {PAIR}, CAST({MS} - lag({MS}) OVER (PARTITION BY {PAIR}
 ORDER BY {MS}, FLOW_ID) AS DOUBLE) AS gap FROM flows), s AS (SELECT {PAIR}, count(*) AS flow_count,
 avg(gap) AS mean_gap_ms, stddev_pop(gap) AS gap_stddev_ms FROM g GROUP BY {PAIR} HAVING count(*) >= 3)
 SELECT * REPLACE (round(mean_gap_ms, 6) AS mean_gap_ms, round(gap_stddev_ms, 4) AS gap_stddev_ms),
 round(gap_stddev_ms / mean_gap_ms, 6) AS gap_cv FROM s
 WHERE mean_gap_ms > 0 AND gap_stddev_ms / mean_gap_ms <= 1.0""")
def _(spark, sf):
    found = hunts.beaconing(flows(spark, sf), min_flows=3, max_cv=1.0)
    return found.withColumn("gap_stddev_ms", F.round("gap_stddev_ms", 4))


@check("H4_fan_out", f"SELECT IPV4_SRC_ADDR AS src_ip, {MS} // 3600000 * 3600000 AS bucket,"
       " count(DISTINCT IPV4_DST_ADDR) AS targets FROM flows GROUP BY ALL HAVING targets >= 8")
def _(spark, sf):
    return hunts.fan_out(flows(spark, sf), minutes=60, min_targets=8)


@check("H5_tunnelling", f"""SELECT IPV4_SRC_ADDR AS src_ip, IPV4_DST_ADDR AS dst_ip,
 CASE WHEN PROTOCOL = 1 THEN 'icmp' ELSE 'dns' END AS channel, count(*) AS flow_count,
 {BYTES} AS total_bytes FROM flows WHERE PROTOCOL = 1 OR L4_DST_PORT = 53 GROUP BY ALL
 HAVING total_bytes >= 100000""")
def _(spark, sf):
    return hunts.tunnelling(flows(spark, sf))


@check("H6_pivot_hosts", """, s AS (SELECT IPV4_SRC_ADDR AS ip, count(*) AS as_source FROM flows GROUP BY ALL),
 d AS (SELECT IPV4_DST_ADDR AS ip, count(*) AS as_destination FROM flows GROUP BY ALL)
 SELECT ip, as_source, as_destination FROM s JOIN d USING (ip)""")
def _(spark, sf):
    return hunts.pivot_hosts(flows(spark, sf))


@check("H7_off_hours", f"""SELECT IPV4_SRC_ADDR AS src_ip, count(*) AS flow_count,
 CAST(sum(OUT_BYTES) AS BIGINT) AS out_bytes FROM flows
 WHERE {MS} // 3600000 % 24 < 8 OR {MS} // 3600000 % 24 >= 18 GROUP BY ALL HAVING out_bytes >= 100000""")
def _(spark, sf):
    return hunts.off_hours(flows(spark, sf))


@check("H8_known_bad_ports", f"""SELECT IPV4_SRC_ADDR AS src_ip, L4_DST_PORT AS port, count(*) AS flow_count,
 count(DISTINCT IPV4_DST_ADDR) AS targets, {BYTES} AS total_bytes FROM flows
 WHERE L4_DST_PORT IN (4444, 8080) GROUP BY ALL""")
def _(spark, sf):
    return hunts.known_bad_ports(flows(spark, sf))


# ----------------------------------------------------------------- streams


def _land(f, folder, first, last, of=4):
    """Deliver some quarters of the flows as files; each quarter holds flows of all times.

    Every task that reads the table writes its part of a quarter.  Returns how many files there are now.
    """
    part = F.pmod(F.xxhash64(FLOW_ID), F.lit(of))
    for k in range(first, last):
        f.where(part == k).write.mode("append").parquet(folder)
    place, files = located(f.sparkSession, f"{folder}/*.parquet")
    return len(files.globStatus(place))


def _half(files, quarters):
    """So many files are two quarters, as near as whole files come."""
    return -(-2 * files // quarters)


def _landed(spark, sf, name, quarters=4):
    """The flows as files in a folder, for a file stream, and how many files a batch takes."""
    folder = scratch_path(spark, name)
    f = flows(spark, sf)
    return f.schema, folder, _half(_land(f, folder, 0, quarters), quarters)


@check("X1_ingest_new_files", "SELECT FLOW_ID, IPV4_SRC_ADDR, FLOW_START_MILLISECONDS, Attack FROM flows")
def _(spark, sf):
    schema, folder, files = _landed(spark, sf, "x1-in")
    table, state = scratch_path(spark, "x1"), scratch_path(spark, "x1-state")
    jobs.ingest_new_files(spark, folder, table, state, schema, files_per_batch=files).awaitTermination()
    return jobs.ingested(spark, table).select(
        FLOW_ID, "IPV4_SRC_ADDR", "FLOW_START_MILLISECONDS", "Attack"
    )


def _kept(spark, sf, name, part):
    """A view kept over four quarters in three batches, the last one after the stream had ended."""
    schema, folder, files = _landed(spark, sf, f"{name}-in", 3)
    view, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    for late in (False, True):
        if late:
            _land(flows(spark, sf), folder, 3, 4)
        live = jobs.stream_flows(spark, folder, schema, files_per_batch=files)
        jobs.keep_view(live, part, view, state).awaitTermination()
    return view


@check("X2_live_timeline", f", t AS (SELECT {MS} // 3600000 * 3600000 AS time, Attack AS attack,"
       f" count(*) AS count FROM flows GROUP BY ALL) SELECT * FROM t")
def _(spark, sf):
    return jobs.timeline_view(spark, _kept(spark, sf, "x2", jobs.timeline_part()))


@check("X3_live_gap_sessions", GAP_RUNS + " SELECT src_ip, session_start, last_start, session_end,"
       " flow_count, total_bytes FROM gap")
def _(spark, sf):
    return jobs.sessions_view(spark, _kept(spark, sf, "x3", jobs.sessions_part()))
