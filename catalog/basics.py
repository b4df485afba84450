"""Sources, predicates, pages and summaries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from catalog import check
from flow_fixture import flows, state_flows as labelled_flows
from flowlens.functions import predicates as p
from flowlens.operators import filters, lookups, summaries
from flowlens.plans import dashboard as boards
from flowlens.plans.sqlapi import query
from flowlens.schema import FLOW_ID, STATE
from flowlens.session import scratch_path
from flowlens.sources import readers, samples, writers

ALL = """SELECT FLOW_ID, FLOW_START_MILLISECONDS, FLOW_END_MILLISECONDS, FLOW_DURATION_MILLISECONDS,
 IPV4_SRC_ADDR, L4_SRC_PORT, IPV4_DST_ADDR, L4_DST_PORT, PROTOCOL, L7_PROTO, IN_BYTES, IN_PKTS,
 OUT_BYTES, OUT_PKTS, TCP_FLAGS, MIN_TTL, MAX_TTL, SRC_TO_DST_IAT_AVG, Label, Attack, MITRE_TACTIC,
 MITRE_TECHNIQUE, CONN_STATE, SERVICE, COMMUNITY_ID FROM flows"""
COUNT = "SELECT count(*) AS cnt FROM flows WHERE "


# ------------------------------------------------------------------ sources


@check("S1_read_parquet", ALL)
def _(spark, sf):
    path = scratch_path(spark, "s1")
    flows(spark, sf).write.parquet(path)
    return readers.read_flows(spark, path)


def _csv(spark, sf, name):
    path = scratch_path(spark, name) + ".csv"
    flows(spark, sf).write.option("header", True).csv(path)
    return path


@check("S2_read_csv", ALL)
def _(spark, sf):
    return readers.read_flows(spark, _csv(spark, sf, "s2"))


@check(
    "S4_map_columns",
    "SELECT FLOW_ID, IPV4_SRC_ADDR, IPV4_DST_ADDR, L4_SRC_PORT, L4_DST_PORT, PROTOCOL, IN_BYTES,"
    " OUT_BYTES, IN_PKTS, OUT_PKTS, Attack, Label, FLOW_START_MILLISECONDS FROM flows",
)
def _(spark, sf):
    foreign = flows(spark, sf).selectExpr(
        "FLOW_ID", "IPV4_SRC_ADDR AS SA", "IPV4_DST_ADDR AS da", "L4_SRC_PORT AS sp",
        "L4_DST_PORT AS dp", "PROTOCOL AS Pr", "IN_BYTES AS ibyt", "OUT_BYTES AS obyt",
        "IN_PKTS AS ipkt", "OUT_PKTS AS opkt", "Attack AS category", "Label AS is_attack",
        "FLOW_START_MILLISECONDS AS start_ms",
    )
    return readers.map_columns(foreign)


@check("S5_row_count_probe", "SELECT count(*) AS cnt FROM flows")
def _(spark, sf):
    path = scratch_path(spark, "s5")
    flows(spark, sf).write.parquet(path)
    return spark.createDataFrame([(readers.probe(spark, path),)], "cnt long")


DATED = ALL.replace(
    " FROM flows",
    ", CAST(CAST(epoch_ms(FLOW_START_MILLISECONDS) AS DATE) AS VARCHAR) AS flow_date FROM flows",
)


def _dated(table):
    return table.withColumn("flow_date", F.col("flow_date").cast("string"))


@check("S6_load_table", DATED)
def _(spark, sf):
    source, table = scratch_path(spark, "s6-in"), scratch_path(spark, "s6")
    flows(spark, sf).write.parquet(source)
    return _dated(writers.load(spark, source, table))


@check("S7_append_chunks", DATED)
def _(spark, sf):
    f = flows(spark, sf)
    first, second, table = (scratch_path(spark, f"s7-{n}") for n in ("a", "b", "table"))
    f.where("Label = 'Attack'").write.parquet(first)
    f.where("Label <> 'Attack'").write.parquet(second)
    writers.load(spark, first, table)
    return _dated(writers.append(spark, second, table))


@check("S8_csv_to_parquet", ALL)
def _(spark, sf):
    out = scratch_path(spark, "s8")
    writers.to_parquet(spark, _csv(spark, sf, "s8-in"), out)
    return spark.read.parquet(out)


ZEEK_LOG = """SELECT FLOW_ID, IPV4_SRC_ADDR AS src_ip_zeek, IPV4_DST_ADDR AS dest_ip_zeek,
 CASE PROTOCOL WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' ELSE 'gre' END AS proto,
 CONN_STATE AS conn_state, SERVICE AS service, CASE WHEN SERVICE = 'ssh' THEN NULL ELSE 'ShAD' END AS history,
 COMMUNITY_ID AS community_id, L4_SRC_PORT AS src_port_zeek,
 CASE WHEN PROTOCOL = 1 THEN NULL ELSE L4_DST_PORT END AS dest_port_zeek,
 CASE WHEN CONN_STATE = 'S0' THEN NULL ELSE IN_BYTES END AS orig_bytes,
 CASE WHEN CONN_STATE = 'S0' THEN NULL ELSE OUT_BYTES END AS resp_bytes,
 IN_PKTS AS orig_pkts, CASE WHEN CONN_STATE = 'REJ' THEN NULL ELSE OUT_PKTS END AS resp_pkts,
 CAST(FLOW_START_MILLISECONDS AS DOUBLE) / CAST(1000 AS DOUBLE) AS ts,
 CASE WHEN FLOW_DURATION_MILLISECONDS = 0 THEN NULL
      ELSE CAST(FLOW_DURATION_MILLISECONDS AS DOUBLE) / CAST(1000 AS DOUBLE) END AS duration,
 CASE WHEN MITRE_TACTIC IS NULL THEN 'Duplicate' WHEN CONN_STATE IS NULL THEN NULL
      WHEN Label = 'Attack' THEN 'True' ELSE 'False' END AS label_binary,
 CASE WHEN MITRE_TACTIC IS NULL THEN 'Duplicate' WHEN MITRE_TACTIC = '' THEN 'none'
      ELSE MITRE_TACTIC END AS label_tactic,
 CASE WHEN MITRE_TECHNIQUE IS NULL THEN 'Duplicate' WHEN MITRE_TECHNIQUE = '' THEN 'none'
      ELSE MITRE_TECHNIQUE END AS label_technique FROM {flows}"""
ZEEK_FLOWS = """SELECT FLOW_ID, src_ip_zeek AS IPV4_SRC_ADDR, dest_ip_zeek AS IPV4_DST_ADDR,
 src_port_zeek AS L4_SRC_PORT, coalesce(dest_port_zeek, 0) AS L4_DST_PORT,
 CAST(CASE proto WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 WHEN 'icmp' THEN 1 ELSE 0 END AS INT) AS PROTOCOL,
 coalesce(orig_bytes, 0) AS IN_BYTES, coalesce(resp_bytes, 0) AS OUT_BYTES,
 orig_pkts AS IN_PKTS, coalesce(resp_pkts, 0) AS OUT_PKTS,
 CAST(trunc(ts * 1000) AS BIGINT) AS FLOW_START_MILLISECONDS,
 CAST(trunc((ts + coalesce(duration, 0)) * 1000) AS BIGINT) AS FLOW_END_MILLISECONDS,
 CAST(trunc(coalesce(duration, 0) * 1000) AS BIGINT) AS FLOW_DURATION_MILLISECONDS,
 CASE label_binary WHEN 'True' THEN 'Attack' WHEN 'Duplicate' THEN 'Attack' ELSE 'Benign' END AS Label,
 CASE label_tactic WHEN 'none' THEN 'Benign' WHEN 'Duplicate' THEN 'Unknown' ELSE label_tactic END AS Attack,
 CASE WHEN label_tactic IN ('none', 'Duplicate') THEN '' ELSE label_tactic END AS MITRE_TACTIC,
 CASE WHEN label_technique IN ('none', 'Duplicate') THEN '' ELSE label_technique END AS MITRE_TECHNIQUE,
 conn_state AS CONN_STATE, coalesce(service, '') AS SERVICE, coalesce(history, '') AS HISTORY,
 community_id AS COMMUNITY_ID, CAST(64 AS BIGINT) AS MAX_TTL, CAST(1500 AS BIGINT) AS MAX_IP_PKT_LEN,
 CAST(0 AS BIGINT) AS DNS_QUERY_ID, CAST(0 AS DOUBLE) AS SRC_TO_DST_IAT_AVG FROM zeek"""
ZEEK_COLUMNS = [
    "FLOW_ID", "IPV4_SRC_ADDR", "IPV4_DST_ADDR", "L4_SRC_PORT", "L4_DST_PORT", "PROTOCOL",
    "IN_BYTES", "OUT_BYTES", "IN_PKTS", "OUT_PKTS", "FLOW_START_MILLISECONDS",
    "FLOW_END_MILLISECONDS", "FLOW_DURATION_MILLISECONDS", "Label", "Attack", "MITRE_TACTIC",
    "MITRE_TECHNIQUE", "CONN_STATE", "SERVICE", "HISTORY", "COMMUNITY_ID", "MAX_TTL",
    "MAX_IP_PKT_LEN", "DNS_QUERY_ID", "SRC_TO_DST_IAT_AVG",
]
ZEEK_ORACLE = f", zeek AS ({ZEEK_LOG.format(flows='flows')}) {ZEEK_FLOWS}"


def _zeek_log(spark, sf):
    return spark.sql(ZEEK_LOG, flows=flows(spark, sf))


@check("S9_from_zeek", ZEEK_ORACLE)
def _(spark, sf):
    return readers.from_zeek(_zeek_log(spark, sf)).select(*ZEEK_COLUMNS)


@check("S10_concat_weeks", ZEEK_ORACLE)
def _(spark, sf):
    log = _zeek_log(spark, sf)
    place = scratch_path(spark, "s10")
    week = F.when(F.col("proto") == "tcp", 1).otherwise(2)
    log.withColumn("week", week).write.partitionBy("week").parquet(place)  # both weeks from one pass
    return readers.read_zeek(spark, [f"{place}/week={n}" for n in (1, 2)]).select(*ZEEK_COLUMNS)


@check(
    "S11_stratified_sample",
    ", g AS (SELECT Attack, count(*) AS n FROM flows GROUP BY Attack)"
    " SELECT Attack, CAST(least(n, floor(6000 * n / (SELECT sum(n) FROM g))) AS BIGINT) AS cnt FROM g",
)
def _(spark, sf):
    sample = samples.stratified_sample(flows(spark, sf), target=6000)
    return sample.groupBy("Attack").agg(F.count_distinct(FLOW_ID).alias("cnt"))


def _members(f, sample, by):
    """Rows of a sample by group: how many are flows of the table, each counted once."""
    known = sample.join(f.select(FLOW_ID, F.col(by).alias("_by")), FLOW_ID)
    same = F.col(by).eqNullSafe(F.col("_by"))
    return known.groupBy(by).agg(F.count_distinct(F.when(same, F.col(FLOW_ID))).alias("cnt"), F.count("*").alias("rows"))


@check(
    "S11_stratified_sample_fast",
    ", g AS (SELECT Attack, count(*) AS n, (SELECT count(*) FROM flows) AS total FROM flows GROUP BY Attack)"
    " SELECT Attack, n, true AS near_share, true AS members FROM g WHERE 6000 * n >= 20 * total",
)
def _(spark, sf):
    """Groups that expect 20 rows or more hold about that many, within five standard deviations."""
    f = flows(spark, sf)
    sizes = f.groupBy("Attack").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))
    got = _members(f, samples.fast_stratified_sample(f, target=6000), "Attack")
    expected = F.lit(6000) * F.col("n") / F.col("total")
    near = F.abs(F.coalesce("cnt", F.lit(0)) - expected) <= 5 * F.sqrt(expected)
    return sizes.where("6000 * n >= 20 * total").join(got, "Attack", "left").select(
        "Attack", "n", near.alias("near_share"), (F.col("cnt") == F.col("rows")).alias("members")
    )


@check("S12_random_sample", "SELECT least(1000, count(*)) AS cnt, least(1000, count(*)) AS \"rows\", true AS repeats FROM flows")
def _(spark, sf):
    """A sample of the asked size, of flows of the table, the same each time."""
    f = flows(spark, sf)
    one, other = samples.random_sample(f, 1000), samples.random_sample(f.repartition(3), 1000)
    total = _members(f, one, "Attack").agg(F.sum("cnt").alias("cnt"), F.sum("rows").alias("rows"))
    again = one.join(other.select(FLOW_ID), FLOW_ID, "left_anti").agg((F.count("*") == 0).alias("repeats"))
    return total.join(again)


HOUR = "FLOW_START_MILLISECONDS // 3600000 * 3600000"
SUMMARY_SQL = {
    "timeline": f"SELECT {HOUR} AS time, Attack AS attack, count(*) AS count FROM flows GROUP BY ALL",
    "attacks": "SELECT Attack AS attack, count(*) AS count FROM flows GROUP BY ALL",
    "top_src": "SELECT IPV4_SRC_ADDR AS ip, count(*) AS value FROM flows GROUP BY ALL"
    " ORDER BY value DESC, ip LIMIT 100",
    "top_dst": "SELECT IPV4_DST_ADDR AS ip, count(*) AS value FROM flows GROUP BY ALL"
    " ORDER BY value DESC, ip LIMIT 100",
    "total": "SELECT count(*) AS cnt FROM flows",
}


def _summary(name):
    @check(f"S13_summary_{name}", SUMMARY_SQL[name])
    def _(spark, sf):
        return boards.build_summaries(flows(spark, sf), scratch_path(spark, "s13"))[name]


for _name in SUMMARY_SQL:
    _summary(_name)


@check("S16_ensure_state", "SELECT FLOW_ID, CAST(NULL AS INT) AS HMM_STATE FROM flows")
def _(spark, sf):
    return writers.ensure_state(flows(spark, sf)).select(FLOW_ID, STATE)


ASSIGNED = (
    "SELECT FLOW_ID, CASE WHEN Label = 'Attack' THEN CAST(10 + PROTOCOL AS INT) ELSE HMM_STATE END"
    " AS HMM_STATE FROM flows"
)


@check("S17_assign_states", ASSIGNED)
def _(spark, sf):
    f = labelled_flows(spark, sf)
    new = f.where("Label = 'Attack'").selectExpr("FLOW_ID", "CAST(10 + PROTOCOL AS INT) AS HMM_STATE")
    return writers.assign_states(f, new).select(FLOW_ID, STATE)


TACTIC_SET = (
    "SELECT FLOW_ID, CASE HMM_STATE WHEN 0 THEN 'Impact' WHEN 3 THEN 'Collection' ELSE MITRE_TACTIC"
    " END AS MITRE_TACTIC FROM flows"
)


@check("S18_assign_tactics", TACTIC_SET)
def _(spark, sf):
    f = writers.assign_tactics(labelled_flows(spark, sf), {0: "Impact", 3: "Collection"})
    return f.select(FLOW_ID, "MITRE_TACTIC")


# ------------------------------------------------------- predicates and pages


def _count(name, condition, predicate):
    @check(name, COUNT + condition)
    def _(spark, sf):
        return summaries.flow_count(flows(spark, sf), predicate())


_count("P1_in_list", "IPV4_SRC_ADDR IN ('10.0.0.1', '10.0.0.7')",
       lambda: p.all_of(p.is_in("IPV4_SRC_ADDR", ["10.0.0.1", "10.0.0.7"]), p.is_in("PROTOCOL", [])))
_count("P2_range", "IN_BYTES >= 1000 AND IN_BYTES <= 20000",
       lambda: p.in_range("IN_BYTES", 1000, 20000))
_count("P3_contains", "contains(IPV4_DST_ADDR, '.1.2')", lambda: p.contains("IPV4_DST_ADDR", ".1.2"))
_count("P3_contains_literal_wildcards", "contains(COMMUNITY_ID, '%_')",
       lambda: p.contains("COMMUNITY_ID", "%_"))
_count("P4_compare", "IN_PKTS <> 7 AND OUT_PKTS <= 20",
       lambda: p.all_of(p.compare("IN_PKTS", "<>", 7), p.compare("OUT_PKTS", "<=", 20)))
_count("P5_custom", "(IN_BYTES > OUT_BYTES OR L4_DST_PORT = 22)",
       lambda: p.custom("IN_BYTES > OUT_BYTES OR L4_DST_PORT = 22"))
_count("P6_all_of_nothing", "1 = 1", lambda: p.all_of(None, None))

FILTER = p.FlowFilter(
    start=1709300000000, end=1709700000000, protocols=[6, 17], dst_ports=[22, 80, 443],
    attack_types=["Benign", "Discovery", "Exfiltration"], l7_protocols=[0.0, 7.0],
    custom="IN_PKTS > 3",
)
FILTER_SQL = (
    "FLOW_START_MILLISECONDS >= 1709300000000 AND FLOW_END_MILLISECONDS <= 1709700000000"
    " AND PROTOCOL IN (6, 17) AND L4_DST_PORT IN (22, 80, 443) AND L7_PROTO IN (0, 7)"
    " AND Attack IN ('Benign', 'Discovery', 'Exfiltration') AND IN_PKTS > 3"
)


@check("P7_flow_filter", f"{ALL} WHERE {FILTER_SQL}")
def _(spark, sf):
    return flows(spark, sf).where(p.flow_filter(FILTER))


@check(
    "P8_column_filters",
    COUNT + "CAST(PROTOCOL AS VARCHAR) IN ('6', '1') AND contains(CAST(L4_DST_PORT AS VARCHAR), '80')",
)
def _(spark, sf):
    spec = {"PROTOCOL": [6, 1], "L4_DST_PORT": "80", "Attack": [], "SERVICE": " "}
    return summaries.flow_count(flows(spark, sf), p.column_filters(spec))


@check("P9_hide_benign", ALL + " WHERE Attack <> 'Benign'")
def _(spark, sf):
    return filters.hide_benign(flows(spark, sf))


@check(
    "P10_session_flows",
    ALL + " WHERE IPV4_SRC_ADDR = '10.0.0.5' AND FLOW_START_MILLISECONDS >= 1709300000000"
    " AND FLOW_END_MILLISECONDS <= 1709600000000",
)
def _(spark, sf):
    return filters.session_flows(flows(spark, sf), "10.0.0.5", 1709300000000, 1709600000000)


@check("P11_state_flows", ALL + " WHERE HMM_STATE = 2")
def _(spark, sf):
    return filters.state_flows(labelled_flows(spark, sf), 2).drop(STATE)


@check("P12_filter_by_label", COUNT + "L4_DST_PORT = 22")
def _(spark, sf):
    hits = filters.filter_by(flows(spark, sf), "Destination Port", "22", limit=None)
    return summaries.flow_count(hits)


@check("P13_display_flows", ALL + " WHERE Attack <> 'Benign'")
def _(spark, sf):
    return filters.display_flows(flows(spark, sf))


@check("P14_flow_page", ALL + " ORDER BY FLOW_START_MILLISECONDS DESC, FLOW_ID LIMIT 50 OFFSET 100")
def _(spark, sf):
    return filters.flow_page(flows(spark, sf), limit=50, offset=100)


@check(
    "P14_keyset_page",
    ", top AS (SELECT *, row_number() OVER (ORDER BY FLOW_START_MILLISECONDS DESC, FLOW_ID) AS rn FROM flows) "
    + ALL.replace("FROM flows", "FROM top WHERE rn BETWEEN 101 AND 150"),
)
def _(spark, sf):
    f = flows(spark, sf)
    last = filters.flow_page(f, limit=1, offset=99).first()
    return filters.flow_page(f, limit=50, after=(last.FLOW_START_MILLISECONDS, last.FLOW_ID))


@check(
    "P15_preview",
    "SELECT IPV4_SRC_ADDR, IPV4_DST_ADDR, PROTOCOL, L4_DST_PORT, IN_BYTES, OUT_BYTES,"
    " FLOW_DURATION_MILLISECONDS, CONN_STATE, SERVICE, MITRE_TACTIC, MITRE_TECHNIQUE FROM flows",
)
def _(spark, sf):
    return filters.preview(flows(spark, sf))


@check(
    "P15_table_view",
    "SELECT IPV4_SRC_ADDR, L4_SRC_PORT, IPV4_DST_ADDR, L4_DST_PORT, PROTOCOL, IN_BYTES, OUT_BYTES,"
    " Attack, HMM_STATE FROM flows",
)
def _(spark, sf):
    return filters.table_view(labelled_flows(spark, sf))


# ------------------------------------------------------------------- joins


@check("J1_attach_states_and_tactics", f"""
 SELECT FLOW_ID, CASE WHEN Label = 'Attack' THEN CAST(10 + PROTOCOL AS INT) ELSE HMM_STATE END AS HMM_STATE,
  CASE CASE WHEN Label = 'Attack' THEN 10 + PROTOCOL ELSE HMM_STATE END WHEN 0 THEN 'Impact'
   WHEN 16 THEN 'Execution' ELSE MITRE_TACTIC END AS MITRE_TACTIC FROM flows""")
def _(spark, sf):
    f = labelled_flows(spark, sf)
    new = f.where("Label = 'Attack'").selectExpr("FLOW_ID", "CAST(10 + PROTOCOL AS INT) AS HMM_STATE")
    f = writers.assign_tactics(writers.assign_states(f, new), {0: "Impact", 16: "Execution"})
    return f.select(FLOW_ID, STATE, "MITRE_TACTIC")


@check("J4_protocol_names", """SELECT coalesce(CASE PROTOCOL WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP'
 WHEN 17 THEN 'UDP' WHEN 47 THEN 'GRE' END, CAST(PROTOCOL AS VARCHAR)) AS protocol_name,
 count(*) AS count FROM flows GROUP BY ALL""")
def _(spark, sf):
    named = lookups.with_protocol_name(flows(spark, sf))
    return named.groupBy("protocol_name").agg(F.count(F.lit(1)).alias("count"))


@check("J4_technique_names", """SELECT MITRE_TECHNIQUE, CASE MITRE_TECHNIQUE WHEN 'T1595' THEN 'Active Scanning'
 WHEN 'T1110' THEN 'Brute Force' WHEN 'T1190' THEN 'Exploit Public-Facing Application'
 WHEN 'T1048' THEN 'Exfiltration Over Alternative Protocol' END AS technique_name,
 count(*) AS count FROM flows GROUP BY ALL""")
def _(spark, sf):
    named = lookups.with_technique_name(flows(spark, sf))
    return named.groupBy("MITRE_TECHNIQUE", "technique_name").agg(F.count(F.lit(1)).alias("count"))


@check("J4_l7_names", """SELECT CASE L7_PROTO WHEN 0 THEN 'Unknown' WHEN 5 THEN 'DNS' WHEN 7 THEN 'HTTP'
 WHEN 91 THEN 'SSH' END AS l7_name, count(*) AS count FROM flows GROUP BY ALL""")
def _(spark, sf):
    named = lookups.with_l7_name(flows(spark, sf))
    return named.groupBy("l7_name").agg(F.count(F.lit(1)).alias("count"))


@check("J5_hosts_on_both_sides", "SELECT DISTINCT IPV4_SRC_ADDR AS ip FROM flows"
       " WHERE IPV4_SRC_ADDR IN (SELECT IPV4_DST_ADDR FROM flows)")
def _(spark, sf):
    f = flows(spark, sf)
    hosts = f.select(F.col("IPV4_SRC_ADDR").alias("ip")).distinct()
    return p.any_value_join(hosts, "ip", f.select("IPV4_DST_ADDR"))


# --------------------------------------------------------------- summaries

BYTES = "CAST(sum(IN_BYTES + OUT_BYTES) AS BIGINT)"


@check("A1_attack_distribution", SUMMARY_SQL["attacks"])
def _(spark, sf):
    return summaries.attack_distribution(flows(spark, sf))


def _talkers(name, column, value, direction, metric, limit=10, condition="1 = 1", where=None):
    @check(name, f"SELECT {column} AS ip, {value} AS value FROM flows WHERE {condition} GROUP BY ALL"
                 f" ORDER BY value DESC, ip LIMIT {limit}")
    def _(spark, sf):
        return summaries.top_talkers(flows(spark, sf), direction, metric, limit, where and where())


_talkers("A2_top_src_flows", "IPV4_SRC_ADDR", "count(*)", "src", "flows")
_talkers("A2_top_src_bytes", "IPV4_SRC_ADDR", BYTES, "src", "bytes")
_talkers("A2_top_dst_flows", "IPV4_DST_ADDR", "count(*)", "dst", "flows")
_talkers("A2_top_dst_bytes_filtered", "IPV4_DST_ADDR", BYTES, "dst", "bytes", 10, FILTER_SQL,
         lambda: p.flow_filter(FILTER))
_talkers("A15_bytes_by_source", "IPV4_SRC_ADDR", BYTES, "src", "bytes", 20)


@check("A3_protocol_distribution",
       "SELECT PROTOCOL AS protocol, count(*) AS count FROM flows GROUP BY ALL")
def _(spark, sf):
    return summaries.protocol_distribution(flows(spark, sf))


@check("A4_time_range", "SELECT min(FLOW_START_MILLISECONDS) AS start,"
       ' max(FLOW_END_MILLISECONDS) AS "end" FROM flows')
def _(spark, sf):
    return summaries.time_range(flows(spark, sf))


@check("A4_time_range_by_start", "SELECT min(FLOW_START_MILLISECONDS) AS start,"
       ' max(FLOW_START_MILLISECONDS) AS "end" FROM flows')
def _(spark, sf):
    return summaries.time_range(flows(spark, sf), "FLOW_START_MILLISECONDS")


@check("A5_flow_count", COUNT + FILTER_SQL)
def _(spark, sf):
    return summaries.flow_count(flows(spark, sf), p.flow_filter(FILTER))


@check("A6_timeline", SUMMARY_SQL["timeline"])
def _(spark, sf):
    return summaries.timeline(flows(spark, sf))


@check("A6_timeline_five_minutes", "SELECT FLOW_START_MILLISECONDS // 300000 * 300000 AS time,"
       " Attack AS attack, count(*) AS count FROM flows WHERE Attack <> 'Benign' GROUP BY ALL")
def _(spark, sf):
    return summaries.timeline(flows(spark, sf), 5, F.col("Attack") != "Benign")


@check("A7_network_edges", "SELECT IPV4_SRC_ADDR AS source, IPV4_DST_ADDR AS target, count(*) AS weight"
       " FROM flows GROUP BY ALL ORDER BY weight DESC, source, target LIMIT 100")
def _(spark, sf):
    return summaries.network_edges(flows(spark, sf))


@check("A8_tactic_distribution", "SELECT MITRE_TACTIC AS attack, count(*) AS count FROM flows"
       " WHERE MITRE_TACTIC <> '' GROUP BY ALL")
def _(spark, sf):
    return summaries.tactic_distribution(flows(spark, sf))


@check("A9_technique_distribution", "SELECT MITRE_TECHNIQUE AS technique, MITRE_TACTIC AS tactic,"
       " count(*) AS count FROM flows WHERE MITRE_TECHNIQUE <> '' GROUP BY ALL"
       " ORDER BY count DESC, technique, tactic LIMIT 20")
def _(spark, sf):
    return summaries.technique_distribution(flows(spark, sf))


TUPLE = "IPV4_SRC_ADDR, L4_SRC_PORT, IPV4_DST_ADDR, L4_DST_PORT, PROTOCOL"


def _texts_of_tuple(column, where):
    return f"""(SELECT nr, array_to_string(list(v ORDER BY v), ', ') AS {column}
 FROM (SELECT DISTINCT nr, {column} AS v FROM numbered WHERE {where}) GROUP BY nr)"""


# The columns that are summed, and those of which the greatest value stays.
SUMMED = ("FLOW_DURATION_MILLISECONDS", "IN_BYTES", "OUT_BYTES", "IN_PKTS", "OUT_PKTS")
PEAKS = ("Label", "CONN_STATE", "SERVICE", "COMMUNITY_ID", "L7_PROTO", "TCP_FLAGS", "MIN_TTL", "MAX_TTL")
# Tuples are numbered (NULL is a value there), and each list is joined on from its own distinct rows.
DEDUP = f"""SELECT * EXCLUDE (nr) FROM (
 WITH numbered AS (SELECT *, dense_rank() OVER (ORDER BY {TUPLE}) AS nr FROM flows),
 spans AS (SELECT nr, {TUPLE}, min(FLOW_START_MILLISECONDS) AS FLOW_START_MILLISECONDS,
  max(FLOW_END_MILLISECONDS) AS FLOW_END_MILLISECONDS,
  count(*) FILTER (WHERE Label = 'Attack') > 0 AS any_attack FROM numbered GROUP BY ALL),
 sums AS (SELECT nr, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in SUMMED)} FROM numbered GROUP BY nr),
 peaks AS (SELECT nr, {", ".join(f"max({c}) AS {c}" for c in PEAKS)} FROM numbered GROUP BY nr)
 SELECT * FROM spans JOIN sums USING (nr) JOIN peaks USING (nr)
 LEFT JOIN {_texts_of_tuple("Attack", "v IS NOT NULL")} USING (nr)
 LEFT JOIN {_texts_of_tuple("MITRE_TACTIC", "v IS NOT NULL")} USING (nr)
 LEFT JOIN {_texts_of_tuple("MITRE_TECHNIQUE", "v <> ''")} USING (nr))"""


@check("A10_dedup_flows", DEDUP)
def _(spark, sf):
    return summaries.dedup_flows(flows(spark, sf))


@check("A10_dedup_page", f"SELECT * FROM ({DEDUP}) ORDER BY FLOW_START_MILLISECONDS DESC, {TUPLE}"
       " LIMIT 50 OFFSET 50")
def _(spark, sf):
    return summaries.dedup_page(flows(spark, sf), limit=50, offset=50)


@check("A11_dedup_count", f"SELECT count(DISTINCT ({TUPLE})) AS cnt FROM flows")
def _(spark, sf):
    return summaries.dedup_count(flows(spark, sf))


@check("A11_dedup_count_approximate")
def _(spark, sf):
    return summaries.dedup_count(flows(spark, sf), approximate=True)


@check("A12_attack_share", """, c AS (SELECT Attack AS attack, count(*) AS count FROM flows GROUP BY ALL)
 SELECT attack, count, CAST(floor(100.0::DOUBLE * count / sum(count) OVER () + 0.5) AS BIGINT) AS percent,
 row_number() OVER (ORDER BY count DESC, attack) = 1 AS is_top FROM c""")
def _(spark, sf):
    return summaries.attack_share(flows(spark, sf))


ENDS = "(IPV4_SRC_ADDR = '10.0.0.9' OR IPV4_DST_ADDR = '10.0.0.9')"
HOST = """count(*) AS total_flows, min(FLOW_START_MILLISECONDS) AS start,
 max(FLOW_START_MILLISECONDS) AS "end", array_to_string(list_sort(list(DISTINCT Attack)), '|') AS attack_types,
 array_to_string(list_sort(list(DISTINCT PROTOCOL)), '|') AS protocols"""


@check("A13_investigate_ip_flows",
       f"{ALL} WHERE {ENDS} ORDER BY FLOW_START_MILLISECONDS, FLOW_ID LIMIT 100")
def _(spark, sf):
    return summaries.investigate_ip(flows(spark, sf), "10.0.0.9")["flows"]


@check("A13_investigate_ip_summary", f"SELECT {HOST} FROM flows WHERE {ENDS}")
def _(spark, sf):
    return summaries.investigate_ip(flows(spark, sf), "10.0.0.9")["summary"]


@check("A13_host_summary", f""", sides AS (SELECT IPV4_SRC_ADDR AS ip, * FROM flows UNION ALL
 SELECT IPV4_DST_ADDR AS ip, * FROM flows WHERE IPV4_DST_ADDR <> IPV4_SRC_ADDR)
 SELECT ip, {HOST} FROM sides GROUP BY ip""")
def _(spark, sf):
    return summaries.host_summary(flows(spark, sf))


@check("A14_port_scanners", "SELECT IPV4_SRC_ADDR AS ip, count(DISTINCT L4_DST_PORT) AS ports FROM flows"
       " GROUP BY ALL HAVING ports > 10 ORDER BY ports DESC, ip LIMIT 20")
def _(spark, sf):
    return summaries.port_scanners(flows(spark, sf))


DASHBOARD_SQL = {
    "timeline": f"SELECT {HOUR} AS time, Attack AS attack, count(*) AS count FROM flows WHERE {{w}}"
    " GROUP BY ALL ORDER BY time, attack",
    "attacks": SUMMARY_SQL["attacks"],
    "top_src": "SELECT IPV4_SRC_ADDR AS ip, count(*) AS value FROM flows WHERE {w} GROUP BY ALL"
    " ORDER BY value DESC, ip LIMIT 10",
    "top_dst": "SELECT IPV4_DST_ADDR AS ip, count(*) AS value FROM flows WHERE {w} GROUP BY ALL"
    " ORDER BY value DESC, ip LIMIT 10",
    "flows": ALL + " WHERE {w} ORDER BY FLOW_START_MILLISECONDS DESC, FLOW_ID LIMIT 1000",
    "total": "SELECT count(*) AS cnt FROM flows WHERE {w}",
}


def _board(name):
    @check(f"A16_dashboard_{name}", DASHBOARD_SQL[name].format(w="1 = 1"))
    def _(spark, sf):
        f = flows(spark, sf)
        ready = boards.build_summaries(f, scratch_path(spark, "a16"))
        return boards.dashboard(f, summaries=ready)[name]

    @check(f"A16_dashboard_filtered_{name}", DASHBOARD_SQL[name].format(w=FILTER_SQL))
    def _(spark, sf):
        return boards.dashboard(flows(spark, sf), FILTER)[name]


for _name in DASHBOARD_SQL:
    _board(_name)


@check("A17_attack_sources", "SELECT IPV4_SRC_ADDR AS ip, count(*) AS value FROM flows"
       " WHERE Attack = 'Exfiltration' GROUP BY ALL")
def _(spark, sf):
    return summaries.attack_sources(flows(spark, sf), "Exfiltration")


FREE = ("SELECT SERVICE, count(*) AS n, max(IN_BYTES) AS most FROM flows WHERE L4_DST_PORT <= 1023"
        " GROUP BY SERVICE HAVING count(*) > 1 ORDER BY n DESC")


@check("Q1_free_sql", FREE)
def _(spark, sf):
    return query(flows(spark, sf), FREE)
