"""The test flows: a deterministic view over ``lineitem``.

The same text runs in Spark and in DuckDB, so both engines see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FLOWS_SQL = """
SELECT FLOW_ID, FLOW_START_MILLISECONDS, FLOW_START_MILLISECONDS + FLOW_DURATION_MILLISECONDS AS FLOW_END_MILLISECONDS, FLOW_DURATION_MILLISECONDS,
 IPV4_SRC_ADDR, L4_SRC_PORT, IPV4_DST_ADDR, L4_DST_PORT, PROTOCOL, L7_PROTO, IN_BYTES, IN_PKTS, OUT_BYTES, OUT_PKTS, TCP_FLAGS, MIN_TTL, MAX_TTL, SRC_TO_DST_IAT_AVG,
 Label, CASE WHEN MITRE_TACTIC IS NULL THEN 'Unknown' WHEN MITRE_TACTIC = '' THEN 'Benign' ELSE MITRE_TACTIC END AS Attack, MITRE_TACTIC,
 CASE MITRE_TACTIC WHEN 'Reconnaissance' THEN 'T1595' WHEN 'Credential Access' THEN 'T1110' WHEN 'Initial Access' THEN 'T1190' WHEN 'Exfiltration' THEN 'T1048' WHEN 'Discovery' THEN '' ELSE NULL END AS MITRE_TECHNIQUE,
 CONN_STATE, CASE WHEN h % 13 = 0 THEN NULL WHEN L4_DST_PORT = 22 THEN 'ssh' WHEN L4_DST_PORT = 53 THEN 'dns' WHEN L4_DST_PORT IN (80, 8080) THEN 'http' WHEN L4_DST_PORT = 443 THEN 'ssl' ELSE '' END AS SERVICE,
 CASE WHEN h % 19 = 0 THEN NULL ELSE concat('1:', CAST(FLOW_ID AS VARCHAR(20))) END AS COMMUNITY_ID
FROM (SELECT h,
 (((l_orderkey*8 + l_linenumber)*100000 + l_partkey)*10000 + l_suppkey)*64 + CAST(l_quantity AS BIGINT) AS FLOW_ID,
 1709251200000 + (h*31) % 604800000 AS FLOW_START_MILLISECONDS,
 CASE WHEN h % 11 = 0 THEN 0 ELSE h % 45000 END AS FLOW_DURATION_MILLISECONDS,
 concat('10.0.', CAST(CAST(FLOOR(l_suppkey / 256) AS BIGINT) AS VARCHAR(20)), '.', CAST(l_suppkey % 256 AS VARCHAR(20))) AS IPV4_SRC_ADDR,
 40000 + h % 2 AS L4_SRC_PORT,
 CASE WHEN h % 17 = 0 THEN concat('10.0.0.', CAST(l_partkey % 100 AS VARCHAR(20))) ELSE concat('192.168.', CAST(CAST(FLOOR((l_partkey % 1000) / 256) AS BIGINT) AS VARCHAR(20)), '.', CAST((l_partkey % 1000) % 256 AS VARCHAR(20))) END AS IPV4_DST_ADDR,
 CASE (l_partkey + l_linenumber) % 10 WHEN 0 THEN 22 WHEN 1 THEN 53 WHEN 2 THEN 80 WHEN 3 THEN 443 WHEN 4 THEN 445 WHEN 5 THEN 3389 WHEN 6 THEN 8080 WHEN 7 THEN 5985 WHEN 8 THEN 49152 + h % 16000 ELSE 1024 + h % 48000 END AS L4_DST_PORT,
 CASE WHEN h % 23 < 14 THEN 6 WHEN h % 23 < 20 THEN 17 WHEN h % 23 < 22 THEN 1 ELSE 47 END AS PROTOCOL,
 CAST(CASE h % 29 WHEN 0 THEN 5 WHEN 1 THEN 7 WHEN 2 THEN 91 ELSE 0 END AS DOUBLE) AS L7_PROTO,
 CAST(l_quantity AS BIGINT)*(40 + h % 1400) AS IN_BYTES, CAST(l_quantity AS BIGINT) AS IN_PKTS,
 CAST(FLOOR(l_extendedprice) AS BIGINT)*(h % 7) AS OUT_BYTES, h % 41 AS OUT_PKTS,
 h % 64 AS TCP_FLAGS, h % 65 AS MIN_TTL, 64 + h % 65 AS MAX_TTL,
 CASE WHEN h % 5 = 0 THEN NULL ELSE CAST(h % 1000 AS DOUBLE) END AS SRC_TO_DST_IAT_AVG,
 CASE WHEN l_returnflag = 'R' THEN 'Attack' ELSE 'Benign' END AS Label,
 CASE WHEN l_returnflag <> 'R' THEN '' WHEN h % 37 = 0 THEN NULL ELSE CASE (l_orderkey + l_suppkey) % 6 WHEN 0 THEN 'Reconnaissance' WHEN 1 THEN 'Credential Access' WHEN 2 THEN 'Initial Access' WHEN 3 THEN 'Exfiltration' WHEN 4 THEN 'Discovery' ELSE 'Lateral Movement' END END AS MITRE_TACTIC,
 CASE WHEN h % 31 = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'SF' WHEN l_returnflag = 'N' THEN CASE h % 3 WHEN 0 THEN 'SF' WHEN 1 THEN 'S0' ELSE 'S1' END ELSE CASE h % 3 WHEN 0 THEN 'REJ' WHEN 1 THEN 'RSTO' ELSE 'RSTR' END END AS CONN_STATE
 FROM (SELECT *, (l_orderkey*7919 + l_partkey*104729 + l_suppkey*1299709 + l_linenumber*15485863) AS h FROM {lineitem}) a) b
"""

STATE_SQL = (
    "CASE WHEN FLOW_ID % 9 = 0 THEN NULL"
    " ELSE CAST((L4_DST_PORT + PROTOCOL) % 5 AS INT) END AS HMM_STATE"
)
STATE_TACTICS = {
    0: "Reconnaissance",
    1: "Credential Access",
    2: "Exfiltration",
    3: "Lateral Movement",
}


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(FLOWS_SQL, lineitem=lineitem)


def state_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).selectExpr("*", STATE_SQL)


def oracle(body: str) -> str:
    """A DuckDB query over ``flows`` (with HMM_STATE) on the same rows."""
    base = FLOWS_SQL.format(lineitem="lineitem")
    return f"WITH base_flows AS ({base}), flows AS (SELECT *, {STATE_SQL} FROM base_flows) {body}"
