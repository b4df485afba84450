"""The flows table: column types, label vocabulary and small lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

START, END, DURATION = (
    "FLOW_START_MILLISECONDS",
    "FLOW_END_MILLISECONDS",
    "FLOW_DURATION_MILLISECONDS",
)
SRC, DST = "IPV4_SRC_ADDR", "IPV4_DST_ADDR"
FLOW_ID, STATE = "FLOW_ID", "HMM_STATE"
DATE = "flow_date"  # the partition column of a written table
FIVE_TUPLE = (SRC, "L4_SRC_PORT", DST, "L4_DST_PORT", "PROTOCOL")
REQUIRED = (SRC, DST)

# The declared columns of a flow record, with what an exporter
# that lacks the column is taken to have reported.
_LONG_COLUMNS = (
    "FLOW_START_MILLISECONDS", "FLOW_END_MILLISECONDS", "FLOW_DURATION_MILLISECONDS", "L4_SRC_PORT",
    "L4_DST_PORT", "IN_BYTES", "IN_PKTS", "OUT_BYTES", "OUT_PKTS", "TCP_FLAGS", "CLIENT_TCP_FLAGS",
    "SERVER_TCP_FLAGS", "DURATION_IN", "DURATION_OUT", "MIN_TTL", "MAX_TTL", "LONGEST_FLOW_PKT",
    "SHORTEST_FLOW_PKT", "MIN_IP_PKT_LEN", "MAX_IP_PKT_LEN", "SRC_TO_DST_SECOND_BYTES",
    "DST_TO_SRC_SECOND_BYTES", "RETRANSMITTED_IN_BYTES", "RETRANSMITTED_IN_PKTS", "RETRANSMITTED_OUT_BYTES",
    "RETRANSMITTED_OUT_PKTS", "NUM_PKTS_UP_TO_128_BYTES", "NUM_PKTS_128_TO_256_BYTES",
    "NUM_PKTS_256_TO_512_BYTES", "NUM_PKTS_512_TO_1024_BYTES", "NUM_PKTS_1024_TO_1514_BYTES", "TCP_WIN_MAX_IN",
    "TCP_WIN_MAX_OUT", "ICMP_TYPE", "ICMP_IPV4_TYPE", "DNS_QUERY_ID", "DNS_QUERY_TYPE", "DNS_TTL_ANSWER",
    "FTP_COMMAND_RET_CODE",
)
_DOUBLE_COLUMNS = (
    "L7_PROTO", "SRC_TO_DST_AVG_THROUGHPUT", "DST_TO_SRC_AVG_THROUGHPUT", "SRC_TO_DST_IAT_MIN",
    "SRC_TO_DST_IAT_MAX", "SRC_TO_DST_IAT_AVG", "SRC_TO_DST_IAT_STDDEV", "DST_TO_SRC_IAT_MIN",
    "DST_TO_SRC_IAT_MAX", "DST_TO_SRC_IAT_AVG", "DST_TO_SRC_IAT_STDDEV",
)
_STRING_COLUMNS = (
    "IPV4_SRC_ADDR", "IPV4_DST_ADDR", "Label", "Attack", "MITRE_TACTIC", "MITRE_TECHNIQUE", "CONN_STATE",
    "SERVICE", "HISTORY", "COMMUNITY_ID",
)

FLOW_SCHEMA = T.StructType(
    [T.StructField(FLOW_ID, T.LongType())]
    + [T.StructField(c, T.LongType()) for c in _LONG_COLUMNS]
    + [T.StructField("PROTOCOL", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in _DOUBLE_COLUMNS]
    + [T.StructField(c, T.StringType()) for c in _STRING_COLUMNS]
    + [T.StructField(STATE, T.IntegerType())]
)
FLOW_TYPES = {f.name: f.dataType for f in FLOW_SCHEMA.fields}

# Kill-chain stages, in attack order.
KILL_CHAIN = (
    "Reconnaissance",
    "Initial Access",
    "Execution",
    "Persistence",
    "Privilege Escalation",
    "Defense Evasion",
    "Credential Access",
    "Discovery",
    "Lateral Movement",
    "Collection",
    "Command and Control",
    "Exfiltration",
    "Impact",
)

# IANA protocol numbers, application protocol numbers and ATT&CK
# techniques shown by name.
PROTOCOL_NAMES = {
    1: "ICMP", 6: "TCP", 17: "UDP", 47: "GRE", 50: "ESP", 51: "AH", 89: "OSPF", 132: "SCTP",
}
L7_NAMES = {
    0: "Unknown", 5: "DNS", 7: "HTTP", 37: "BitTorrent", 91: "SSH", 92: "SSL/TLS", 131: "HTTPS",
}
TECHNIQUES = [
    ("T1110", "Brute Force", "Credential Access"),
    ("T1595", "Active Scanning", "Reconnaissance"),
    ("T1078", "Valid Accounts", "Defense Evasion"),
    ("T1190", "Exploit Public-Facing Application", "Initial Access"),
    ("T1048", "Exfiltration Over Alternative Protocol", "Exfiltration"),
    ("T1046", "Network Service Discovery", "Discovery"),
    ("T1071", "Application Layer Protocol", "Command and Control"),
    ("T1021", "Remote Services", "Lateral Movement"),
]


def technique_table(spark: SparkSession) -> DataFrame:
    """ATT&CK technique names, eight rows."""
    return spark.createDataFrame(
        TECHNIQUES, "technique string, technique_name string, technique_tactic string"
    )


def protocol_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROTOCOL_NAMES.items()), "protocol int, protocol_name string")


def l7_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(float(k), v) for k, v in L7_NAMES.items()], "l7_proto double, l7_name string"
    )


def label_text(col):
    """Known label spellings (text, 0/1, boolean) as ``Attack`` / ``Benign``; others stay, empty is NULL."""
    text = F.lower(F.trim(col.cast("string")))
    return (
        F.when(text.isin("attack", "1", "1.0", "true", "duplicate"), "Attack")
        .when(text.isin("benign", "normal", "0", "0.0", "false"), "Benign")
        .when(text != "", F.trim(col.cast("string")))
    )


def conform(df: DataFrame, fill_missing: bool = True) -> DataFrame:
    """Cast known columns to their declared type and add the absent ones as NULL.

    Unknown columns pass through.  Fails when an address column is missing.
    """
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    have = dict(df.dtypes)
    cols = []
    for field in FLOW_SCHEMA.fields:
        if field.name == "Label" and field.name in have:
            cols.append(label_text(F.col("Label")).alias("Label"))
        elif field.name in have:
            same = have[field.name] == field.dataType.simpleString()
            col = F.col(field.name)
            cols.append(col if same else col.cast(field.dataType).alias(field.name))
        elif fill_missing and field.name != FLOW_ID:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
    cols += [F.col(f"`{c}`") for c in df.columns if c not in FLOW_TYPES]
    return df.select(*cols)
