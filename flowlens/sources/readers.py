"""Reading flow records: Parquet, CSV, header variants, Zeek connection logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowlens.schema import END, FLOW_ID, FLOW_TYPES, REQUIRED, START, conform

# Header spellings of other exporters, in order of preference.
ALIASES = {
    "IPV4_SRC_ADDR": ("ipv4_src_addr", "sa", "sip", "src_ip", "source_ip", "srcaddr", "srcip", "source"),
    "IPV4_DST_ADDR": ("ipv4_dst_addr", "da", "dip", "dst_ip", "dest_ip", "dstaddr", "dstip", "destination"),
    "L4_SRC_PORT": ("l4_src_port", "sp", "sport", "src_port", "source_port", "srcport"),
    "L4_DST_PORT": ("l4_dst_port", "dp", "dport", "dst_port", "dest_port", "dstport"),
    "PROTOCOL": ("protocol", "pr", "proto", "ip_protocol"),
    "IN_BYTES": ("in_bytes", "ibyt", "bytes_in", "inbytes", "bytsin", "rxbytes"),
    "OUT_BYTES": ("out_bytes", "obyt", "bytes_out", "outbytes", "bytsout", "txbytes"),
    "IN_PKTS": ("in_pkts", "ipkt", "pkts_in", "inpkts", "rxpackets"),
    "OUT_PKTS": ("out_pkts", "opkt", "pkts_out", "outpkts", "txpackets"),
    "Attack": ("attack", "attack_type", "attacktype", "category", "threat"),
    "Label": ("label", "is_attack", "malicious"),
}
# Times: these spellings are ours (epoch ms).
TIME_ALIASES = {
    START: ("flow_start_milliseconds", "start_ms", "first_ms", "flow_start"),
    END: ("flow_end_milliseconds", "end_ms", "last_ms", "flow_end"),
    "FLOW_DURATION_MILLISECONDS": ("flow_duration_milliseconds", "duration_ms"),
}


def detect_columns(headers: list[str]) -> dict[str, str]:
    """Standard column -> header that carries it; matching ignores case."""
    found = {}
    for header in headers:
        found.setdefault(header.lower(), header)
    mapping = {}
    for standard, names in {**ALIASES, **TIME_ALIASES}.items():
        match = next((found[n] for n in names if n in found), None)
        if match is not None:
            mapping[standard] = match
    return mapping


def map_columns(df: DataFrame) -> DataFrame:
    """Rename a foreign header to the standard names; other columns stay."""
    mapping = detect_columns(df.columns)
    missing = [c for c in REQUIRED if c not in mapping]
    if missing:
        raise ValueError(
            f"missing required columns: {', '.join(missing)}; found {', '.join(df.columns)}"
        )
    taken = set(mapping.values())
    renamed = [F.col(f"`{original}`").alias(std) for std, original in mapping.items()]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in taken and c not in mapping]
    return df.select(*renamed, *rest)


def is_csv(path: str) -> bool:
    return path.lower().split("?")[0].endswith((".csv", ".csv.gz"))


def _from_text(name: str, kind: T.DataType):
    """A text field as its declared type; whole numbers may be written ``6.0``."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return c
    value = c.try_cast(kind)
    if isinstance(kind, (T.LongType, T.IntegerType)):
        value = F.coalesce(value, c.try_cast("double").try_cast(kind))
    return value.alias(name)


#: A text no file holds: the CSV reader's mark for NULL, which by default is the empty text.
NO_TEXT = "\u0001"


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with a header row, typed from the flow schema without a type-detection pass.

    Only the header lines are read up front; columns the schema does not know
    stay text.  Files are read by their own header and joined by column name; a
    folder whose files differ in it is refused.  An empty text in quotes stays
    one, an empty field is NULL.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for one in [path] if isinstance(path, str) else path:
        by_header.setdefault(tuple(spark.read.option("header", True).csv(one).columns), []).append(one)
    parts = [_read_csv_like(spark, paths, list(header)) for header, paths in by_header.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def _read_csv_like(spark: SparkSession, paths: list[str], header: list[str]) -> DataFrame:
    text = T.StructType([T.StructField(name, T.StringType()) for name in header])
    reader = spark.read.option("header", True).option("enforceSchema", False).option("nullValue", NO_TEXT)
    raw = reader.schema(text).csv(paths)
    standard = {original: std for std, original in detect_columns(header).items()}
    kinds = {n: FLOW_TYPES.get(standard.get(n, n), T.StringType()) for n in header}
    return raw.select(*[_from_text(n, kind) for n, kind in kinds.items()])


def read_flows(
    spark: SparkSession, path: str | list[str], fill_missing: bool = False
) -> DataFrame:
    """Flows from Parquet or CSV files (by extension), with declared types.

    Any file system Spark can read; a list reads several files as one table.
    """
    paths = [path] if isinstance(path, str) else list(path)
    raw = read_csv(spark, paths) if is_csv(paths[0]) else spark.read.parquet(*paths)
    return conform(map_columns(raw), fill_missing)


def probe(spark: SparkSession, path: str) -> int:
    """Row count; a Parquet count is answered from file footers."""
    df = read_csv(spark, path) if is_csv(path) else spark.read.parquet(path)
    return df.count()


SPLIT_BITS, MAX_ID = 33, (1 << 63) - 1  # rows of a split; the largest id


def with_flow_id(df: DataFrame, base: int = 0) -> DataFrame:
    """Number the flows, at ingest only, before any shuffle.

    The number is (input split, row in split), so a retried task gives the same
    ones; once written with the table it is the stable identity of the flow.
    Numbers after ``base`` are refused where the splits would not fit into 63 bits.
    """
    if FLOW_ID in df.columns:
        return df
    if base and base + (df.rdd.getNumPartitions() << SPLIT_BITS) > MAX_ID:
        raise OverflowError(f"no room for flow ids after {base}; number the table anew")
    return df.select((F.monotonically_increasing_id() + F.lit(base)).alias(FLOW_ID), "*")


# ---------------------------------------------------------------- Zeek logs

# Protocol numbers, label spellings and the two columns whose
# constant is not zero.
ZEEK_PROTOCOLS = {"tcp": 6, "udp": 17, "icmp": 1}
ZEEK_LABELS = {"true": "Attack", "false": "Benign", "duplicate": "Attack"}
ZEEK_CONSTANTS = {"MAX_TTL": 64, "MAX_IP_PKT_LEN": 1500}


def _zeek_label_text(column: str, none: str, duplicate: str):
    c = F.col(column)
    return F.when(c == "none", none).when(c == "Duplicate", duplicate).otherwise(c)


def from_zeek(df: DataFrame) -> DataFrame:
    """A Zeek connection log as flows; one projection, no shuffle."""
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    protocol = F.lit(0)
    for name, value in ZEEK_PROTOCOLS.items():
        protocol = F.when(F.col("proto") == name, value).otherwise(protocol)
    truth = F.lower(F.col("label_binary").cast("string"))
    label = F.lit("Benign")
    for name, value in ZEEK_LABELS.items():
        label = F.when(truth == name, value).otherwise(label)
    seconds = F.coalesce(F.col("duration"), F.lit(0.0))
    made = {
        START: (F.col("ts") * 1000).cast("long"),
        END: ((F.col("ts") + seconds) * 1000).cast("long"),
        "FLOW_DURATION_MILLISECONDS": (seconds * 1000).cast("long"),
        "IPV4_SRC_ADDR": F.col("src_ip_zeek"),
        "IPV4_DST_ADDR": F.col("dest_ip_zeek"),
        "L4_SRC_PORT": number("src_port_zeek"),
        "L4_DST_PORT": number("dest_port_zeek"),
        "PROTOCOL": protocol,
        "IN_BYTES": number("orig_bytes"),
        "OUT_BYTES": number("resp_bytes"),
        "IN_PKTS": number("orig_pkts"),
        "OUT_PKTS": number("resp_pkts"),
        "Label": label,
        "Attack": _zeek_label_text("label_tactic", "Benign", "Unknown"),
        "MITRE_TACTIC": _zeek_label_text("label_tactic", "", ""),
        "MITRE_TECHNIQUE": _zeek_label_text("label_technique", "", ""),
        "CONN_STATE": F.col("conn_state"),
        "SERVICE": F.coalesce(F.col("service"), F.lit("")),
        "HISTORY": F.coalesce(F.col("history"), F.lit("")),
        "COMMUNITY_ID": F.col("community_id"),
    }
    columns = [made[c].cast(FLOW_TYPES[c]).alias(c) for c in made]
    for name, kind in FLOW_TYPES.items():
        if name not in made and name not in (FLOW_ID, "HMM_STATE"):
            columns.append(F.lit(ZEEK_CONSTANTS.get(name, 0)).cast(kind).alias(name))
    kept = [FLOW_ID] if FLOW_ID in df.columns else []
    return df.select(*kept, *columns)


def read_zeek(spark: SparkSession, paths: list[str], merge_schema: bool = False) -> DataFrame:
    """Weekly Parquet logs read as one table.

    ``merge_schema`` reads every footer; needed only when weeks differ in columns.
    """
    return from_zeek(spark.read.option("mergeSchema", merge_schema).parquet(*paths))
