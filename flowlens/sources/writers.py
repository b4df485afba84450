"""Writing flows, appended chunks, state columns and state profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowlens.functions.columns import start_time
from flowlens.schema import DATE, FLOW_ID, START, STATE, FLOW_SCHEMA
from flowlens.session import shuffles_dropped
from flowlens.sources.readers import read_flows, with_flow_id

BATCH = "ingest_batch"
#: The number of the rows that a table starts with when deliveries are to be ingested into it.
LOADED = -1


def with_flow_date(f: DataFrame) -> DataFrame:
    return f.withColumn(DATE, F.to_date(start_time(START)))


def write_flows(
    f: DataFrame, path: str, mode: str = "overwrite", by_date: bool = True, codec: str = "zstd",
    batch: int | None = None,
) -> None:
    """Write the table, partitioned by start date.

    The rebalance hint gathers each date into few files and lets adaptive
    execution split a date that holds too much for one task.  With ``batch`` a
    date is partitioned by delivery too, and the rows of that delivery, if the
    table has some already, are replaced; all others stay.
    """
    writer = f
    if by_date or batch is not None:
        writer = with_flow_date(f).hint("rebalance", DATE)
    if batch is not None:
        writer = writer.withColumn(BATCH, F.lit(batch))
        mode = "overwrite"
    out = writer.write.mode(mode).option("compression", codec)
    with shuffles_dropped(f.sparkSession):
        if batch is not None:
            out.option("partitionOverwriteMode", "dynamic").partitionBy(DATE, BATCH).parquet(path)
        else:
            (out.partitionBy(DATE) if by_date else out).parquet(path)


def load(
    spark: SparkSession, source: str | list[str], table_path: str, by_date: bool = True, for_ingest: bool = False
):
    """Create or replace the flows table from files; returns the table.

    ``for_ingest`` lays a new table out so that deliveries can be added by stream.
    """
    rows = with_flow_id(read_flows(spark, source))
    write_flows(rows, table_path, "overwrite", by_date, batch=LOADED if for_ingest else None)
    return spark.read.parquet(table_path)


def append(spark: SparkSession, source: str | list[str], table_path: str, by_date: bool = True):
    """Append the rows of new files; ids continue after the ones in the table."""
    last = spark.read.parquet(table_path).agg(F.max(FLOW_ID)).first()[0]
    chunk = with_flow_id(read_flows(spark, source), base=0 if last is None else last + 1)
    write_flows(chunk, table_path, "append", by_date)
    return spark.read.parquet(table_path)


def save_table(f: DataFrame, name: str, path: str | None = None) -> None:
    """The flows as a catalog table, replaced when it exists."""
    writer = f.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def to_parquet(spark: SparkSession, csv_path: str, out: str, codec: str = "zstd") -> None:
    read_flows(spark, csv_path).write.mode("overwrite").option("compression", codec).parquet(out)


# ------------------------------------------------------------ state columns


def ensure_state(f: DataFrame) -> DataFrame:
    if STATE in f.columns:
        return f
    return f.withColumn(STATE, F.lit(None).cast("int"))


def assign_states(f: DataFrame, assignments: DataFrame) -> DataFrame:
    """Set the state of the assigned flows; the others keep theirs.

    ``assignments`` has FLOW_ID and HMM_STATE, at most one row per flow.  Write
    the result to a new path, never the one being read.
    """
    new = assignments.select(FLOW_ID, F.col(STATE).cast("int").alias("_new"))
    return (
        ensure_state(f)
        .join(new, FLOW_ID, "left")
        .withColumn(STATE, F.coalesce("_new", STATE))
        .drop("_new")
    )


def state_tactics(spark: SparkSession, tactics: dict[int, str]) -> DataFrame:
    """State -> tactic as a table (one row per model state)."""
    schema = T.StructType(
        [T.StructField(STATE, T.IntegerType()), T.StructField("tactic", T.StringType())]
    )
    return spark.createDataFrame([(int(k), v) for k, v in tactics.items()], schema)


def assign_tactics(f: DataFrame, tactics: dict[int, str]) -> DataFrame:
    """Set MITRE_TACTIC for the flows of the named states, all in one pass."""
    new = state_tactics(f.sparkSession, tactics).withColumnRenamed("tactic", "_tactic")
    return (
        f.join(F.broadcast(new), STATE, "left")
        .withColumn("MITRE_TACTIC", F.coalesce("_tactic", "MITRE_TACTIC"))
        .select(*f.columns)
    )


# ---------------------------------------------------------------- profiles

# Exported field -> profile column.
EXPORT_FIELDS = {
    "stateId": "state_id",
    "flowCount": "flow_count",
    "avgInBytes": "avg_in_bytes",
    "avgOutBytes": "avg_out_bytes",
    "bytesRatio": "bytes_ratio",
    "avgDurationMs": "avg_duration_ms",
    "avgPktsPerSec": "avg_pkts_per_sec",
}


def profile_documents(profiles: DataFrame, tactics: dict[int, str]) -> DataFrame:
    """Profiles in export form, with the assigned tactic or ``Unassigned``."""
    named = state_tactics(profiles.sparkSession, tactics).withColumnRenamed(STATE, "state_id")
    joined = profiles.join(F.broadcast(named), "state_id", "left")
    return joined.select(
        *[F.col(column).alias(name) for name, column in EXPORT_FIELDS.items()],
        F.struct(
            F.col("tcp_pct").alias("tcp"), F.col("udp_pct").alias("udp"), F.col("icmp_pct").alias("icmp")
        ).alias("protocolDist"),
        F.struct(
            F.col("well_known_pct").alias("wellKnown"),
            F.col("registered_pct").alias("registered"),
            F.col("ephemeral_pct").alias("ephemeral"),
        ).alias("portCategoryDist"),
        F.coalesce("tactic", F.lit("Unassigned")).alias("tactic"),
    )


def export_profiles(profiles: DataFrame, tactics: dict[int, str], out: str) -> None:
    profile_documents(profiles, tactics).write.mode("overwrite").json(out)
