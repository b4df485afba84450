"""Incremental and live versions of ingest, timeline and sessions.

Two kinds of live results: views kept in parts (:func:`keep_view`), which equal the batch operators on all flows seen
so far, and append-only streams (:func:`live_timeline`, :func:`live_sessions`), which give a row out once a watermark
has passed it and never change it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from flowlens.functions.columns import start_time, total_bytes
from flowlens.operators.sessions import MINUTE_MS, gap_sessions
from flowlens.operators.summaries import timeline
from flowlens.schema import END, FLOW_ID, SRC, START, conform
from flowlens.session import located, path_exists
from flowlens.sources.readers import NO_TEXT, map_columns, with_flow_id
from flowlens.sources.writers import BATCH, LOADED, write_flows

def stream_flows(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    format: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Flows from the files of a folder, new ones as they arrive."""
    reader = spark.readStream.schema(schema).format(format)
    if format == "csv":
        reader = reader.option("header", True).option("nullValue", NO_TEXT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return conform(map_columns(reader.load(folder)), fill_missing=False)


def _batches(table_path: str) -> str:
    """Where the batches that are in the table are noted; readers of the table pass over the folder."""
    return f"{table_path}/_batches"


NOTE = "batch int, rows long, next_id long"


def _noted(spark: SparkSession, table_path: str) -> DataFrame:
    return spark.read.schema(NOTE).option("recursiveFileLookup", True).parquet(_batches(table_path))


def _next_id(spark: SparkSession, table_path: str, number: int) -> int:
    """The first free flow id before batch ``number``, the same each time that batch is run."""
    if path_exists(spark, _batches(table_path)):
        noted = _noted(spark, table_path).where(F.col("batch") < number)
        last = noted.agg(F.max("next_id")).first()[0]
        if last is not None:
            return last
    if not path_exists(spark, table_path):
        return 0
    table = spark.read.parquet(table_path)
    if BATCH not in table.columns:
        raise ValueError(f"{table_path} is not laid out for deliveries; load it with for_ingest=True")
    last = table.where(F.col(BATCH) < number).agg(F.max(FLOW_ID)).first()[0]
    return 0 if last is None else last + 1


def _note_batch(spark: SparkSession, table_path: str, number: int, first_id: int) -> None:
    rows, last = 0, None
    if path_exists(spark, table_path):
        mine = spark.read.parquet(table_path).where(F.col(BATCH) == number)
        rows, last = mine.agg(F.count(F.lit(1)), F.max(FLOW_ID)).first()
    following = first_id if last is None else max(first_id, last + 1)
    note = spark.createDataFrame([(number, rows, following)], NOTE)
    note.coalesce(1).write.mode("overwrite").parquet(f"{_batches(table_path)}/{number}")


def ingest_new_files(
    spark: SparkSession,
    folder: str,
    table_path: str,
    checkpoint: str,
    schema: StructType,
    format: str = "parquet",
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Append the files not seen before, then stop.

    The table is partitioned by flow date and by batch: a filter on time prunes dates as in a loaded table, and a
    batch that is run again after a failure replaces its own rows of each date and leaves no duplicates.  A batch is
    noted when all of it is written; :func:`ingested` reads the noted ones.  Ids go on after those of the batch
    before, from any number of tasks.
    """

    def write(batch: DataFrame, number: int) -> None:
        first_id = _next_id(spark, table_path, number)
        write_flows(with_flow_id(batch, first_id), table_path, batch=number)
        _note_batch(spark, table_path, number, first_id)

    return (
        stream_flows(spark, folder, schema, format, files_per_batch)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingested(spark: SparkSession, table_path: str) -> DataFrame:
    """The table without batches that are still being written.

    Batches end in order, so one number divides them, and the comparison prunes partitions.
    """
    last = LOADED
    if path_exists(spark, _batches(table_path)):
        last = _noted(spark, table_path).agg(F.max("batch")).first()[0]
    return spark.read.parquet(table_path).where(F.col(BATCH) <= last).drop(BATCH)


# ------------------------------------------------------------ kept views


def keep_view(
    stream: DataFrame, partial: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Add what is new in a stream to a view that is kept in parts, then stop.

    ``partial`` sums up the rows of one batch by batch operators; parts of different batches can be merged exactly,
    whatever order flows arrive in, so there is no window to close, no late row and no state to hold in memory.  A
    batch that is run again replaces its own part.  Only the columns that ``partial.columns`` names, where it has
    that, are read and held.
    """
    columns = getattr(partial, "columns", None)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.select(*columns) if columns else batch
        batch = batch.persist()  # read several times
        try:
            partial(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def timeline_part(minutes: int = 60) -> Callable[[DataFrame], DataFrame]:
    def part(batch: DataFrame) -> DataFrame:
        return timeline(batch, minutes, ordered=False)

    part.columns = (START, "Attack")
    return part


def sessions_part(gap: int = 30) -> Callable[[DataFrame], DataFrame]:
    """Sessions inside one batch; a source with many flows is cut into time slices, as in the batch operator."""
    def part(batch: DataFrame) -> DataFrame:
        return gap_sessions(batch, gap).drop("session_no")

    part.columns = (FLOW_ID, SRC, START, END, "IN_BYTES", "OUT_BYTES")
    return part


def _merged_upto(spark: SparkSession, path: str) -> int | None:
    """The last batch that whole merged parts cover."""
    place, files = located(spark, f"{path}/merged/*/_SUCCESS")
    found = files.globStatus(place) or []
    return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found), default=None)


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """The parts of a view: merged ones, and those of later batches."""
    upto = _merged_upto(spark, path)
    place, files = located(spark, f"{path}/batch=*")
    later = [
        f.getPath() for f in files.globStatus(place) or []
        if upto is None or int(f.getPath().getName().split("=")[1]) > upto
    ]
    paths = [p.toString() for p in later] + ([] if upto is None else [f"{path}/merged/upto={upto}"])
    if not paths:
        raise FileNotFoundError(f"no parts of a view in {path}")
    return spark.read.parquet(*paths)


def merge_parts(spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame]) -> int:
    """Merge all parts that a view has into one, as batches add up; returns the last batch covered.

    Readers take the merged parts once they are whole and pass over the batches in them, so a merge that fails
    half-way changes nothing.  Run it between batches; what it replaced can be deleted later.
    """
    place, files = located(spark, f"{path}/batch=*")
    last = max(int(f.getPath().getName().split("=")[1]) for f in files.globStatus(place))
    if last != _merged_upto(spark, path):
        merge(_parts(spark, path)).write.mode("overwrite").parquet(f"{path}/merged/upto={last}")
    return last


def merged_timeline(parts: DataFrame) -> DataFrame:
    return parts.groupBy("time", "attack").agg(F.sum("count").alias("count"))


def merged_sessions(gap: int = 30) -> Callable[[DataFrame], DataFrame]:
    """Parts of a source are merged where the next begins at most the gap after the latest start before it.

    That is where the flows of both would be one session.
    """
    gap_ms = gap * MINUTE_MS

    def merge(parts: DataFrame) -> DataFrame:
        order = Window.partitionBy("src_ip").orderBy("session_start", "last_start")
        before = F.max("last_start").over(order.rowsBetween(Window.unboundedPreceding, -1))
        new = F.when(F.col("session_start") - before <= gap_ms, 0).otherwise(1)
        return (
            parts.withColumn("_new", new)
            .withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("src_ip", "_run")
            .agg(
                F.min("session_start").alias("session_start"),
                F.max("last_start").alias("last_start"),
                F.max("session_end").alias("session_end"),
                F.sum("flow_count").alias("flow_count"),
                F.sum("total_bytes").alias("total_bytes"),
            )
            .drop("_run")
        )

    return merge


def timeline_view(spark: SparkSession, path: str, minutes: int = 60, until: int | None = None) -> DataFrame:
    """time, attack, count of all flows seen so far; ``until`` (ms) leaves out windows that end later."""
    parts = _parts(spark, path)
    if until is not None:
        parts = parts.where(F.col("time") + F.lit(minutes * MINUTE_MS) <= until)
    return merged_timeline(parts)


def sessions_view(spark: SparkSession, path: str, gap: int = 30, until: int | None = None) -> DataFrame:
    """Idle-gap sessions of all flows seen so far; ``until`` (ms) leaves out those that could still go on then."""
    merged = merged_sessions(gap)(_parts(spark, path))
    return merged if until is None else merged.where(F.col("last_start") + F.lit(gap * MINUTE_MS) < until)


# ---------------------------------------------------- append-only streams


def live_timeline(
    flows: DataFrame, minutes: int = 60, lateness: str = "10 minutes"
) -> DataFrame:
    """Counts per window and attack, for a streaming (or a static) table.

    In append mode a window is given out once the watermark has passed it; later rows of it are dropped.
    """
    timed = flows.withColumn("ts", start_time())
    if flows.isStreaming:
        timed = timed.withWatermark("ts", lateness)
    return (
        timed.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), F.col("Attack").alias("attack"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.unix_millis("w.start").alias("time"), "attack", "count")
    )


def live_sessions(flows: DataFrame, gap: int = 30, lateness: str = "10 minutes") -> DataFrame:
    """Idle-gap sessions per source, for a streaming (or a static) table.

    Sessions are merged inside each task before the shuffle, so that a busy
    source sends its sessions and not its flows to one place.
    """
    flows.sparkSession.conf.set(
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true"
    )
    timed = flows.withColumn("ts", start_time())
    if flows.isStreaming:
        timed = timed.withWatermark("ts", lateness)
    return (
        timed.groupBy(F.session_window("ts", f"{gap} minutes").alias("w"), F.col(SRC).alias("src_ip"))
        .agg(
            F.min(START).alias("session_start"),
            F.max(START).alias("last_start"),
            F.max(END).alias("session_end"),
            F.count(F.lit(1)).alias("flow_count"),
            F.sum(total_bytes()).alias("total_bytes"),
        )
        .drop("w")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Process what is available into Parquet and return the table."""
    q = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
