"""Time slices of equal depth, for ordered operators on skewed keys.

``lag`` over "all flows of one destination" puts that destination in one task.
When a destination (or the whole table, for a global order) may hold a third of
all rows, the order is cut into slices that hold about the same number of rows
each; the window then runs inside (key, slice), and one carried row per (key,
slice) brings in what the previous slice ended with.  Results are those of the
undivided window.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from flowlens.schema import FLOW_ID, START

SLICE = "_slice"
ROWS_PER_SLICE = 4_000_000


def _bucket_column(df: DataFrame, column: str, bounds: list[float], alias: str) -> DataFrame:
    if not bounds:
        return df.withColumn(alias, F.lit(0))
    edge = float("inf")
    cut = Bucketizer(
        splits=[-edge, *bounds, edge], inputCol="_cut", outputCol="_bin", handleInvalid="keep"
    )
    binned = cut.transform(df.withColumn("_cut", F.col(column).cast("double")))
    # rows without a value form a bucket of their own in front
    return binned.withColumn(alias, F.coalesce(F.col("_bin").cast("int"), F.lit(-1))).drop(
        "_cut", "_bin"
    )


@dataclass
class TimeSlices:
    """Cut points on the start time; inside a crowded instant, on the flow id."""

    bounds: list[float] = field(default_factory=list)
    crowded: list[int] = field(default_factory=list)
    id_bounds: list[float] = field(default_factory=list)

    @property
    def single(self) -> bool:
        return not self.bounds

    def attach(self, df: DataFrame) -> DataFrame:
        """Add the slice number; it grows with (start, flow id)."""
        df = _bucket_column(df, START, self.bounds, SLICE)
        if not self.crowded:
            return df
        df = _bucket_column(df, FLOW_ID, self.id_bounds, "_sub")
        sub = F.when(F.col(START).isin(*self.crowded), F.col("_sub") + 1).otherwise(0)
        return df.withColumn(SLICE, F.col(SLICE) * (len(self.id_bounds) + 2) + sub).drop("_sub")


def _busy(spark: SparkSession) -> int:
    """Enough slices to keep the cluster busy: twice the partitions, so that hashing them spreads them evenly."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _marks(column: str, count: int) -> Column:
    """The cut points of ``count`` slices (of more than one), by a quantile sketch."""
    return F.percentile_approx(column, [i / count for i in range(1, count)], max(1000, 4 * count))


def time_slices(
    df: DataFrame, rows_per_slice: int = ROWS_PER_SLICE, min_slices: int | None = None
) -> TimeSlices:
    """Choose slices by the row count and a quantile sketch of the starts, both from one pass.

    The sketch is as fine as a busy cluster needs and is thinned for fewer slices; a
    table that needs more is sketched again.
    """
    spark = df.sparkSession
    busy = _busy(spark)
    n, marks = df.agg(F.count(F.lit(1)), _marks(START, busy)).first()
    marks = marks or []
    if min_slices is None:
        # not so many for a handful of rows
        min_slices = min(busy, max(spark.sparkContext.defaultParallelism, n // 10_000))
    count = max(1, min_slices, -(-n // rows_per_slice))
    if count > busy:
        marks = df.agg(_marks(START, count)).first()[0] or []
    else:
        step = busy // count
        marks = marks[step - 1 :: step]
    if not marks:
        return TimeSlices()
    crowded = sorted({a for a, b in zip(marks, marks[1:]) if a == b})
    bounds = sorted(set(marks) | {c + 1 for c in crowded})
    id_bounds: list[float] = []
    if crowded and FLOW_ID in df.columns:
        ids = df.where(F.col(START).isin(*crowded)).agg(_marks(FLOW_ID, count)).first()[0]
        id_bounds = sorted({float(i) for i in ids or []})
    return TimeSlices([float(b) for b in bounds], crowded if id_bounds else [], id_bounds)


def with_previous_start(
    df: DataFrame, by: list[str], alias: str, slices: TimeSlices | None = None
) -> DataFrame:
    """Add the start of the previous flow with the same ``by`` values."""
    slices = slices or time_slices(df)
    order = [F.col(START).asc(), F.col(FLOW_ID).asc()]
    if slices.single:
        return df.withColumn(alias, F.lag(START).over(Window.partitionBy(*by).orderBy(*order)))
    sliced = slices.attach(df)
    ends = sliced.groupBy(*by, SLICE).agg(F.max(START).alias("_end"))
    carried = (
        ends.withColumn("_from", F.lag("_end").over(Window.partitionBy(*by).orderBy(SLICE)))
        .where(F.col("_from").isNotNull())
        .select(*by, SLICE, F.col("_from").alias(START), F.lit(1).alias("_carried"))
    )
    both = sliced.withColumn("_carried", F.lit(0)).unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy(*by, SLICE).orderBy(F.col("_carried").desc(), *order)
    return (
        both.withColumn(alias, F.lag(START).over(w))
        .where(F.col("_carried") == 0)
        .drop("_carried", SLICE)
    )


def gap_sums(
    df: DataFrame, by: list[str], per: str, alias: str, slices: TimeSlices | None = None
) -> DataFrame:
    """Per value of ``per``, the sum of the gaps between its flows and the previous flow with the same ``by`` values.

    The sums of :func:`with_previous_start`, from one pass: a slice's first flow waits
    with its start and the slice's last one, and takes its gap where the (key, slice)
    rows meet.  All other flows are summed up where they are ordered.
    """
    slices = slices or time_slices(df)
    sliced = slices.attach(df.select(per, *by, START, FLOW_ID))
    # the slice first: it tells rows apart at less cost than addresses
    inside = Window.partitionBy(SLICE, *by).orderBy(F.col(START).asc(), F.col(FLOW_ID).asc())
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.col("_first")
    ordered = sliced.select(
        per, *by, SLICE, START,
        F.lag(START).over(inside).alias("_previous"),
        F.last(START).over(whole).alias("_end"),
        (F.row_number().over(inside) == 1).alias("_first"),
    )
    # a row for each value of ``per``, without slice, and one for each (key, slice)
    parts = ordered.groupBy(per, *[F.when(first, F.col(c)).alias(c) for c in (*by, SLICE)]).agg(
        F.sum((F.col(START) - F.col("_previous")).cast("double")).alias("_gaps"),
        F.max(F.when(first, F.col(START))).alias("_start"),
        F.max(F.when(first, F.col("_end"))).alias("_end"),
    )
    along = Window.partitionBy(*by, F.when(F.col(SLICE).isNull(), F.col(per))).orderBy(SLICE)
    across = (F.col("_start") - F.lag("_end").over(along)).cast("double")
    return (
        parts.select(per, (F.coalesce("_gaps", F.lit(0.0)) + F.coalesce(across, F.lit(0.0))).alias(alias))
        .groupBy(per)
        .agg(F.sum(alias).alias(alias))
    )
