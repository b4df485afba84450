"""Session settings and shared scratch storage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators are written for.  All can be changed on a
# live session; none changes a result.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # collect_set over many small groups: stay hash-based instead of falling
    # back to a sort after 128 groups.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "200000",
    # The JVM never compiles a method of over 8000 bytes: a filter on a long
    # CASE would be interpreted row by row.  Such stages run operator by operator.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A task that writes into few folders (dates, weeks) keeps a file open in each;
    # it sorts, and spills, only the rows of further folders.
    "spark.sql.maxConcurrentOutputFileWriters": "4",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return _with_package(spark)


def _with_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, where they can reach that place.

    Workers on other machines need it shipped (``--py-files``) or installed.
    """
    place = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if place not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, place])
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "flowlens"):
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def storage_memory(spark: SparkSession) -> int:
    """Bytes that the running executors have for cached tables, at most."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().iterator()
    sizes = []
    while status.hasNext():
        sizes.append(status.next()._2()._1())
    return sum(sizes)


_test_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Without ``spark.checkpoint.dir`` only a local session (a test) gets one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _test_dirs:
        _test_dirs[app] = tempfile.mkdtemp(prefix="flowlens-")
        atexit.register(shutil.rmtree, _test_dirs[app], ignore_errors=True)
    return _test_dirs[app]


_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path inside :func:`shared_dir`."""
    path = f"{shared_dir(spark)}/flowlens/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete what this process has written to scratch paths; returns how many there were.

    Call it once the results that were wanted are stored elsewhere: tables returned by the operators may still read
    their scratch files.
    """
    gone = 0
    while _scratch:
        place, files = located(spark, _scratch.pop())
        gone += bool(files.exists(place) and files.delete(place, True))
    return gone


def located(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop objects."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    place, files = located(spark, path)
    return bool(files.exists(place))


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries run inside delete their shuffle files as they end; for writes, whose rows nothing computes again."""
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def materialize(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in shared storage and read it back.

    Used where a result is needed by several later jobs: it cuts the lineage,
    survives lost executors and keeps column pruning for the readers.
    ``drop_shuffles`` frees the disk of its shuffles at once, not when the driver's
    memory is next cleaned up; for tables of the size of the input.
    """
    path = scratch_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession) if drop_shuffles else nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
