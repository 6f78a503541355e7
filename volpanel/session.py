"""Session settings and the shared scratch folder every staged table lives in."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, app: str = "volpanel", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_local_dirs: dict[str, str] = {}
_owners: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a fresh local one only in local mode where that is unset."""
    path = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="volpanel-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, never reused path in the shared folder, inside the innermost ``staging`` block's own folder."""
    folder = _owners[-1] if _owners else f"{shared_dir(spark)}/volpanel"
    return f"{folder}/{label}-{uuid.uuid4().hex}"


@contextmanager
def staging(spark: SparkSession) -> Iterator[str]:
    """Owner of everything staged inside the block: its folder goes when the block ends.

    Write a result inside the block, to a path taken outside of it; frames made inside can't be read afterwards.
    """
    folder = scratch_path(spark, "run")
    _owners.append(folder)
    try:
        yield folder
    finally:
        _owners.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a frame feeds two branches (fit and predict, counts and rows): the raw tables are then
    scanned once, the result outlives lost executors, later branches prune columns, and the planner
    knows the true size before it considers a broadcast.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_alone(spark: SparkSession, make: Callable[[], DataFrame], label: str = "stage") -> DataFrame:
    """``stage`` of what ``make`` returns; all that it staged itself on the way goes as soon as that is written."""
    path = scratch_path(spark, label)
    with staging(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Queries run inside hand their Python functions so many rows at once; for texts, which are long."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(setting, before)
