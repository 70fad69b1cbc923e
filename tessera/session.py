"""Session construction, testdata adapter and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType


def local_session(cores: int = 8, app: str = "tessera") -> SparkSession:
    """A single-JVM session for tests and benchmarks; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``; reads any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Smaller inputs are not worth an exchange.
SPREAD_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly if its scan has fewer partitions than the session has cores.

    One Parquet file with one row group is one task; a corpus of many files is left as it is.
    """
    execution, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    size = int(execution.optimizedPlan().stats().sizeInBytes())
    if size < SPREAD_BYTES or execution.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores)


#: Bytes of a scan that a task takes of rows dealt by key: Spark's own tasks of an exchange grow until 64 MB of compressed rows, and
#: what a group or a window holds of these is many times that.
DEAL_BYTES = 2 << 20


def dealt(df: DataFrame, key: str, scan: DataFrame | None = None) -> DataFrame:
    """``df`` dealt by ``key`` to tasks of about ``DEAL_BYTES`` of its scan: their number grows with the input, not their size.

    ``scan`` is what is scanned where ``df`` is far from it; frames of one scan are dealt to the same tasks.
    """
    size = int((df if scan is None else scan)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // DEAL_BYTES)), key)


#: Bytes of one Arrow batch between Spark and a Python worker. Rows of the operators hold whole texts and blocks of
#: sets: a batch that only counts rows would grow with them.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, unless it has a smaller bound already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = spark.conf.get(key, None)
    if found is None or not found.isdigit() or int(found) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


@contextmanager
def batches_of(spark: SparkSession, most: int):
    """Arrow batches of about ``most`` bytes for the jobs that run inside; the session's own bound is back afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a session that runs in one machine's JVM; others are refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _OWN_DIR[app].removeprefix("file://"), ignore_errors=True)
    return _OWN_DIR[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex[:12]}"


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row: an order among rows that doesn't depend on partitions but for equal rows."""
    simple = lambda c: isinstance(df.schema[c].dataType, AtomicType)
    return F.xxhash64(*(F.col(c) if simple(c) else F.to_json(F.struct(c)) for c in df.columns))


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file through the Hadoop file system of its path; an old one is replaced."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(text.encode("utf-8"))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file through the Hadoop file system of its path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def list_ages(spark: SparkSession, path: str) -> dict[str, float]:
    """Names in a folder with the seconds since each was changed; none where it isn't there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    now = time.time()
    return {s.getPath().getName(): now - s.getModificationTime() / 1000 for s in system.listStatus(target)} if system.exists(target) else {}


def list_names(spark: SparkSession, path: str) -> list[str]:
    return list(list_ages(spark, path))


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file under a name that nobody has yet, whole or not at all; False if the name is taken.

    On a POSIX file system a hard link takes the name, elsewhere a rename without overwriting, which HDFS decides at its
    name node; an object store without such a rename needs its own conditional put here.
    """
    context = spark.sparkContext
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    system = target.getFileSystem(conf)
    write_text(spark, aside.toString(), text)
    try:
        if system.getUri().getScheme() == "file":
            there = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(there(target), there(aside))
        else:
            rename = jvm.org.apache.hadoop.fs.Options.Rename
            options = context._gateway.new_array(rename, 1)
            options[0] = rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(aside, target, options)
        return True
    except Exception as error:
        if "FileAlreadyExists" not in str(error):
            raise
        return False
    finally:
        system.delete(aside, False)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI with the scheme that Spark resolves it by, so that other readers find the same place."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return re.sub(r"^file:/+", "file:///", found)


#: Tasks a core that write a result marked ``few``, at most.
FEW_A_CORE = 4


@contextmanager
def setting(spark: SparkSession, **values: str):
    """Settings of the session (``__`` for a dot) for the jobs that run inside; those before are back afterwards."""
    values = {key.replace("__", "."): value for key, value in values.items()}
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


#: Spark deletes the shuffle files of a query as soon as it is done. Else they wait for the driver's garbage collection, and
#: a driver with much memory keeps those of all jobs.
CLEANED = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}


#: No join collects a side in the driver.
EXCHANGED = {"spark__sql__autoBroadcastJoinThreshold": "-1", "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1"}


#: Joins take rows where they are if these are dealt by a part of the join's keys already.
TOGETHER = {"spark__sql__requireAllClusterKeysForCoPartition": "false"}
#: Rows of one key that a task may take.
HOT = 1_000_000


@contextmanager
def together(rows: DataFrame, key: str):
    """A function that deals frames by ``key``, for jobs inside whose joins and groups all have ``key`` among their keys.

    Each frame is then exchanged once, and what is joined to it stays in its place. Where a key has more than ``HOT`` of
    ``rows``, the function does nothing and each join deals its rows by all of its keys, so that no task takes such a key.
    """
    if rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).limit(1).count():
        yield lambda df: df
        return
    with setting(rows.sparkSession, **TOGETHER):
        yield lambda df: df.repartition(key)


def cut(df: DataFrame, name: str = "cut", compression: str = "zstd", few: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.

    ``few`` is for results of an exchange that are small next to the input: a fixed number of tasks a core writes
    them, so that many shuffle partitions don't become as many tiny files. The shuffle files of the job go with it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    rows = df.coalesce(FEW_A_CORE * spark.sparkContext.defaultParallelism) if few else df
    with setting(spark, **CLEANED):
        rows.write.option("compression", compression).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._cut_path = path
    return found


def drop_cut(*frames: DataFrame) -> None:
    """Delete what :func:`cut` wrote for ``frames``; for state that nothing reads any more."""
    for frame in frames:
        if (path := getattr(frame, "_cut_path", None)) is not None:
            drop_path(frame.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`fresh_path` through the Hadoop file system of its scheme."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
