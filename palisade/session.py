"""Session helpers: reliable checkpoints and scratch tables in the shared folder."""

import contextlib
import io
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only for local sessions without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="palisade-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` once to reliable storage and go on from there (cuts the lineage)."""
    folder = shared_folder(df.sparkSession)
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint()


def packed(df: DataFrame, path: str | None = None) -> DataFrame:
    """Like ``checkpointed``, for wide rows: compressed columns, of which a reader takes only what it needs.

    Times are stored as numbers, as Parquet may move them to another calendar. Types that it does not hold go into a
    checkpoint. Shuffle files of the rows are gone when they are stored.
    """
    kinds = {f.dataType.typeName() for f in df.schema.fields}
    names = [c.lower() for c in df.columns]
    if kinds - PACKED_TYPES or len(set(names)) < len(names):
        return checkpointed(df)
    spark, path = df.sparkSession, path or scratch_path(df.sparkSession, "packed")
    times = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    plain = df.withColumns({c: F.unix_micros(F.col(f"`{c}`")) for c in times}) if times else df
    with shuffles_removed(spark):
        plain.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(plain.schema).parquet(path)
    return stored.withColumns({c: F.timestamp_micros(F.col(f"`{c}`")) for c in times}) if times else stored


PACKED_TYPES = {"long", "integer", "short", "byte", "double", "float", "boolean", "string", "decimal", "timestamp_ntz", "timestamp"}


@contextlib.contextmanager
def packed_for(df: DataFrame):
    """``packed`` rows inside the block; their folder goes when it ends."""
    path = scratch_path(df.sparkSession, "packed")
    try:
        yield packed(df, path)
    finally:
        remove_path(df.sparkSession, path)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of the jobs inside the block go when each job ends, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored_bytes(df: DataFrame) -> int:
    """Size of the files that a plain scan reads."""
    spark, total = df.sparkSession, 0
    for name in df.inputFiles():
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        total += target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).getLen()
    return total


def spread(df: DataFrame, task_bytes: int | None = None) -> DataFrame:
    """Deal rows out evenly when a plain scan has fewer partitions than the cluster has cores.

    ``task_bytes`` bounds the stored bytes of a task, for rows that grow much when they are parsed.

    A few small files would otherwise leave costly per-row work to a few tasks. Large inputs have more
    partitions than cores and pass through without a shuffle.
    """
    if df.isStreaming:
        return df
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if task_bytes:
        wanted = max(wanted, -(-stored_bytes(df) // task_bytes))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


SMALL_ROWS = 200_000


def small_side(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df``, stored and counted; marked for broadcast when it has at most so many rows (the join is exact either way)."""
    kept = checkpointed(df)
    return F.broadcast(kept) if kept.count() <= rows else kept


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark can read."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders inside a folder; none when it is not there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in store.listStatus(target)) if store.exists(target) else []


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One small file of a given name, in any store that Spark can write."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def tasks_for(spark: SparkSession, groups: int) -> int:
    """Tasks for Python work on small groups, which adaptive execution would put into one task."""
    return max(1, min(groups, spark.sparkContext.defaultParallelism * 2))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package when it is not installed on them; once per application.

    The archive lies in the shared folder, from where Spark hands it to every executor.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    home = pathlib.Path(__file__).parent
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted(home.rglob("*.py")):
            packed.write(source, f"{home.name}/{source.relative_to(home)}")
    target = f"{scratch_path(spark, 'package')}/{home.name}.zip"
    path = context._jvm.org.apache.hadoop.fs.Path(target)
    stream = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(archive.getvalue()))
    stream.close()
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)
