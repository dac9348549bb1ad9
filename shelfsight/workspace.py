"""Shared folder for written intermediate tables, and a session for local work."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LARGE_PARTITION_BYTES = 256 * 1024 * 1024
SMALL_PARTITION_BYTES = 1024 * 1024


def local_session(cores: int | str = "*", app: str = "shelfsight") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder chosen by setCheckpointDir, else the one the cluster names in
    spark.checkpoint.dir.

    A local master may go without and gets a temporary folder; on a cluster that would
    not be visible to every executor, so there the setting is required.
    """
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="shelfsight-")
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    # Spark adds a folder of its own to the chosen one; every call gives that.
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, unique to this application and call."""
    app = spark.sparkContext.applicationId
    return os.path.join(shared_folder(spark), "shelfsight", app, f"{label}-{uuid.uuid4().hex}")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives
    executor loss, and fixes non-deterministic columns such as partition ids."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _file_system(spark, path)
    return fs.exists(hadoop_path)


def delete(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _file_system(spark, path)
    fs.delete(hadoop_path, True)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names of files and folders right below ``folder``; none if it is missing."""
    fs, hadoop_path = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop_path)) if fs.exists(hadoop_path) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file whole."""
    fs, hadoop_path = _file_system(spark, path)
    stream = fs.open(hadoop_path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text file beside ``path`` and renames it over it: readers see the old text or the new."""
    new = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, hadoop_path = _file_system(spark, new)
    stream = fs.create(hadoop_path, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    replace_file(spark, new, path)


def replace_file(spark: SparkSession, new: str, path: str) -> None:
    """Renames a file over ``path``."""
    jvm = spark._jvm
    kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    overwrite = jvm.java.lang.reflect.Array.newInstance(kind, 1)
    overwrite[0] = jvm.java.lang.Enum.valueOf(kind, "OVERWRITE")
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (new, path))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(source, target, overwrite)


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The file, the files right below the folder, or those of all that match the pattern; hidden ones are left out."""
    fs, hadoop_path = _file_system(spark, path)
    found = fs.globStatus(hadoop_path)
    if not found:
        raise FileNotFoundError(path)
    below = [s for status in found for s in ([status] if status.isFile() else fs.listStatus(status.getPath()))]
    return sorted(s.getPath().toString() for s in below if s.isFile() and not s.getPath().getName().startswith(("_", ".")))


def first_line(spark: SparkSession, path: str) -> str | None:
    """First line of a text file, unpacked if its name says that it is compressed; None if it is empty."""
    fs, hadoop_path = _file_system(spark, path)
    stream = fs.open(hadoop_path)
    try:
        codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(
            spark._jsc.hadoopConfiguration()
        ).getCodec(hadoop_path)
        data = codec.createInputStream(stream) if codec is not None else stream
        return spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(data, "UTF-8")).readLine()
    finally:
        stream.close()


def discard(*frames: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more. Other tables are left alone."""
    for frame in frames:
        spark = frame.sparkSession
        own = f"/shelfsight/{spark.sparkContext.applicationId}/"
        for folder in {os.path.dirname(path) for path in frame.inputFiles()}:
            if own in folder:
                delete(spark, folder)


def _summary(spark: SparkSession, path: str):
    fs, hadoop_path = _file_system(spark, path)
    return fs.getContentSummary(hadoop_path), fs.getFileStatus(hadoop_path)


def fingerprint(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Bytes, file count and modification time: changes when the data is replaced."""
    content, status = _summary(spark, path)
    return content.getLength(), content.getFileCount(), status.getModificationTime()


def partitions_for(spark: SparkSession, path: str) -> int:
    """Partitions for rewriting a table of this stored size: of a fixed size when it is
    large, and enough to occupy the available cores when it is small."""
    stored = _summary(spark, path)[0].getLength()
    cores = spark.sparkContext.defaultParallelism
    spread = min(cores, math.ceil(stored / SMALL_PARTITION_BYTES))
    return max(1, spread, math.ceil(stored / LARGE_PARTITION_BYTES))
