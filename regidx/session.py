"""Session settings, shared scratch space and file-system helpers."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(app_name: str = "regidx", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the jobs expect; callers may override any of them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.sql.parquet.filterPushdown": "true",
        # Long text-cleaning chains: methods above 8000 bytes of bytecode are never compiled by the JIT.
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _setting(spark: SparkSession, key: str) -> str | None:
    value = spark.conf.get(key, None)
    return value or spark.sparkContext.getConf().get(key, None)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A machine-local folder is used only on a local master with the setting
    absent (tests); on a cluster every executor must see the same files.
    """
    configured = _setting(spark, CHECKPOINT_SETTING)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="regidx-")
    spark.conf.set(CHECKPOINT_SETTING, folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nobody else uses, below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def through_storage(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once and return the stored copy: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(stored: DataFrame) -> None:
    """Delete the files of a frame from ``through_storage``, once all that reads it has been stored itself."""
    for folder in {name.rsplit("/", 1)[0] for name in stored.inputFiles()}:
        remove_path(stored.sparkSession, unquote(folder))


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Files or folders matching a glob, sorted; empty when there are none."""
    fs, hadoop_path = _hadoop_path(spark, pattern)
    found = fs.globStatus(hadoop_path)
    return sorted(status.getPath().toString() for status in found) if found else []


def remove_path(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _hadoop_path(spark, path)
    return fs.delete(hadoop_path, True)


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; False, and nothing changed, if it is there already."""
    fs, hadoop_path = _hadoop_path(spark, path)
    fs.mkdirs(hadoop_path.getParent())
    try:
        stream = fs.create(hadoop_path, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    fs, hadoop_path = _hadoop_path(spark, path)
    stream = fs.open(hadoop_path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def empty_frame(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)
