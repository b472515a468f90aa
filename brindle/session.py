"""Session helper and the shared-folder convention used by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(cores: str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A local session with the settings the tests and the benchmark rely on."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("brindle")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset a temporary one is made, but only on a local master: on a
    cluster such a folder would be another one on every machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = jdir.get() if jdir.isDefined() else None
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        path = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.sparkContext.setCheckpointDir(path)
    return path


_written: list[str] = []


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage ends at a table that
    outlives any executor. ``discard`` or ``release`` removes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._brindle_path = path
    _written.append(path)
    return back


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Remove a table that ``materialise`` wrote and nothing reads any more."""
    path = getattr(df, "_brindle_path", None)
    if path in _written:
        _written.remove(path)
        remove_path(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Remove every table that ``materialise`` wrote in this process. Results that haven't been written yet read them: call it at the end of a job."""
    while _written:
        remove_path(spark, _written.pop())
