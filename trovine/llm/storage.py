"""Tables that a multi-pass operator writes once and reads again, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of tables that this process has written, in order.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests, notebooks) a local folder is made and set as the
    checkpoint folder; on a cluster that is an error, as executors share no local folder.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        option = context._jsc.sc().getCheckpointDir()
        named = option.get() if option.isDefined() else None
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="trovine-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def new_folder(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A fresh path below the shared folder; nothing is created yet. Unless ``keep``, it is removed when the session's
    process ends, or by ``release``."""
    path = f"{shared_dir(spark)}/trovine/{label}-{uuid.uuid4().hex}"
    if not keep:
        _made.append(path)
        fs, target = _file_system(spark, path)
        fs.deleteOnExit(target)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    This cuts the lineage: a lost executor costs a read, not the work before it, and the plan does not run twice.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time for ``release``."""
    return len(_made)


def release(spark: SparkSession, since: int, until: int | None = None) -> None:
    """Removes the tables made from mark ``since`` on, up to mark ``until``: those that no later step reads."""
    for path in _made[since:until]:
        fs, target = _file_system(spark, path)
        fs.delete(target, True)
    del _made[since:until]
