"""Tables that are computed once and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: list[str] = []
_LOCAL: list[str] = []  # the folder of a local session without the setting


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir.  Only a local session may do without that setting."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _LOCAL[:] = _LOCAL or [tempfile.mkdtemp(prefix="spellwise-")]
        top = _LOCAL[0]
    _FOLDERS.append(f"{top.rstrip('/')}/{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def forget(spark: SparkSession) -> None:
    """Deletes the folders made so far.  Results that still read them must be written elsewhere before."""
    while _FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there and lost executors cost nothing of it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
