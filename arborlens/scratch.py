"""Tables written on the way, to cut the lineage of iterative and multi-pass operators.

They lie in the folder named by ``spark.checkpoint.dir``, which all executors share, so that losing an
executor costs no more than the tasks it was running. Where the session names no folder (tests, local
use) a temporary one is set. What an application wrote is deleted when its Python process ends.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that are written on the way."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="arborlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, deleted with the others."""
    path = f"{shared_folder(spark)}/arborlens/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clear)
    _written.append((spark, path))
    return path


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and return the table, whose lineage is that file.

    Everything that reads the result sees the same rows, even where ``df`` itself would give others when
    run again (range partitioning draws its bounds from a sample).
    """
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["_written_at"] = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that :func:`cut` returned and nothing reads any more, such as those of a past round."""
    gone = {t.__dict__.get("_written_at") for t in tables}
    for entry in [e for e in _written if e[1] in gone]:
        _written.remove(entry)
        _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the JVM may be gone already
        pass


def clear() -> None:
    """Delete every table that :func:`cut` wrote in this process."""
    while _written:
        _delete(*_written.pop())
