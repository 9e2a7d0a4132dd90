"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode without one, a temporary folder of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="recallgrid-"))
        atexit.register(shutil.rmtree, _local_root[0], ignore_errors=True)
    return _local_root[0]


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, whoever is lost later."""
    path = f"{shared_root(df.sparkSession)}/recallgrid/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``stored`` wrote, once nothing that is still to run reads them; others are left alone."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path is not None:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
