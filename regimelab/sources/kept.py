"""Tables that many queries read: written once for the files that they come from, and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_PATHS: dict[tuple, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share; a temporary one only where a local session names none."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="regimelab-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _status(spark: SparkSession, path: str):
    """Length and time of a file or folder, or None, as Spark's own file systems see it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return None
    return int(system.getContentSummary(at).getLength()), int(system.getFileStatus(at).getModificationTime())


def kept(spark: SparkSession, name: str, sources: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """build()'s rows as a Parquet table in the shared folder, made anew when a source is another file, or the table is gone."""
    key = (spark.sparkContext.applicationId, name, *((s, _status(spark, s)) for s in sources))
    path = _PATHS.get(key)
    if path is None or _status(spark, path) is None:
        path = fresh_folder(spark, name)
        build().write.parquet(path)
        _PATHS[key] = path
    return spark.read.parquet(path)
