"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of local sessions without the setting.
_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local one without it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:  # the setting itself can't be changed in a running session
            _LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='quarrystat-')}"
        found = _LOCAL[app]
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: lineage is cut and executors may be lost."""
    path = f"{scratch_dir(df.sparkSession)}/quarrystat/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> bool:
    """Remove all intermediate tables of this library from the shared folder; call it when no result that reads them is left."""
    jvm, path = spark.sparkContext._jvm, f"{scratch_dir(spark)}/quarrystat"
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
