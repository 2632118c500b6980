"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


#: Folders of applications that name none, by application id.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.  Where that is unset: a new temporary one with a local master, else a ValueError."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _OWN.setdefault(context.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="shelfmark-")
        _OWN[context.applicationId] = found
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, *partition_by: str, schema: StructType | None = None) -> DataFrame:
    """Write df as zstd Parquet into the shared folder and read it back: lineage ends there and survives lost executors.

    With partition_by, each task writes its rows into folders by those columns, so that filters read only what they need.
    With schema, the table is read as that (a type stored as its parts comes back as the type).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=list(partition_by) or None)
    out = spark.read.schema(schema or df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialise wrote, once nothing that is still to run reads it."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
