"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where it is unset, a local session gets one of its own; a cluster has none to offer."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-quill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Staged:
    """Tables written to the shared folder by one operator; ``drop`` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{scratch_dir(spark)}/quill-{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it again: cuts lineage, survives lost executors."""
        path = f"{self.root}/{uuid.uuid4().hex[:8]}-{name}"
        df.write.parquet(path)
        nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
        out = self.spark.read.schema(nullable).parquet(path)
        out._staged_at = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        """Of ``frames`` those that were put here; all folders of this operator without ``frames``."""
        for path in [f._staged_at for f in frames if f is not None] if frames else [self.root]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    @classmethod
    def release(cls, *frames: DataFrame) -> None:
        """Remove staged tables, with their operator's folder if nothing else is in it, when their readers are done."""
        for frame in frames:
            if (path := getattr(frame, "_staged_at", None)) is not None:
                at = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                fs = at.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration())
                fs.delete(at, True)
                if fs.exists(at.getParent()) and not fs.listStatus(at.getParent()):
                    fs.delete(at.getParent(), False)
