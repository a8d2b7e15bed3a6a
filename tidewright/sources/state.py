"""State tables as Parquet versions with a pointer to the current one.

A new version is a directory of its own; the pointer is a small table written after it. A
reader sees whole versions, and a failed writer leaves the pointer where it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewright.sources.scratch import written


class StateTable:
    """One writer, any readers; path is on storage that all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _pointers(self) -> DataFrame | None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointers")
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema("version long").parquet(f"{self.path}/pointers") if found else None

    def version(self) -> int:
        pointers = self._pointers()
        return 0 if pointers is None else pointers.agg(F.max("version")).first()[0] or 0

    def read(self, version: int | None = None) -> DataFrame:
        at = self.version() if version is None else version
        if at == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{at}")

    def write(self, rows: DataFrame, partition_by: list[str] | None = None, move: bool = True) -> int:
        """Writes the next version and, unless told otherwise, moves the pointer; returns the version."""
        at = self.version() + 1
        writer = rows.select(*self.schema.names).write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/v{at}")
        if move:
            self.move(at)
        return at

    def move(self, at: int) -> None:
        """Makes a written version the current one."""
        self.spark.range(1).select(F.lit(at).cast("long").alias("version")).coalesce(1).write.mode("append").parquet(f"{self.path}/pointers")

    def write_if_changed(self, rows: DataFrame) -> bool:
        """Writes a version unless the rows are those of the current one, as a multiset. Both are counted by whole rows, so no difference is missed."""
        after = written(rows.select(*self.schema.names), "candidate")
        both = after.withColumn("_n", F.lit(1)).unionByName(self.read().withColumn("_n", F.lit(-1)))
        if not both.groupBy(*self.schema.names).agg(F.sum("_n").alias("_n")).filter("_n <> 0").limit(1).count():
            return False
        self.write(after)
        return True

    def prune(self, keep: int = 2) -> int:
        """Deletes versions but the last `keep`; returns how many went. Readers of older ones must be done."""
        if keep < 1:
            raise ValueError("the current version stays")
        jvm = self.spark._jvm.org.apache.hadoop.fs
        system = jvm.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone, at = 0, self.version() - keep
        while at > 0 and system.delete(jvm.Path(f"{self.path}/v{at}"), True):  # older ones went before
            gone, at = gone + 1, at - 1
        return gone
