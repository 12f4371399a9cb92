"""A table that stream batches upsert: a base, and a folder for each batch since.

A batch writes the rows it changes into a folder of its own, anew if it is
repeated after a loss. Every so many batches the folders are folded into a new
base and deleted, so that a read never opens more than ``every`` of them. What
is folded in stays as it is: a repeated batch that the base already holds
writes nothing. A base counts once its write has ended. One writer at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Upserts:
    """Rows by ``keys`` (the last batch that wrote a key has its row), or all rows where there are none."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: tuple[str, ...] = (), every: int = 8):
        self.spark, self.path, self.schema, self.keys, self.every = spark, path, schema, keys, every

    def _folders(self) -> tuple[int | None, list[int]]:
        """Number of the newest whole base, and of the whole batches since."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return None, []
        names = [x.getPath().getName() for x in fs.listStatus(top)]
        whole = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        numbers = lambda kind: sorted(int(n.partition("=")[2]) for n in whole if n.startswith(f"{kind}="))
        base = max(numbers("base"), default=None)
        return base, [k for k in numbers("batch") if base is None or k > base]

    def put(self, rows: DataFrame, k: int) -> None:
        """The rows that batch k changes."""
        base, _ = self._folders()
        if base is not None and k <= base:
            return
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/batch={k}")
        base, batches = self._folders()
        if len(batches) >= self.every:
            self.table().write.mode("overwrite").parquet(f"{self.path}/base={k}")
            for name in [f"batch={b}" for b in batches] + ([f"base={base}"] if base is not None else []):
                old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
                old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    def table(self, before: int | None = None) -> DataFrame:
        """The rows as they are, or as they were before a batch (of those not folded in yet)."""
        base, batches = self._folders()
        parts = ([(base, f"base={base}")] if base is not None else []) + [(k, f"batch={k}") for k in batches if before is None or k < before]
        read = [self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}").withColumn("__batch", F.lit(k)) for k, name in parts]
        if not read:
            return self.spark.createDataFrame([], self.schema)
        rows = reduce(DataFrame.unionByName, read)
        if not self.keys:
            return rows.drop("__batch")
        rest = [c for c in self.schema.names if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "__batch").alias("__row")).select(*self.keys, "__row.*").select(*self.schema.names)
