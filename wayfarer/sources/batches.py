"""Appends of numbered batches that may come again.

A batch goes to a folder of its own, and a commit to another table once it is whole. Readers see committed batches only. A batch that comes again after its commit is left as it is; one
that was cut off is written anew over what there is of it. One query appends to a table at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Batches:
    """A table under path; schema is its DDL, query names who appends."""

    path: str
    name: str
    schema: str
    query: str = "main"

    def _folder(self, table: str, number: int | None = None) -> str:
        top = f"{self.path}/{table}"
        return top if number is None else f"{top}/query={self.query}/batch={number}"

    def _exists(self, spark: SparkSession, folder: str, marker: str = "") -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{marker}" if marker else folder)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def has(self, spark: SparkSession, number: int) -> bool:
        """Whether a batch is committed."""
        return self._exists(spark, self._folder(f"{self.name}_commits", number), "_SUCCESS")

    def last(self, spark: SparkSession, before: int | None = None) -> int | None:
        """The highest number of the query's committed batches (below one that is given)."""
        if not self._exists(spark, self._folder(f"{self.name}_commits")):
            return None
        done = self._commits(spark).where(F.col("query") == self.query)
        return (done if before is None else done.where(F.col("batch") < before)).agg(F.max("batch")).first()[0]

    def _commits(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("committed int, query string, batch bigint").parquet(self._folder(f"{self.name}_commits")).select("query", "batch")

    def append(self, rows: DataFrame, number: int, unique: tuple[str, ...] = (), near: str | None = None) -> bool:
        """Append batch number, unless it is there; whether it was appended.

        Rows whose unique columns an earlier row of the table has stay out, as do all but one of a batch that share them. near names a time column that is a function of the unique
        columns: only rows of the batch's span of time are looked at then.
        """
        spark = rows.sparkSession
        if self.has(spark, number):
            return False
        if unique:
            tie = Window.partitionBy(*unique).orderBy(*[c for c in rows.columns if c not in unique and not dict(rows.dtypes)[c].startswith("map")])
            rows = rows.withColumn("__n", F.row_number().over(tie)).where("__n = 1").drop("__n")
            held = self.read(spark)
            if near:
                low, high = rows.agg(F.min(near), F.max(near)).first()
                held = held.where(F.col(near).between(F.lit(low), F.lit(high)))
            rows = rows.join(held.select(*unique), list(unique), "left_anti").select(*rows.columns)
        rows.write.mode("overwrite").parquet(self._folder(self.name, number))
        spark.range(1).coalesce(1).select(F.lit(number).alias("committed")).write.mode("overwrite").parquet(self._folder(f"{self.name}_commits", number))
        return True

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows of committed batches, with query and batch."""
        ddl = f"{self.schema}, query string, batch bigint"
        if not self._exists(spark, self._folder(f"{self.name}_commits")):
            return spark.createDataFrame([], ddl)
        return spark.read.schema(ddl).parquet(self._folder(self.name)).join(self._commits(spark), ["query", "batch"], "left_semi")
