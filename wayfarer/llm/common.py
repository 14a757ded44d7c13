"""Helpers shared by the corpus operators: tables in the shared folder, text expressions, components."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees. The session names it; only a local session gets a default."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "/tmp/checkpoints/wayfarer"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/wayfarer/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage like a checkpoint, survives the loss of executors, and gives later plans the
    table's true size, so that Spark broadcasts it only below spark.sql.autoBroadcastJoinThreshold.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if (paths := _written.get()) is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def written() -> Iterator[list[str]]:
    """The paths of the tables that materialize writes inside, in order."""
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield paths
    finally:
        _written.reset(token)


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables that materialize wrote, once nothing reads them any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()  # a folder of this table alone
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Delete the tables this application has left in the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/wayfarer/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def without_blanks(text: Column) -> Column:
    """text less every BLANKS character; byte-wise replacement, no regular expression."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def bits_for(rows: int, per_part: int, most: int = 20) -> int:
    """Bits that deal rows into parts of about per_part each."""
    return min(most, max(0, math.ceil(math.log2(max(1, rows) / per_part)))) if rows > per_part else 0


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Stars (node, root) of the undirected graph of edges (u, v): longs, u != v; root is the least node.

    Alternating large-star and small-star rounds: O(log^2) rounds, and each moves O(edges) rows. Minima are
    taken by partial aggregation, so that a hub's neighbours never meet in one task; the joins back are plain
    equi-joins that AQE can split. Each round is written to the shared folder.
    """
    stars = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        stars = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
