"""Exact ranks without sorting: which value is in the middle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def middle(counts: DataFrame, value: str, n: str, bits: int = 60, step: int = 15, rows: int | None = None) -> DataFrame:
    """One row, lower and upper: the two values in the middle (one and the same if their number is odd) of counts (value, a long from 0 to 2^bits - 1, and how often, n).

    Values are narrowed down by their leading bits, step of them a level: a level counts the cells of the range that the rank lies in, 2^step at most for each of the two
    ranks, by partial aggregation. No task sees more than the cells. Where counts are known to have no more rows than a level has cells, they are the last level. Both are null without values.
    """
    # As values depend on their count here, no condition of a level goes down into what counts are made of: all levels read the same shuffle.
    x = counts.select(F.when(F.col(n) > 0, F.col(value).cast("long")).alias("x"), F.col(n).cast("long").alias("n")).where("x IS NOT NULL")
    upto = lambda *by: F.sum("n").over(Window.partitionBy(*by).orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    if rows is not None and rows <= 1 << step:
        ranked = x.groupBy("x").agg(F.sum("n").alias("n")).withColumns({"upto": upto(), "total": F.sum("n").over(Window.partitionBy())})
        of = lambda rank: F.min(F.when(F.col("upto") > F.expr(rank), F.col("x")))
        return ranked.agg(of("(total - 1) div 2").alias("lower"), of("total div 2").alias("upper"))
    total = x.agg(F.sum("n").alias("total")).where("total > 0")
    ranks = F.array(F.struct(F.lit(0).alias("which"), F.expr("(total - 1) div 2").alias("rank")), F.struct(F.lit(1).alias("which"), F.expr("total div 2").alias("rank")))
    state = total.select(F.inline(ranks)).withColumn("prefix", F.lit(0).cast("long"))
    shift = bits
    while shift:
        before, shift = shift, max(0, shift - step)
        held = x.join(F.broadcast(state), F.shiftright("x", before) == F.col("prefix"))  # two rows
        cells = held.groupBy("which", "rank", F.shiftright("x", shift).alias("cell")).agg(F.sum("n").alias("n"))
        state = cells.withColumnRenamed("cell", "x").withColumn("upto", upto("which")).where("upto > rank AND upto - n <= rank").select("which", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), F.col("x").alias("prefix"))
    return state.agg(F.min("prefix").alias("lower"), F.max("prefix").alias("upper"))
