"""Funnels: who gets through 2 to 8 steps in order, within days of the first.

Three forms give the same rows. Windows, the usual one: one shuffle and one sort by visitor; each step's time is a running minimum over the visitor's matching events, so that
nothing grows with them but the sort, which spills. The fold walks a sorted array of a visitor's events; joins take one join and one minimum a step. The median is exact and found by rank.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.operators import selection
from wayfarer.operators.base import scan_events, with_visitors
from wayfarer.plans.filters import Funnel
from wayfarer.plans.schemas import DEFAULT_WORKSPACE
from wayfarer.plans.scratch import written
from wayfarer.plans.windows import TimeWindow

DAY = 86_400_000_000
#: A funnel's last step is within 90 days of its first: fewer microseconds than 2^45.
MEDIAN_BITS = 45


def _matches(events: DataFrame, visitors: DataFrame, funnel: Funnel, window: TimeWindow, workspace: str) -> DataFrame:
    """canonical_id, us (microseconds) and m1, m2, ... of the events that match any step; the window includes its end."""
    steps = [F.coalesce(c, F.lit(False)).alias(f"m{i}") for i, c in enumerate(funnel.step_columns(), 1)]
    rows = scan_events(events, window, workspace, closed=True).select("visitor_id", "workspace_id", F.unix_micros("inserted_at").alias("us"), *steps)
    rows = rows.where(reduce(or_, [F.col(f"m{i}") for i in range(1, len(steps) + 1)]))
    return with_visitors(rows, visitors)


def _reached(times: DataFrame, n: int) -> DataFrame:
    """One row: c1, c2, ... (visitors at each step) and median, seconds from first to last step, null if nobody got there.

    Visitors are counted by last step and duration first, which runs a job; both results come from these counts.
    """
    steps = sum((F.col(f"t{i}").isNotNull().cast("int") for i in range(1, n + 1)), F.lit(0))
    counts = times.groupBy(steps.alias("steps"), F.when(F.col(f"t{n}").isNotNull(), F.col(f"t{n}") - F.col("t1")).alias("us")).agg(F.count("*").alias("n"))
    counts = written(counts, "steps")  # read by each level of the median: made once
    reached = [F.coalesce(F.sum(F.when(F.col("steps") >= i, F.col("n"))), F.lit(0)).alias(f"c{i}") for i in range(1, n + 1)]
    median = selection.middle(counts, "us", "n", MEDIAN_BITS, rows=counts.count()).select((0.5 * (F.col("lower") / 1e6) + 0.5 * (F.col("upper") / 1e6)).alias("median"))
    both = counts.agg(*reached).unionByName(median, allowMissingColumns=True)
    return both.agg(*[F.max(f"c{i}").alias(f"c{i}") for i in range(1, n + 1)], F.max("median").alias("median"))


def _summary(times: DataFrame, n: int) -> DataFrame:
    """step_index, visitor_count and median_time (of the last step) from t1, t2, ... of each visitor."""
    rows = F.array(*[F.struct(F.lit(i).alias("step_index"), F.col(f"c{i}").alias("visitor_count"), (F.col("median") if i == n else F.lit(None).cast("double")).alias("median_time")) for i in range(1, n + 1)])
    return _reached(times, n).select(F.inline(rows))


def step_times(events: DataFrame, visitors: DataFrame, funnel: Funnel, window: TimeWindow, workspace: str = DEFAULT_WORKSPACE) -> DataFrame:
    """canonical_id and the time (microseconds) at which each step was reached first, null if never. Rows are of visitors with a matching event."""
    rows, n = _matches(events, visitors, funnel, window, workspace), len(funnel.steps)
    upto = Window.partitionBy("canonical_id").orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    us = F.col("us")
    rows = rows.withColumn("t1", F.min(F.when(F.col("m1"), us)).over(upto))
    for i in range(2, n + 1):
        reached = F.col(f"m{i}") & (us > F.col(f"t{i - 1}")) & (us <= F.col("t1") + funnel.window_days * DAY)
        rows = rows.withColumn(f"t{i}", F.min(F.when(reached, us)).over(upto))
    return rows.groupBy("canonical_id").agg(*[F.min(f"t{i}").alias(f"t{i}") for i in range(1, n + 1)])


def step_times_by_fold(events: DataFrame, visitors: DataFrame, funnel: Funnel, window: TimeWindow, workspace: str = DEFAULT_WORKSPACE) -> DataFrame:
    """canonical_id and the time (microseconds) at which each step was reached first, null if never."""
    n = len(funnel.steps)
    rows = _matches(events, visitors, funnel, window, workspace)
    packed = rows.groupBy("canonical_id").agg(F.array_sort(F.collect_list(F.struct("us", *[f"m{i}" for i in range(1, n + 1)]))).alias("path"))
    null = F.lit(None).cast("long")

    def advance(state: Column, e: Column) -> Column:
        found = [F.coalesce(state["t1"], F.when(e["m1"], e["us"]))]
        for i in range(2, n + 1):
            before = state[f"t{i - 1}"]
            reached = e[f"m{i}"] & (e["us"] > before) & (e["us"] <= state["t1"] + funnel.window_days * DAY)
            found.append(F.coalesce(state[f"t{i}"], F.when(reached, e["us"])))
        return F.struct(*[c.alias(f"t{i}") for i, c in enumerate(found, 1)])

    start = F.struct(*[null.alias(f"t{i}") for i in range(1, n + 1)])
    return packed.select("canonical_id", F.aggregate("path", start, advance).alias("t")).select("canonical_id", "t.*")


def step_times_by_joins(events: DataFrame, visitors: DataFrame, funnel: Funnel, window: TimeWindow, workspace: str = DEFAULT_WORKSPACE) -> DataFrame:
    """The same, step by step."""
    rows = _matches(events, visitors, funnel, window, workspace)
    found = rows.where("m1").groupBy("canonical_id").agg(F.min("us").alias("t1"))
    for i in range(2, len(funnel.steps) + 1):
        reached = rows.where(f"m{i}").select("canonical_id", "us").join(found.where(F.col(f"t{i - 1}").isNotNull()), "canonical_id").where((F.col("us") > F.col(f"t{i - 1}")) & (F.col("us") <= F.col("t1") + funnel.window_days * DAY))
        found = found.join(reached.groupBy("canonical_id").agg(F.min("us").alias(f"t{i}")), "canonical_id", "left")
    return found


FORMS = {"windows": step_times, "fold": step_times_by_fold, "joins": step_times_by_joins}


def summary(events: DataFrame, visitors: DataFrame, funnel: Funnel, window: TimeWindow, workspace: str = DEFAULT_WORKSPACE, form: str = "windows") -> DataFrame:
    """step_index, visitor_count, median_time: seconds from first to last step, exact, null but for the last step."""
    return _summary(FORMS[form](events, visitors, funnel, window, workspace), len(funnel.steps))


def analyze(events: DataFrame, visitors: DataFrame, funnel: Funnel, window: TimeWindow, workspace: str = DEFAULT_WORKSPACE, form: str = "windows") -> DataFrame:
    """A row for each step: label, count, conversions, drop_off; overall_conversion is null without visitors."""
    n = len(funnel.steps)
    one = _reached(FORMS[form](events, visitors, funnel, window, workspace), n)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = []
    for i, step in enumerate(funnel.steps, 1):
        count, before = F.col(f"c{i}"), F.col(f"c{max(1, i - 1)}")
        rows.append(F.struct(F.lit(i).alias("step_index"), F.lit(step.label).alias("label"), count.alias("count"), share(count, F.col("c1")).alias("conversion_to_step_1"), share(count, before).alias("conversion_to_prev"), (before - count).alias("drop_off")))
    overall = F.when(F.col("c1") > 0, F.col(f"c{n}") / F.col("c1"))
    return one.select(F.inline(F.array(*rows)), overall.alias("overall_conversion"), F.col("median").alias("median_time_seconds"))
