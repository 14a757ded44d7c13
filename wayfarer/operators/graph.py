"""Connected components by way of hubs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.plans.scratch import written


def components(links: DataFrame, cut: Callable[[DataFrame, str], DataFrame] = written, most_rounds: int = 60) -> DataFrame:
    """(member, root) of links (member, hub): members that share hubs, directly or through others, have the least of them as root.

    Each round a member takes the least root met at its hubs, then its root's root, so that chains shorten twofold. Hubs and roots are
    minima of partial aggregates: a hub of any size moves one row from each task. cut(df, name) writes a round's roots.
    """
    links = cut(links.where(F.col("member").isNotNull() & F.col("hub").isNotNull()).distinct(), "links")
    roots = cut(links.select("member", F.col("member").alias("root")).distinct(), "roots")
    for _ in range(most_rounds):
        at_hub = links.join(roots, "member").groupBy("hub").agg(F.min("root").alias("root"))
        best = links.join(at_hub, "hub").groupBy("member").agg(F.min("root").alias("best"))
        moved = roots.join(best, "member").select("member", F.col("root").alias("was"), F.least("root", "best").alias("root"))
        above = moved.select(F.col("member").alias("root"), F.col("root").alias("above"))
        moved = cut(moved.join(above, "root").select("member", "was", "above"), "roots")
        roots = moved.select("member", F.col("above").alias("root"))
        if not moved.where(F.col("was") != F.col("above")).limit(1).count():
            return roots
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
