"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is -ln(u) / quality, u a hash of its id and text: the order of the keys is a weighted random
order. Each source has a budget of words. As many complete epochs as fit are taken first; the rest of the
budget, where there is any, takes the documents whose words, summed in key order, come nearest to it: of a source whose complete epochs are its target, and of one without
words, it takes nothing. Null texts and texts without
words have size 0; a null source is a source of its own, last in order. Equal rows (same id and text) are
taken together. Empty tables give empty results. Reruns agree: nothing depends on files or partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, text_of

#: A document is taken MOST_EPOCHS times at most.
MOST_EPOCHS, SEED = 3, "mix-1"
#: Keys are cells of CELL_BITS more bits in each level; a cell of fewer rows than PER_CELL is sorted whole.
KEY_BITS, CELL_BITS, PER_CELL = 52, 13, 2_000


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def quality(text: Column) -> Column:
    """Share of letters among the characters, from 0.25 to 1."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.when(F.length(text) == 0, 0.25).otherwise(0.25 + 0.75 * letters / F.length(text))


def _keyed(docs: DataFrame, text: str, source: str, key: str, seed: str) -> DataFrame:
    body = text_of(text)
    tie = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(body), F.lit(f":{seed}")))
    named = docs.withColumns({"__source": F.col(source), "__size": words(body), "__tie": tie, "__weight": quality(body)})
    u = (F.conv(F.substring("__tie", 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    named = named.withColumn("__key", -F.log(u) / F.col("__weight"))
    return named.withColumn("__cell", F.floor(F.col("__key") / (1 + F.col("__key")) * float(1 << KEY_BITS)).cast("long"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, rows, source_size) with weight and target, for sources weighing 1, 2, 3, 1, ... in order.

    Shares of all words by weight, at most MOST_EPOCHS times the source, the excess reshared by weight: sorted
    by their limit over weight, sources are at their limit up to the first that isn't, and the rest share what
    is left. One row for each source: the windows below sort that table only.
    """
    ranked = sizes.withColumn("w", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    ranked = ranked.withColumn("most", F.col("source_size") * MOST_EPOCHS).withColumn("i", F.row_number().over(Window.orderBy(F.col("most") * F.expr("6 div w"), F.col("source").asc_nulls_last())))
    whole, before = Window.partitionBy(), Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0)))
    ranked = ranked.withColumn("ws", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    ranked = ranked.withColumn("free", F.col("most") * F.col("ws") >= F.col("w") * F.col("left"))
    first = F.min(F.when(F.col("free"), F.struct("i", "left", "ws"))).over(whole)
    ranked = ranked.withColumn("first", first)
    target = F.when(F.col("i") < F.col("first.i"), F.col("most").cast("double")).otherwise((F.col("w") * F.col("first.left")).cast("double") / F.col("first.ws"))
    return ranked.select("source", "rows", "source_size", F.col("w").alias("weight"), target.alias("target"))


def _thresholds(keyed: DataFrame) -> DataFrame:
    """A row for each source: target, epochs, and up to which key the rest takes documents.

    The rest of the budget falls into one cell of the key order. Level by level the cells' sums (partial
    aggregates) narrow it down until few rows share it; only those are sorted. No task sorts a source.
    """
    sizes = keyed.groupBy(F.col("__source").alias("source")).agg(F.count("*").alias("rows"), F.sum("__size").alias("source_size"))
    plan = targets(sizes)
    epochs = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = plan.withColumns({"cell": F.lit(0).cast("long"), "base": F.lit(0).cast("long"), "here": F.when(F.col("rest") > 0, F.col("rows")).otherwise(0)})
    plan = materialize(plan, "plan")
    shift = KEY_BITS
    while shift > 0 and (plan.agg(F.max("here")).first()[0] or 0) > PER_CELL:
        finer = shift - CELL_BITS
        inside = keyed.join(plan, keyed["__source"].eqNullSafe(plan["source"]) & (F.shiftright("__cell", shift) == plan["cell"]))
        cells = inside.groupBy("source", "base", "rest", F.shiftright("__cell", finer).alias("fine")).agg(F.sum("__size").alias("s"), F.count("*").alias("n"))
        until = F.col("base") + F.sum("s").over(Window.partitionBy("source").orderBy("fine"))
        cells = cells.withColumn("until", until).where((F.col("until") > F.col("rest")) & (F.col("until") - F.col("s") <= F.col("rest")))
        found = cells.groupBy(F.col("source").alias("s_source")).agg(F.min("fine").alias("fine"), F.min(F.col("until") - F.col("s")).alias("from"), F.min_by("n", "fine").alias("n"))
        plan = plan.join(found, plan["source"].eqNullSafe(found["s_source"]), "left")
        # A source without words has no such cell.
        plan = materialize(plan.select("source", "rows", "source_size", "weight", "target", "epochs", "rest", F.coalesce("fine", F.lit(0)).alias("cell"), F.coalesce("from", "base").alias("base"), F.coalesce("n", F.lit(0)).alias("here")), "plan")
        shift = finer
    inside = keyed.join(plan, keyed["__source"].eqNullSafe(plan["source"]) & (F.shiftright("__cell", shift) == plan["cell"]))
    ties = inside.groupBy("source", "base", "rest", "__key", "__tie").agg(F.sum("__size").alias("s"))
    until = F.col("base") + F.sum("s").over(Window.partitionBy("source").orderBy("__key", "__tie"))
    last = ties.withColumn("until", until).where(F.col("until") - F.col("s") / 2 <= F.col("rest"))
    last = last.groupBy(F.col("source").alias("s_source")).agg(F.max(F.struct("__key", "__tie")).alias("last"))
    plan = plan.join(last, plan["source"].eqNullSafe(last["s_source"]), "left")
    named = {"__p_source": "source", "__source_size": "source_size", "__target": "target", "__epochs": "epochs", "__rest": "rest", "__last_key": "last.__key", "__last_tie": "last.__tie"}
    named = [F.col(c).alias(k) for k, c in named.items()]  # names that an input's other columns don't have
    return materialize(plan.select(*named, (F.col("cell") * F.lit(1 << shift)).cast("long").alias("__cell_from")), "plan")


def _times(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    upto = (F.col("__cell") < F.col("__cell_from")) | (F.col("__key") < F.col("__last_key")) | ((F.col("__key") == F.col("__last_key")) & (F.col("__tie") <= F.col("__last_tie")))
    once_more = F.when((F.col("__rest") > 0) & F.coalesce(upto, F.lit(False)), 1).otherwise(0)
    return keyed.join(plan, keyed["__source"].eqNullSafe(plan["__p_source"])).withColumn("__times", F.col("__epochs") + once_more)


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: str = SEED) -> DataFrame:
    """The mix itself: docs with each row repeated as often as it is taken, columns as they were."""
    narrow = materialize(_keyed(docs, text, source, key, seed).select("__source", "__size", "__key", "__tie", "__cell"), "keys")
    taken = _times(_keyed(docs, text, source, key, seed), _thresholds(narrow))
    return taken.withColumn("__one", F.explode(F.expr("array_repeat(0, int(__times))"))).select(*docs.columns)


def digest(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row."""
    keyed = _keyed(docs.select("doc_id", "source", "text"), "text", "source", "doc_id", seed)
    keyed = materialize(keyed.select("doc_id", "__source", "__size", "__key", "__tie", "__cell"), "keys")
    found = _times(keyed, _thresholds(keyed))
    return found.select("doc_id", F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__times")).alias("taken"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


OP1 = r"""
WITH keyed AS (
  SELECT doc_id, source, coalesce(text, '') AS body,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':mix-1') AS tie
  FROM documents),
drawn AS (
  SELECT doc_id, source, size, tie,
    -ln((('0x' || substr(tie, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
      / CASE WHEN length(body) = 0 THEN 0.25::DOUBLE ELSE 0.25::DOUBLE + 0.75::DOUBLE * length(regexp_replace(body, '[^\p{L}]+', '', 'g')) / length(body) END AS k
  FROM keyed),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM drawn GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS most FROM sizes),
sorted AS (SELECT *, row_number() OVER (ORDER BY most * (6 // w), source NULLS LAST) AS i FROM weighed),
sums AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws FROM sorted),
free AS (SELECT i, rest, ws FROM sums WHERE most * ws >= w * rest ORDER BY i LIMIT 1),
goals AS (
  SELECT s.source, s.source_size, CASE WHEN s.i < f.i THEN s.most::DOUBLE ELSE (s.w * f.rest)::DOUBLE / f.ws::DOUBLE END AS target FROM sums s, free f),
budgets AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS epochs FROM goals),
running AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, tie) - sum(size) OVER (PARTITION BY source, k, tie) / 2.0 AS middle FROM drawn)
SELECT r.doc_id, r.source, r.size, b.source_size, b.target,
  (r.size * (b.epochs + CASE WHEN b.target > b.epochs * b.source_size AND r.middle <= b.target - b.epochs * b.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source
"""

QUERIES = {"op1_mixing": op1_mixing}
ORACLES = {"op1_mixing": OP1}
