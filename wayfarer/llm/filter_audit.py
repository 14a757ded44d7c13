"""Interaction audit of five text filters: what each removes in every order, alone, and of good and of toxic documents.

A relational word pipeline. Texts are dealt out once by id and text (repeated rows collapse before), words are exploded, (id, text, word)
and then (id, text) aggregated for totals and distincts, with no further shuffle; the other flags and the labels are outer-joined, and 32
conditional counts for each part say how many of its documents fail exactly which filters. All orders and steps follow from these counts.

A document is a row: repeated rows count each, a null language is the part of the empty string, a null text an empty one. A null id has no smaller one, so
such rows never fail E. A document is good or toxic if any label of its id says so. Two texts are identical if their SHA-256 is. Without
documents there are no parts and no rows. Columns other than id, text and language are not looked at, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_of

FILTERS = "ABCDE"
#: Fewer words; fewer distinct words of a hundred; more capitals of a hundred code points fail. Any of these characters fails.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, "#$%&*|"
BLANK = r"[\x20\x09-\x0D]+"
#: Documents without an id would meet in one task where labels are joined by id alone; they are dealt over this many.
SALTS = 4096


def _rows(docs: DataFrame, text: str, key: str, part: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_of(text).alias("text"))


def word_totals(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, h (hash of the text), words and distinct_words of each different (id, text) that has words."""
    rows = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text")).withColumn("h", F.xxhash64("text"))
    once = rows.groupBy("doc_id", "h").agg(F.first("text").alias("text"))  # the only shuffle: what follows is grouped within it
    words = once.select("doc_id", "h", F.explode(F.split("text", BLANK)).alias("word")).where("word != ''")
    counted = words.groupBy("doc_id", "h", "word").agg(F.count("*").alias("n"))
    return counted.groupBy("doc_id", "h").agg(F.sum("n").alias("words"), F.count("*").alias("distinct_words"))


def _same(left: DataFrame, right: DataFrame, *columns: str) -> Column:
    found = F.lit(True)
    for c in columns:
        found = found & left[c].eqNullSafe(right[f"r_{c}"])
    return found


def _renamed(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"r_{c}" for c in columns})


def failures(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """doc_id, part, n (documents alike in all of this), good, toxic and mask: bit i is set if filter i of FILTERS fails."""
    body = F.col("text")
    capitals = 100 * F.regexp_count(body, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(body)
    flags = _rows(docs, text, key, part).select("doc_id", "part", F.xxhash64("text").alias("h"), F.sha2(body.cast("binary"), 256).alias("sha"), capitals.alias("c"), body.rlike(f"[{SYMBOLS}]").alias("d"))
    flags = materialize(flags.groupBy("doc_id", "part", "h", "sha", "c", "d").agg(F.count("*").alias("n")), "flags")
    # The only id of a text that doesn't fail E is its least, so that no group of copies is joined by its text alone.
    least = _renamed(flags.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("least", F.lit(True)), "doc_id", "sha")
    totals = _renamed(word_totals(docs, text, key), "doc_id", "h")
    marked = flags.join(totals, _same(flags, totals, "doc_id", "h"), "left")
    marked = marked.join(least, (marked["doc_id"] == least["r_doc_id"]) & (marked["sha"] == least["r_sha"]), "left")
    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct_words", F.lit(0))
    fails = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, F.col("c"), F.col("d"), F.col("doc_id").isNotNull() & F.col("least").isNull())
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    salt = F.when(F.col("doc_id").isNull(), F.pmod("h", F.lit(SALTS))).otherwise(-1)
    known = labels.groupBy(F.col("doc_id").alias("r_id")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = known.withColumn("r_salt", F.lit(-1).cast("long"))
    rows = marked.select("doc_id", "part", "n", mask.alias("mask"), salt.cast("long").alias("salt"))
    rows = rows.join(known, (rows["doc_id"] == known["r_id"]) & (rows["salt"] == known["r_salt"]), "left")
    return rows.select("doc_id", "part", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "mask")


def audit(failed: DataFrame) -> DataFrame:
    """A row for each part, filter_order and step of failed (part, n, good, toxic, mask), from 32 counts a part."""
    masks = range(1 << len(FILTERS))
    counts = []
    for name, held in (("all", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic"))):
        counts += [F.sum(F.when((F.col("mask") == m) & held, F.col("n")).otherwise(0)).alias(f"{name}_{m}") for m in masks]
    cells = failed.groupBy("part").agg(*counts).select("part", *[F.array(*[f"{name}_{m}" for m in masks]).alias(f"c_{name}") for name in ("all", "good", "toxic")])
    steps = []
    for order in permutations(range(len(FILTERS))):
        for i, f in enumerate(order):
            seen = sum(1 << g for g in order[:i])
            steps.append(F.struct(F.lit("".join(FILTERS[g] for g in order)).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(seen).alias("seen"), F.lit(1 << f).alias("bit")))
    rows = cells.select("*", F.inline(F.array(*steps)))
    bit, seen = F.col("bit"), F.col("seen")

    def total(counts: str, of) -> Column:
        """The sum of the counts, each times of(mask)."""
        weighed = F.transform(F.col(counts), lambda n, m: n * of(m))
        return F.aggregate(weighed, F.lit(0).cast("long"), lambda a, b: a + b)

    one = lambda condition: F.when(condition, 1).otherwise(0)
    fails, before = lambda m: m.bitwiseAND(bit) != 0, lambda m: m.bitwiseAND(seen) != 0
    here = lambda m: one(fails(m) & ~before(m))
    # Of a document's k failing filters each comes first in one of k orders.
    orders = factorial(len(FILTERS))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("c_all", lambda m: one(m.bitwiseAND(bit.bitwiseOR(seen)) == 0)).alias("kept"),
        total("c_all", here).alias("removed"),
        total("c_all", lambda m: one(fails(m) & before(m))).alias("redundant"),
        total("c_all", lambda m: one(m == bit)).alias("unique_fails"),
        total("c_good", here).alias("good_lost"),
        total("c_toxic", here).alias("toxic_lost"),
        total("c_all", lambda m: F.when(fails(m), F.floor(orders / F.bit_count(m))).otherwise(0)).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT part,
    (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM d),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
s AS (SELECT filter_order, bits[step] AS bit, step::INT AS step, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS seen FROM o, (SELECT unnest(range(1, 6)) AS step)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY 1, 2),
r AS (SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (WHERE mask & (bit | seen) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & seen = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & seen <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & bit <> 0 AND mask & seen = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & seen = 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4)
SELECT * EXCLUDE (bit), sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r
"""

QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLES = {"op13_filter_audit": OP13}
