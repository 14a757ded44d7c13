"""Exact dedup by an extendible-hash index kept as files in the shared folder.

Texts are equal when they are identical without BLANKS. A text's 64-bit hash is its place in the index: a directory of hash
prefixes doubles until no bucket holds more than its capacity of different hashes, and maps each prefix to its bucket. Rows,
pre-aggregated where they are read, go to their buckets; buckets are dealt to owner tasks as ranges of hashes. An owner keeps
a chain for each hash: the different texts that share it (told apart by SHA-256), each with its rows and the row that stays. Texts of
chains with more than one row come to the owners once from each task that reads copies, and are compared byte by byte; a difference
fails the job. Every row's answer is looked up by directory, bucket and chain.

Null texts count as empty. Keys may be numbers or strings, a null key is last. Rows of one key and text are one document and all
bear the same mark. Of texts of equal length the least key stays. Empty tables give empty results; other columns, whatever their
names, are not looked at by find_copies and pass through drop_copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_of, without_blanks

#: Different hashes in a bucket, and bits of the directory, which is broadcast: 2^MOST_BITS rows at most. Beyond CAPACITY * 2^MOST_BITS (4 billion)
#: different texts buckets at the directory's depth hold more than CAPACITY; nothing else changes.
CAPACITY, MOST_BITS = 1 << 14, 18
#: Bits of the filter that keeps unrepeated texts where they are: 16 for each repeated hash, 2^FILTER_BITS (32 MB) at most. It only saves work.
FILTER_BITS = 28


def _keys(docs: DataFrame, text: str, key: str, hash_bits: int = 64) -> DataFrame:
    body = text_of(text)
    named = docs.select(F.col(key).alias("doc_id"), F.length(body).cast("long").alias("n"), without_blanks(body).alias("norm"))
    h = F.xxhash64("norm").bitwiseAND(F.lit(-1 << (64 - hash_bits)))
    return named.select("doc_id", "n", "norm", h.alias("h"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))


def directory(entries: DataFrame, capacity: int = CAPACITY, most_bits: int = MOST_BITS) -> DataFrame:
    """(cell, depth, bucket, bits) for each prefix of the directory's global depth (bits), from entries (h).

    The histogram of the finest prefixes is summed at every depth; a bucket is the shortest prefix within
    capacity, as if directories were doubled and overfull buckets split one by one.
    """
    total = entries.count()
    bits = min(most_bits, max(1, math.ceil(math.log2(max(2, total / capacity))) + 3))
    cells = entries.groupBy(F.shiftrightunsigned("h", 64 - bits).alias("cell")).agg(F.count("*").alias("n"))
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(bits))))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    sums = levels.groupBy("depth", "prefix").agg(F.sum("n").alias("held"))
    fit = levels.join(sums, ["depth", "prefix"]).where((F.col("held") <= capacity) | (F.col("depth") == bits))
    found = fit.groupBy("cell").agg(F.min(F.struct("depth", "prefix")).alias("b"))
    named = F.expr(f"b.prefix * shiftleft(1L, {bits} - b.depth)")
    return found.select("cell", F.col("b.depth").alias("depth"), named.alias("bucket"), F.lit(bits).alias("bits"))


def placed(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows (h) with the bucket that the directory cells names: 2^MOST_BITS rows at most, broadcast."""
    bits = (cells.select("bits").first() or [1])[0]
    return rows.withColumn("cell", F.shiftrightunsigned("h", 64 - bits)).join(F.broadcast(cells.select("cell", "bucket")), "cell").drop("cell")


def build_index(keys: DataFrame, cells: DataFrame) -> DataFrame:
    """The index over keys (doc_id, n, h, sha): (bucket, h, chain), chain a list of sha, group_size, keep_n and keep_id of each text."""
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id")).alias("best")
    slots = placed(keys, cells).groupBy("bucket", "h", "sha").agg(F.count("*").alias("group_size"), best)
    owned = slots.repartitionByRange("bucket").groupBy("bucket", "h")  # an owner's buckets are a range of hashes
    text = F.struct("sha", "group_size", (-F.col("best.n")).alias("keep_n"), F.col("best.doc_id").alias("keep_id"))
    chains = owned.agg(F.array_sort(F.collect_list(text), lambda x, y: F.when(x["sha"] < y["sha"], -1).when(x["sha"] > y["sha"], 1).otherwise(0)).alias("chain"))
    return materialize(chains.sortWithinPartitions("bucket", "h"), "index")


def _filter(index: DataFrame) -> tuple[DataFrame, int]:
    """Bit maps (part, map) of the hashes with repeated texts, and the bits of their places."""
    repeated = index.where(F.exists("chain", lambda x: x["group_size"] > 1)).select("h")
    bits = min(FILTER_BITS, max(16, (repeated.count() * 16).bit_length()))
    at = F.shiftrightunsigned("h", 64 - bits)
    parts = repeated.groupBy(F.shiftright(at, 15).alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("map"))
    return materialize(parts, "filter"), bits


def _in_filter(at: Column) -> Column:
    place = at.bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring(F.col("map"), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1


def compare_bytes(docs: DataFrame, index: DataFrame, cells: DataFrame, text: str, key: str, hash_bits: int = 64) -> None:
    """Fail if two rows of one chain share the SHA-256 but not their bytes.

    Only texts whose hash the filter has leave their place: copies meet in partial aggregates, so that a group of any size sends its text
    once from each task. Texts without copies pass the filter by chance, one in 16 as long as it has 16 bits for each repeated hash.
    """
    maps, bits = _filter(index)
    at = F.shiftrightunsigned("h", 64 - bits)
    texts = _keys(docs, text, key, hash_bits).select("h", "sha", "norm")
    texts = texts.withColumn("part", F.shiftright(at, 15)).join(F.broadcast(maps), "part").where(_in_filter(at)).select("h", "sha", "norm")
    copies = placed(texts, cells).groupBy("bucket", "h", "sha", "norm").agg(F.count("*").alias("rows"))
    clash = copies.groupBy("bucket", "h", "sha").agg(F.count("*").alias("texts")).where("texts > 1")
    if clash.limit(1).count():
        raise ValueError("different texts share a SHA-256 digest")


def find_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, hash_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the index bucket of every row of docs; fewer hash_bits make longer chains."""
    keys = materialize(_keys(docs, text, key, hash_bits).select("doc_id", "n", "h", "sha"), "keys")
    cells = materialize(directory(keys.select("h").distinct(), capacity), "directory")
    index = build_index(keys, cells)
    compare_bytes(docs, index, cells, text, key, hash_bits)
    # The lookup: directory, bucket, chain.
    met = placed(keys, cells).join(index, ["bucket", "h"]).withColumn("t", F.filter("chain", lambda x: x["sha"] == F.col("sha"))[0])
    kept = F.col("doc_id").eqNullSafe(F.col("t.keep_id")) & (F.col("n") == F.col("t.keep_n"))
    return met.select("doc_id", "t.keep_id", "t.group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"), "bucket")


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the rows that find_copies drops."""
    marks = find_copies(docs, text, key).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    sha = F.sha2(without_blanks(text_of(text)).cast("binary"), 256)
    return docs.join(marks, docs[key].eqNullSafe(marks["__id"]) & (sha == marks["__sha"]), "left_semi")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(table(spark, sf_dir, "documents")).drop("bucket")


OP3 = r"""
WITH norm AS (
  SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents),
best AS (SELECT *, count(*) OVER (PARTITION BY sha) AS group_size, row_number() OVER (PARTITION BY sha ORDER BY n DESC, doc_id NULLS LAST) AS i FROM norm),
keep AS (SELECT sha, doc_id AS keep_id, n AS keep_n FROM best WHERE i = 1)
SELECT b.doc_id, k.keep_id, b.group_size, (b.doc_id IS NOT DISTINCT FROM k.keep_id AND b.n = k.keep_n) AS kept, b.sha AS text_sha256
FROM best b JOIN keep k ON b.sha = k.sha
"""

QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLES = {"op3_exact_dedup": OP3}
