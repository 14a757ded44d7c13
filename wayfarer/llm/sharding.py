"""Sharding by a Feistel permutation of global row numbers.

Rows get gapless numbers from a hash order that does not depend on files or partitions; the permutation
turns a number into a position, and position % shards is the shard, position // shards the slot. Shard and
slot of any row number can be computed without looking at other rows, and the same rows always get the same
places. Nulls count as values; empty tables give empty results; columns of the input pass through, and the
added columns are shard and slot (an input column of such a name is replaced).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bits_for, materialize, table, text_of

ROUNDS, WALK, SEED = 6, 64, 20240229
#: Rows a numbering task takes at least; more equal rows than HEAVY are dealt over several tasks.
PER_PART, HEAVY = 4096, 100_000


def feistel(number: Column, a: int, b: int, rounds: int = ROUNDS, seed: int = SEED) -> Column:
    """A permutation of 0 .. a*b-1: number = left * b + right; halves are shifted in turn, modulo a and b."""

    def turn(state: Column, i: Column) -> Column:
        left, right = state["l"], state["r"]
        even = F.struct(F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), i, right), F.lit(a)), F.lit(a)).alias("l"), right.alias("r"))
        odd = F.struct(left.alias("l"), F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), i, left), F.lit(b)), F.lit(b)).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    start = F.struct(F.floor(number / F.lit(b)).cast("long").alias("l"), F.pmod(number, F.lit(b)).alias("r"))
    if b > 1:  # exact for numbers beyond 2^53
        start = F.struct(((number - F.pmod(number, F.lit(b))).cast("decimal(38,0)") / F.lit(b)).cast("long").alias("l"), F.pmod(number, F.lit(b)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn, lambda s: s["l"] * F.lit(b) + s["r"])


def place(number: Column, total: int, rounds: int = ROUNDS, seed: int = SEED) -> Column:
    """Position of a row number among total: cycle walking until the permuted number is below total.

    The domain a*b exceeds total by less than a <= sqrt(total) + 1, so that walks are short; one that is not
    over after WALK steps raises an error (total below WALK^2 can't get there: a walk visits each number
    beyond total at most once).
    """
    a = math.isqrt(max(total, 1) - 1) + 1
    b = -(-max(total, 1) // a)
    a, b, n = (int(x) for x in (a, b, total))
    long = lambda c: c.cast("long")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), long(feistel(number, a, b, rounds, seed)), lambda x, _: F.when(x >= F.lit(n), long(feistel(x, a, b, rounds, seed))).otherwise(x))
    return F.when(walked < F.lit(n), walked).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def content(df: DataFrame, key: str, text: str) -> Column:
    """A hash of a row's columns but key and text, and of which are null; nested values count by their JSON."""
    held = [(F.col(f"`{c.replace('`', '``')}`"), "<" in kind or kind == "variant") for c, kind in df.dtypes if c not in (key, text)]
    flags = [F.isnull(text)] if text in df.columns else []
    return F.xxhash64(F.lit(SEED), *flags, *[x for c, nested in held for x in (F.isnull(c), F.to_json(F.struct(c.alias("c"))) if nested else c)])


def assign_shards(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", text_hash: Column | None = None, per_part: int = PER_PART, heavy: int = HEAVY, seed: int = SEED) -> DataFrame:
    """df with shard (int) and slot (long); shard counts differ by one at most, slots run from 0 without gaps.

    text_hash (default: a hash of the column text) stands for the text where df doesn't carry it. Numbers follow the hash of the whole row (key, text, other columns): bucket counts are summed first, then rows are numbered within
    buckets of about per_part rows, so that no task holds more than its bucket. Rows that are alike in every column
    more than heavy times come last, dealt into chunks; such rows are interchangeable.
    """
    spark = df.sparkSession
    bare = df.drop("shard", "slot")
    same = (F.col(key), F.xxhash64(text_of(text)) if text_hash is None else text_hash, content(bare, key, text))
    named = bare.withColumns({"__k": same[0], "__t": same[1], "__u": same[2], "__h": F.xxhash64(*same)})
    narrow = materialize(named.groupBy("__k", "__t", "__u", "__h").agg(F.count("*").alias("n")), "rows")
    total, most = narrow.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    bits = bits_for(total, per_part)
    bucket = F.shiftrightunsigned("__h", 64 - bits) if bits else F.lit(0).cast("long")
    many = materialize(narrow.where(F.col("n") > heavy).select(F.col("__k").alias("__mk"), F.col("__t").alias("__mt"), F.col("__u").alias("__mu"), F.col("n").alias("__mn")), "heavy") if most > heavy else None
    rows = named.withColumns({"__a": F.lit(0), "__b": bucket, "__c": F.lit(0).cast("long")})
    counts = narrow.where(F.col("n") <= heavy).groupBy(F.lit(0).alias("__a"), bucket.alias("__b"), F.lit(0).cast("long").alias("__c")).agg(F.sum("n").alias("n"))
    if many is not None:
        on = F.col("__k").eqNullSafe(F.col("__mk")) & (F.col("__t") == F.col("__mt")) & (F.col("__u") == F.col("__mu"))
        chunk = F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("__mn") / heavy))
        hot = named.join(many, on).select(*[named[c] for c in named.columns], F.lit(1).alias("__a"), F.col("__h").alias("__b"), chunk.cast("long").alias("__c"))
        hot = materialize(hot, "hot")  # counted and numbered from the same files
        rows = rows.join(many, on, "left_anti").unionByName(hot)
        counts = counts.unionByName(hot.groupBy("__a", "__b", "__c").agg(F.count("*").alias("n")))
    # One row for each bucket, 2^20 and the chunks of heavy rows at most.
    starts = counts.withColumn("__from", F.sum("n").over(Window.orderBy("__a", "__b", "__c")) - F.col("n")).drop("n")
    starts = materialize(starts, "starts")
    within = Window.partitionBy("__a", "__b", "__c").orderBy("__h", "__k", "__t", "__u")
    number = F.col("__from") + F.row_number().over(within) - 1
    placed = rows.join(F.broadcast(starts), ["__a", "__b", "__c"]).withColumn("__n", number.cast("long")).withColumn("__p", place(F.col("__n"), total, seed=seed))
    return placed.withColumns({"shard": F.pmod("__p", F.lit(shards)).cast("int"), "slot": F.floor(F.col("__p") / shards).cast("long")}).select(*named.columns, "shard", "slot").drop("__k", "__t", "__u", "__h")


def write_shards(df: DataFrame, path: str, shards: int = 16, **options) -> DataFrame:
    """Write df under path, one folder for each shard, rows in order of their slots; returns it as read back."""
    placed = assign_shards(df, shards, **options)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.parquet(path)


def digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; law "rows", so grown_shard is null."""
    text = text_of()
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    placed = assign_shards(sized, shards, text_hash=F.col("text_hash"))  # texts stay where they are
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


QUERIES = {"op5_sharding": op5_sharding}
ORACLES: dict[str, str] = {}
