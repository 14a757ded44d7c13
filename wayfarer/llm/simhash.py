"""SimHash near-dedup with multi-index hashing.

A fingerprint has 64 bits; two link at LINK_BITS = 3 or fewer differing bits. Cut in two halves, one half of a
linked pair differs in one bit at most. So each half is a table, and every fingerprint looks up the Hamming
ball of radius 1 around its halves; complete distances decide. Of two halves that differ in one bit only one has the
bit set, so that the balls list only values with a bit cleared, and every pair is found once.
Links are made between different fingerprints; equal ones collapse before. Texts without words have fingerprint zero. Null texts
count as empty; a null id never names a component unless the whole component has none. Repeated rows are listed each; drop_near
keeps one row of a component, of rows alike in id and text any one. Empty tables give empty results; other columns pass through drop_near.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected, materialize, table, text_of

WORDS, SEED, LINK_BITS = 3, 42, 3
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Shingles hashed at a time: bounds memory for very long texts.
BLOCK = 1 << 18


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of text's word shingles: bit i is set if it is set in over half their XXH64 hashes."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not parts:
        return 0
    if len(parts) < words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    """Fingerprints as signed longs of the same bits."""
    return pd.Series(np.array([fingerprint(x) for x in texts], dtype="<u8").view("<i8"))


def links(prints: DataFrame, most: int = LINK_BITS) -> DataFrame:
    """Pairs (u, v) of different fingerprints fp that differ in most (1 to 3) bits or fewer."""
    if not 1 <= most <= 3:
        raise ValueError("two halves with balls of radius 1 find up to 3 differing bits")
    low = (1 << 32) - 1
    halves = prints.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("fp").bitwiseAND(F.lit(low)).alias("value")), F.struct(F.lit(1).alias("part"), F.shiftrightunsigned("fp", 32).alias("value")))).alias("half"))
    halves = halves.select("fp", "half.part", "half.value")
    ball = F.array(F.col("value"), *[F.when(F.col("value").bitwiseAND(F.lit(1 << i)) != 0, F.col("value") - F.lit(1 << i)) for i in range(32)])
    probes = halves.select(F.col("fp").alias("u"), "part", F.explode(F.array_compact(ball)).alias("value"), F.col("value").alias("own"))
    probes = probes.select("u", "part", "value", (F.col("own") == F.col("value")).alias("same"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= most
    # Spark takes a side for as large as the table it is made from, though the balls have 17 rows for each half: neither may be broadcast.
    found = probes.join(halves.withColumnRenamed("fp", "v").hint("merge"), ["part", "value"]).where(near & F.when(F.col("same"), F.col("u") < F.col("v")).otherwise(F.lit(True)))
    return found.select("u", "v")


def components(prints: DataFrame, most: int = LINK_BITS) -> DataFrame:
    """(fp, component_id): prints has (fp, least) with the least id of each different fingerprint."""
    stars = connected(links(prints.select("fp"), most))
    named = prints.join(stars, prints["fp"] == stars["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("fp", "component_id", "root")


def find_near(docs: DataFrame, text: str = "text", key: str = "doc_id", most: int = LINK_BITS) -> DataFrame:
    """doc_id, fp, text hash, root fingerprint and component_id of every row."""
    body = text_of(text)
    rows = materialize(docs.select(F.col(key).alias("doc_id"), F.xxhash64(body).alias("text_hash"), fingerprints(body).alias("fp")), "prints")
    different = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "different")
    return rows.join(components(different, most), "fp")


def drop_near(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each component: of the least id (null last), then the least text hash."""
    found = find_near(docs, text, key)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    stay = found.groupBy("root").agg(first.alias("s")).select(F.col("s.doc_id").alias("__id"), F.col("s.text_hash").alias("__hash"))
    stay = materialize(stay, "stay")
    kept = docs.withColumn("__text", F.xxhash64(text_of(text)))
    kept = kept.join(stay, kept[key].eqNullSafe(stay["__id"]) & (kept["__text"] == stay["__hash"]), "left_semi")
    if found.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():  # else texts needn't move again
        kept = kept.dropDuplicates([key, "__text"])
    return kept.select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_near(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLES: dict[str, str] = {}
