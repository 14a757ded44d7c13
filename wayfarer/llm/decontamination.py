"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Words are runs of letters and digits in lower case; an item's shingles are its different runs of five words
(of all its words if it has fewer). A document holds an item if THRESHOLD of the item's shingles occur in it.
Items are partitioned by size; in each partition an item is found by its k least shingles in MinHash order. With
k above the shingles that a matching document may lack, one of them must occur in it: the search loses nothing however
long the document is. Bit maps of the sketches and of all item shingles, of bounded size, are all that every
task gets; what passes them is joined to the items by the shingles' text and counted exactly.
Null texts and texts without words hold nothing; items without words are never found; equal items (same shingles)
are reported once, under their least id. Rows of one id and text are one document. Keys of documents and items are of any type that has a text and an order. Without
documents or items nothing is found; drop_contaminated passes all columns through, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table, text_of

WORDS, THRESHOLD = 5, 0.8
WORD = re.compile(r"[^\W_]+")
#: Bits of a map for each of the items' shingles, and the least and most bits (a power of two: 32 MB at most).
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 16, 28
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def split(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def hashes(words: list[str], width: int) -> np.ndarray:
    """A 64-bit hash for each run of width words."""
    return run_hashes(np.array([xxhash.xxh64_intdigest(x) for x in words], dtype=np.uint64), width)


def run_hashes(each: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash for each run of width words from the words' hashes."""
    n = len(each) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    found = np.zeros(n, np.uint64)
    for i in range(width):
        found = found * FACTOR + each[i : i + n]
    found ^= found >> np.uint64(29)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return found ^ (found >> np.uint64(32))


def sketch_size(shingles: int, threshold: float) -> int:
    """k of the size partition (sizes from 2^p to 2^(p+1)-1): above what a match of its largest items may lack."""
    largest = (1 << shingles.bit_length()) - 1
    return min(shingles, int((1 - threshold) * largest + 1e-9) + 1)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(*x) for x in fields])


ITEM = _schema(("item_id", T.StringType()), ("width", T.IntegerType()), ("size", T.IntegerType()), ("same", T.LongType()), ("shingle", T.StringType()), ("h", T.LongType()), ("sketch", T.BooleanType()))
FOUND = _schema(("doc_id", T.StringType()), ("text_hash", T.LongType()), ("shingle", T.StringType()))


def item_shingles(items: DataFrame, words: int, threshold: float) -> DataFrame:
    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for item, text in zip(frame["item_id"], frame["text"], strict=True):
                parts = split(text)
                width = min(words, len(parts))
                if not width:
                    continue
                found = dict(zip(hashes(parts, width).tolist(), (" ".join(parts[i : i + width]) for i in range(len(parts) - width + 1)), strict=True))
                order = sorted(found)
                least = set(order[: sketch_size(len(order), threshold)])
                same = xxhash.xxh64_intdigest(np.array(order, np.uint64).tobytes())
                rows += [(item, width, len(order), np.uint64(same).astype(np.int64), found[h], np.uint64(h).astype(np.int64), h in least) for h in order]
            yield pd.DataFrame(rows, columns=ITEM.names, dtype=object)  # plain objects: no text column in several chunks

    return items.mapInPandas(each, ITEM)


def bit_map(shingles: DataFrame, bits: int) -> np.ndarray:
    """Bit h >> (64 - bits) set for each h; built by grouped aggregation, 2^bits bits in all."""
    at = F.shiftrightunsigned("h", 64 - bits)
    parts = shingles.groupBy(F.shiftright(at, 15).alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros(max(1, (1 << bits) >> 15) * 4096, np.uint8)
    for part, held in parts.collect():
        out[part * 4096 : part * 4096 + len(held)] = np.frombuffer(bytes(held), np.uint8)
    return out


def find_items(docs: DataFrame, items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, text_hash, item_id, item_shingles, shared and containment of each item that a document holds."""
    spark = docs.sparkSession
    # Keys pass through Python as text and get their type back.
    shingles = item_shingles(items.select(F.col(item_key).cast("string").alias("item_id"), F.col(item_text).alias("text")), words, threshold)
    shingles = materialize(shingles.withColumn("item_id", F.col("item_id").cast(items.schema[item_key].dataType)), "shingles")
    first = shingles.groupBy("same").agg(F.min("item_id").alias("item_id"))
    shingles = materialize(shingles.drop("item_id").distinct().join(first, "same"), "items")
    count, widths = shingles.agg(F.count("*"), F.collect_set("width")).first()
    bits = min(MOST_BITS, max(LEAST_BITS, (count * BITS_EACH).bit_length()))
    maps = spark.sparkContext.broadcast((bit_map(shingles, bits), bit_map(shingles.where("sketch"), bits)))
    widths = sorted(widths or [])

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole, sketches = maps.value
        shift = np.uint64(64 - bits)
        for frame in frames:
            ids, texts, found = [], [], []
            for doc, text_hash, body in zip(frame["doc_id"], frame["text_hash"], frame["text"], strict=True):
                parts = split(body)
                for width in widths:
                    at = (hashes(parts, width) >> shift).astype(np.int64)
                    mask = np.uint8(1) << (at & 7).astype(np.uint8)
                    if not (sketches[at >> 3] & mask).any():
                        continue
                    here = {" ".join(parts[i : i + width]) for i in np.flatnonzero(whole[at >> 3] & mask).tolist()}
                    found += here
                    ids += [doc] * len(here)
                    texts += [text_hash] * len(here)
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype=object), "text_hash": pd.array(texts, "Int64"), "shingle": pd.Series(found, dtype=object)})

    body = text_of(text)
    hits = docs.select(F.col(key).cast("string").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text")).mapInPandas(search, FOUND)
    hits = hits.withColumn("doc_id", F.col("doc_id").cast(docs.schema[key].dataType))
    pairs = hits.join(shingles.select("item_id", "size", "same", "shingle", "h", "sketch"), "shingle")
    counted = pairs.groupBy("doc_id", "text_hash", "same").agg(F.first("item_id").alias("item_id"), F.first("size").alias("item_shingles"), F.count_distinct("h").alias("shared"), F.max("sketch").alias("candidate"))
    held = counted.where(F.col("candidate") & (F.col("shared") >= threshold * F.col("item_shingles") - 1e-9))
    return held.select("doc_id", "text_hash", "item_id", "item_shingles", "shared", (F.col("shared") / F.col("item_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """docs without those that hold an item."""
    found = find_items(docs, items, text=text, key=key, **options)
    found = materialize(found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "contaminated")
    return docs.join(found, docs[key].eqNullSafe(found["__id"]) & (F.xxhash64(text_of(text)) == found["__hash"]), "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


OP7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
s AS (SELECT DISTINCT item_id, array_to_string(w[j : j + least(5, len(w)) - 1], ' ') AS shingle, least(5, len(w)) AS width FROM (SELECT *, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS j FROM i WHERE len(w) > 0)),
sets AS (SELECT item_id, count(*) AS n, min(width) AS width, md5(string_agg(shingle, '|' ORDER BY shingle)) AS same FROM s GROUP BY 1),
firsts AS (SELECT min(item_id) AS item_id, any_value(n) AS n, same FROM sets GROUP BY same),
t AS (SELECT DISTINCT doc_id, array_to_string(w[j : j + k - 1], ' ') AS shingle FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT width AS k FROM sets) WHERE len(w) >= k)),
hits AS (SELECT t.doc_id, f.item_id, any_value(f.n) AS n, count(*) AS shared FROM t JOIN s USING (shingle) JOIN firsts f ON f.item_id = s.item_id GROUP BY 1, 2)
SELECT doc_id, item_id, n::INTEGER AS item_shingles, shared, shared / n AS containment FROM hits WHERE shared >= 0.8 * n - 1e-9
"""

QUERIES = {"op7_decontamination": op7_decontamination}
ORACLES = {"op7_decontamination": OP7}
