"""Phrase collocations by position bitmaps.

Texts are cut into shards of positions inside the tasks that read them. A shard keeps for each word a compressed bitmap of its positions:
the 8-bit blocks that have a bit, in two orders, by word and by block. A phrase's bitmap (of its last words' positions) is shifted by one
and ANDed with the bitmaps of all words that have a bit in its blocks; what is left are the bitmaps of the longer phrases, their
popcounts how often each occurs. Ends of pieces take a position that no word has, so that no phrase crosses them. The search goes depth-first over
runs of first words of bounded size. Popcounts are summed over shards by Spark.

Three passes. The first counts words, the second pairs of frequent words by a 64-bit hash, so that the many rare pairs move as two numbers, the third
phrases of two and of three words whose pairs are frequent. What is frequent goes to tasks as a bit map of hashes, 32 MB at most, that
lets some others through but loses none; those fall out of the sums of the third pass. A shard holds POSITIONS at most: a
longer piece goes on in the next shard with its last words as context that isn't counted again.

Null texts are empty, null languages are "und"; repeated rows count each, keys aren't looked at, nor are columns other than text and language. Words may be of any
length. Without documents, or without frequent phrases, there are no rows. Counts are longs and scores are computed in decimals of 38 digits, exact as long as
a is below 10^15.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, text_of
from .decontamination import bit_map

LEAST, TOP, MOST_WORDS, ABSORBED = 10, 2000, 3, 50
UNKNOWN = "und"
COUNTS = "lang string, phrase string, n long"
#: Positions of a shard (2^22 at most), entries of first words that are extended at once, bits of a block and bits of a place in it.
POSITIONS, ENTRIES, BLOCK, BLOCK_BITS = 3 << 19, 1 << 15, 8, 3
#: Bytes of text that are cut into words at once.
AT_ONCE = 1 << 19
#: Bits of a map for each frequent word or phrase, and the least and most bits (a power of two: 32 MB at most).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 16, 28
#: Cells that scores are counted in, for each doubling, and parts that a language's best candidates are dealt to for their first ranking.
SCORE_CELLS, RANK_PARTS = 64, 64
#: A-Z to lower case, ends of pieces to line breaks, tabs to blanks. These are single bytes, and no byte of another character in UTF-8.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")

# XXH64 of a long.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hash_long(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    h = (seed + P5 + np.uint64(8)) ^ (_rotated(x * P2, 31) * P1)
    h = _rotated(h, 27) * P1 + P4
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def hash_of(lang: Column, word: Column) -> Column:
    """A word's hash in Spark; _word_hashes has the same in tasks."""
    return F.xxhash64(lang, word)


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return hash_long(second, hash_long(first, np.uint64(42)))


class Filter:
    """A bit map of hashes."""

    def __init__(self, bits: int, held: np.ndarray):
        self.shift, self.held = np.uint64(64 - bits), held

    def has(self, h: np.ndarray) -> np.ndarray:
        at = (h >> self.shift).astype(np.int64)
        return (self.held[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) != 0


def _repeated(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): for each i the j from start[i] on, count[i] of them."""
    i = np.repeat(np.arange(len(start), dtype=np.int32), count)
    return i, np.arange(len(i), dtype=np.int32) + (start - np.cumsum(count) + count).astype(np.int32)[i]


class Bitmaps:
    """The compressed position bitmaps of a shard's words: word[k], block[k], bits[k], in order of word, then block."""

    def __init__(self, ids: np.ndarray):
        """ids[p] is the word at position p, or -1 where there is none."""
        key = np.flatnonzero(ids >= 0)
        key |= ids[key].astype(np.int64) << 22
        key.sort()
        bits = np.left_shift(1, (key & (BLOCK - 1)).astype(np.int32))
        key >>= BLOCK_BITS  # word and block
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
        self.bits = np.bitwise_or.reduceat(bits, first) if len(first) else bits
        key, of_block = key[first], 22 - BLOCK_BITS
        self.word, self.block = (key >> of_block).astype(np.int32), (key & ((1 << of_block) - 1)).astype(np.int32)
        key = self.block.astype(np.int64) << 40
        key |= self.word.astype(np.int64) << BLOCK
        key |= self.bits
        key.sort()
        self.by_block = (key >> BLOCK & ((1 << 24) - 1)).astype(np.int32), (key & ((1 << BLOCK) - 1)).astype(np.int32)
        key >>= 40
        self.starts = np.searchsorted(key, np.arange(len(ids) // BLOCK + 3)).astype(np.int32)

    def extend(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, word, block, bits): the bitmaps of phrases, shifted, ANDed with those of all words in their blocks."""
        here, over = (bits << 1) & ((1 << BLOCK) - 1), bits >> (BLOCK - 1)
        h, o = np.flatnonzero(here), np.flatnonzero(over)
        phrase, block, bits = np.r_[phrase[h], phrase[o]], np.r_[block[h], block[o] + 1], np.r_[here[h], over[o]]
        word, held = self.by_block
        i, j = _repeated(self.starts[block], self.starts[block + 1] - self.starts[block])
        both = bits[i] & held[j]
        met = np.flatnonzero(both)
        i = i[met]
        return phrase[i], word[j[met]], block[i], both[met]


def _grouped(phrase: np.ndarray, word: np.ndarray, bits: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, word, popcount) of each pair and the pair each row belongs to."""
    key, of = np.unique(phrase.astype(np.int64) * words + word, return_inverse=True)
    return key // words, key % words, np.bincount(of, np.bitwise_count(bits), len(key)).astype(np.int64), of


def _counted(block: np.ndarray, bits: np.ndarray, context: int) -> np.ndarray:
    """bits without those of the first context positions."""
    return bits if not context else np.where(block == 0, bits & ~((1 << context) - 1), bits)


def shard_pairs(ids: np.ndarray, hashes: np.ndarray, context: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, count) of the pairs of words of a shard; those that end in the first context positions aren't counted."""
    maps = Bitmaps(ids)
    for at in range(0, len(maps.word), ENTRIES):
        part = slice(at, at + ENTRIES)
        first, word, block, bits = maps.extend(maps.word[part], maps.block[part], maps.bits[part])
        bits = _counted(block, bits, context)
        some = np.flatnonzero(bits)
        w1, w2, n, _ = _grouped(first[some], word[some], bits[some], len(hashes))
        yield _pair_hashes(hashes[w1], hashes[w2]), n


def shard_phrases(ids: np.ndarray, hashes: np.ndarray, context: int, frequent: Filter) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(words, count) of the phrases of two and of three words whose pairs are all in frequent, depth-first."""
    maps, words = Bitmaps(ids), len(hashes)
    for at in range(0, len(maps.word), ENTRIES):
        part = slice(at, at + ENTRIES)
        first, word, block, bits = maps.extend(maps.word[part], maps.block[part], maps.bits[part])
        w1, w2, _, of = _grouped(first, word, bits, words)
        known = frequent.has(_pair_hashes(hashes[w1], hashes[w2]))
        held = np.flatnonzero(known[of])
        pair, block, bits = of[held], block[held], bits[held]
        n = np.bincount(pair, np.bitwise_count(_counted(block, bits, context)), len(w1)).astype(np.int64)
        some = np.flatnonzero(n)
        yield [w1[some], w2[some]], n[some]
        pair, word, block, bits = maps.extend(pair, block, bits)
        bits = _counted(block, bits, context)
        some = np.flatnonzero(bits)
        pair, w3, n, _ = _grouped(pair[some], word[some], bits[some], words)
        some = np.flatnonzero(frequent.has(_pair_hashes(hashes[w2[pair]], hashes[w3])))
        yield [w1[pair[some]], w2[pair[some]], w3[some]], n[some]


class _Ids(dict):
    """Numbers words as they come. Blanks between words leave empty ones: -2; ends of pieces: -1."""

    def __init__(self):
        super().__init__({b"": -2, b"\n": -1})
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self[word] = len(self.words) - 1
        return len(self.words) - 1


class _Shard:
    """A language's positions so far: arrays of word numbers, how many, and how many of the first are context; texts that wait to be cut into words."""

    def __init__(self) -> None:
        self.names, self.parts, self.size, self.context = _Ids(), [], 0, 0
        self.texts, self.bytes = [], 0

    def words(self) -> np.ndarray:
        """The numbers of the waiting texts' words; each text ends as a piece does."""
        body = b"\n".join([*self.texts, b""]).translate(TABLE).replace(b"\n", b" \n ")
        self.texts, self.bytes = [], 0
        words = body.split(b" ")
        ids = np.fromiter(map(self.names.__getitem__, words), np.int32, len(words))
        return ids[ids > -2]

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.size += len(ids)


def _shards(batches: Iterator[pa.RecordBatch], positions: int) -> Iterator[tuple[str, list[bytes], np.ndarray, int]]:
    """(lang, words, ids, context) of each shard."""
    held: dict[str, _Shard] = defaultdict(_Shard)

    def full(lang: str) -> tuple[str, list[bytes], np.ndarray, int]:
        shard = held.pop(lang)
        return lang, shard.names.words, np.concatenate(shard.parts), shard.context

    def cut(lang: str) -> Iterator[tuple[str, list[bytes], np.ndarray, int]]:
        """Take in a language's waiting texts; the shards that they fill."""
        ids = held[lang].words()
        while held[lang].size + len(ids) > positions:
            shard = held[lang]
            room = positions - shard.size
            shard.add(ids[:room])
            names, tail = shard.names.words, np.concatenate(shard.parts[-MOST_WORDS:])[-(MOST_WORDS - 1) :]
            yield full(lang)
            # What goes on gets numbers of its own, after the last words of what was cut.
            fresh, rest = held[lang], np.r_[tail, ids[room:]]
            seen, back = np.unique(rest, return_inverse=True)
            ids = np.array([fresh.names[names[i]] if i >= 0 else -1 for i in seen.tolist()], np.int32)[back]
            fresh.context = len(tail)
        held[lang].add(ids)

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1)
        for lang, text in zip(langs, texts, strict=True):
            shard = held[lang]
            shard.texts.append(text.as_buffer().to_pybytes())
            shard.bytes += len(shard.texts[-1]) + 1
            if shard.bytes >= AT_ONCE:
                yield from cut(lang)
        while sum(s.size for s in held.values()) > 2 * positions:
            lang = max(held, key=lambda k: held[k].size)
            yield from cut(lang)
            yield full(lang)
    for lang in list(held):
        yield from cut(lang)
        yield full(lang)


def _rows(lang: str, parts: list[pa.Array], n: np.ndarray) -> pa.RecordBatch:
    phrase = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))
    return pa.record_batch([pa.repeat(lang, len(n)), phrase.cast(pa.string()), pa.array(n)], names=["lang", "phrase", "n"])


def _bodies(docs: DataFrame) -> DataFrame:
    return docs.select("lang", F.encode("text", "UTF-8").alias("text"))


def word_counts(docs: DataFrame, positions: int) -> DataFrame:
    """lang, phrase (a word) and n of docs (lang, text)."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, names, ids, context in _shards(batches, positions):
            counted = ids[context:]
            n = np.bincount(counted[counted >= 0], minlength=len(names))
            some = np.flatnonzero(n)
            if len(some):
                yield _rows(lang, [pa.array(names, pa.binary()).take(pa.array(some))], n[some])

    return _bodies(docs).mapInArrow(mine, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _frequent_shards(batches: Iterator[pa.RecordBatch], positions: int, words: Filter) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray, int]]:
    """(lang, words, ids, hashes, context) of shards; words that aren't frequent take positions as ends of pieces do."""
    for lang, names, ids, context in _shards(batches, positions):
        if names:
            hashes = _word_hashes(lang, names)
            yield lang, names, np.where(np.r_[words.has(hashes), False][ids], ids, np.int32(-1)), hashes, context


def pair_counts(docs: DataFrame, words: tuple[int, np.ndarray], positions: int) -> DataFrame:
    """h and n: how often the pairs of frequent words of each hash occur."""
    maps = docs.sparkSession.sparkContext.broadcast(words)

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, ids, hashes, context in _frequent_shards(batches, positions, Filter(*maps.value)):
            for h, n in shard_pairs(ids, hashes, context):
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return _bodies(docs).mapInArrow(mine, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, words: tuple[int, np.ndarray], pairs: tuple[int, np.ndarray], positions: int) -> DataFrame:
    """lang, phrase (two or three words) and n of phrases whose words and pairs the maps have."""
    maps = docs.sparkSession.sparkContext.broadcast((words, pairs))

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, known = (Filter(*x) for x in maps.value)
        for lang, names, ids, hashes, context in _frequent_shards(batches, positions, frequent):
            texts = pa.array(names, pa.binary())
            for parts, n in shard_phrases(ids, hashes, context, known):
                if len(n):
                    yield _rows(lang, [texts.take(pa.array(w)) for w in parts], n)

    return _bodies(docs).mapInArrow(mine, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _map(rows: DataFrame, h: Column) -> tuple[int, np.ndarray]:
    """A bit map of the hashes h of rows."""
    bits = min(MOST_BITS, max(LEAST_BITS, (rows.count() * BITS_EACH).bit_length()))
    return bits, bit_map(rows.select(h.alias("h")), bits)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, positions: int = POSITIONS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first top phrases."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), text_of(text).alias("text"))
    words = materialize(word_counts(rows, positions), "words")
    frequent = words.where(F.col("n") >= least)
    of_words = _map(frequent, hash_of(F.col("lang"), F.col("phrase")))
    pairs = materialize(pair_counts(rows, of_words, positions).where(F.col("n") >= least), "pairs")
    longer = materialize(phrase_counts(rows, of_words, _map(pairs, F.col("h")), positions).where(F.col("n") >= least), "phrases")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    of = lambda k: longer.where(F.size(F.split("phrase", " ")) == k)
    return ranked(materialize(scored(frequent, of(2), of(3)), "scored"), totals, top)


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)): a million at most, as a phrase is no more frequent than its parts."""
    long = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"({long(a)} * {long(a)} * 1000000BD) div ({long(left)} * {long(right)})")


def scored(words: DataFrame, two: DataFrame, three: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates (frequent phrases of two and three words) that no longer one takes in."""
    part = F.split("phrase", " ")
    known = words.unionByName(two)  # the parts that candidates are cut into
    first = known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    last = known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    join = lambda *at: F.array_join(F.array(*[part[i] for i in at]), " ")
    cuts = two.select("lang", "phrase", F.col("n").alias("a"), F.lit(1).alias("k"), part[0].alias("left"), part[1].alias("right"))
    for k, left, right in ((1, (0,), (1, 2)), (2, (0, 1), (2,))):
        cuts = cuts.unionByName(three.select("lang", "phrase", F.col("n").alias("a"), F.lit(k).alias("k"), join(*left).alias("left"), join(*right).alias("right")))
    cuts = cuts.join(first, ["lang", "left"]).join(last, ["lang", "right"]).withColumn("score", _score("a", "l", "r"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c")).select("lang", "phrase", "c.a", "c.l", "c.r", "c.score")
    inside = three.select("lang", F.col("n").alias("longer"), F.explode(F.array(join(0, 1), join(1, 2))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    found = lowest.join(inside, ["lang", "phrase"], "left")
    return found.where(F.col("longer").isNull() | (100 * F.col("longer") < ABSORBED * F.col("a"))).drop("longer")


def ranked(found: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """The first top phrases of each language.

    Scores (a million at most) are counted in SCORE_CELLS cells for each doubling; what lies below the cell of a language's top-th is left out. Of the rest each of RANK_PARTS parts is ranked, then what
    these leave: top * RANK_PARTS rows at most, and that only where as many share a cell.
    """
    found = found.withColumn("cell", F.floor(F.log2(F.col("score") + 1) * SCORE_CELLS))
    cells = found.groupBy("lang", "cell").agg(F.count("*").alias("held"))
    above = F.sum("held").over(Window.partitionBy("lang").orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1))
    least = cells.withColumn("above", F.coalesce(above, F.lit(0))).where(F.col("above") < top).groupBy("lang").agg(F.min("cell").alias("least"))
    found = found.join(least, "lang").where("cell >= least").drop("cell", "least")
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    dealt = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11 = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT *, f AS a, array_to_string(w[1:j], ' ') AS lhs, array_to_string(w[j + 1:], ' ') AS rhs FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1 AND f >= 10)),
s AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, c.j, ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM c JOIN f x ON x.lang = c.lang AND x.phrase = c.lhs JOIN f y ON y.lang = c.lang AND y.phrase = c.rhs),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, f, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM f WHERE k = 3 AND f >= 10) GROUP BY 1, 2),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a)
SELECT o.lang, o.rank, o.phrase, o.a, o.l, o.r, n.n, o.score FROM o JOIN n USING (lang) WHERE o.rank <= 2000
"""

QUERIES = {"op11_phrases": op11_phrases}
ORACLES = {"op11_phrases": OP11}
