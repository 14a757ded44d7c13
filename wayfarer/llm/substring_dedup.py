"""Substring dedup by compact windows.

A text's tokens are its shingles of five words (letters and digits, lower case). For each of HASHES hash functions the
text's Cartesian tree over them has a compact window (l, c, r) for each token c: all subsequences of [l, r] that contain c
have the min-hash of c. All blocks of BLOCK tokens (50 words) of a text are thus covered by
few windows for each hash, and windows with equal min-hash in different texts group blocks that may be near-duplicates.
Within a text, the windows' intervals of block starts are joined across the hashes: only blocks that share
their min-hash with another text under every hash are candidates. Equal candidates form a class, whose owner is the text of
least id. Runs of starts with equal min-hashes are a text's cells: candidates that have them under every hash in another text lie in cells
of one key, and are compared by the Jaccard similarity of their tokens with those of the key's representatives, the cells of
lesser ids that are not all similar to others; from SIMILARITY they are near-duplicates. Keys of many cells are taken in turns by many tasks. Blocks that follow one another make a passage. Passages of
one pair of texts along nearly one diagonal with short gaps are put together if the equal tokens are SIMILARITY of the union.

Equal texts are handled once, as one text of their least id; a text of 50 words or more that several documents have is
itself a repeated passage. No repeat of BLOCK tokens or more is lost: its blocks have equal min-hashes; a block of similarity x
has another's min-hashes with a chance of about x^HASHES, and a near-duplicate passage has many blocks. Null texts count as empty;
shorter texts have no passages; repeats within one text alone aren't reported; rows of one id and text are one document. Empty tables give
empty results; remove_passages passes all columns through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import accumulate, batched, pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table, text_of
from .decontamination import WORD, run_hashes

WORDS, BLOCK, HASHES, SIMILARITY = 5, 46, 2, 0.8
#: Tokens between parts of a near-duplicate passage, and by how much its parts' diagonals may differ.
GAP, DRIFT = 15, 5
MIX = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


#: Characters of texts that are worked on together; a longer text is alone.
PIECE = 1 << 17
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@cache
def _in_words() -> tuple[np.ndarray, bytes]:
    """For each code point, whether WORD has it; the same of ASCII as a table of bytes."""
    found = np.zeros(0x110000, bool)
    found[[i for m in WORD.finditer("".join(map(chr, range(0x110000)))) for i in range(*m.span())]] = True
    return found, found[:256].tobytes()


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of words (WORD in lower case) of each text, and a 64-bit hash of each word from its bytes, eight at a time."""
    lower = [x.lower() for x in texts]
    joined = "\n".join(lower)
    raw = joined.encode("utf-8", "surrogatepass")
    every, ascii_only = _in_words()
    inside, at = np.zeros(len(joined) + 2, bool), None
    if joined.isascii():
        inside[1:-1] = np.frombuffer(raw.translate(ascii_only), bool)
    else:
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        inside[1:-1] = every[codes]
        at = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(1 + (codes > 0x7F).view(np.int8) + (codes > 0x7FF).view(np.int8) + (codes > 0xFFFF).view(np.int8), out=at[1:])
    bounds = np.flatnonzero(inside[1:] != inside[:-1])
    counts = np.diff(np.searchsorted(bounds[::2], np.cumsum([0] + [len(x) + 1 for x in lower])))
    if at is not None:
        bounds = at[bounds]
    starts, sizes = bounds[::2], bounds[1::2] - bounds[::2]
    eight = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,))  # the eight bytes from each place on
    found = _mixed((eight[starts] & FIRST_BYTES[np.minimum(sizes, 8)]) ^ (sizes.astype(np.uint64) * MIX[2]), 0)
    for done in range(8, LONG_WORD, 8):
        more = np.flatnonzero(sizes > done)
        if not len(more):
            break
        found[more] = _mixed((eight[starts[more] + done] & FIRST_BYTES[np.minimum(sizes[more] - done, 8)]) ^ found[more], 1)
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        found[i] = xxhash.xxh64_intdigest(raw[starts[i] : starts[i] + sizes[i]])
    return counts, found


def text_tokens(texts: Iterable[str], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of PIECE characters of texts at a time: each text's number of words, the tokens of all, where each text's begin and the last's end."""
    texts, a = list(texts), 0
    while a < len(texts):
        b, size = a + 1, len(texts[a])
        while b < len(texts) and (size := size + len(texts[b])) <= PIECE:
            b += 1
        counts, each = word_hashes(texts[a:b])
        tokens, n = run_hashes(each, width), np.maximum(counts - width + 1, 0)
        at = np.append(0, np.cumsum(n))
        inside = np.arange(at[-1]) + np.repeat(np.cumsum(counts) - counts - at[:-1], n)
        yield counts, tokens[inside], at
        a = b


def _mixed(tokens: np.ndarray, j: int) -> np.ndarray:
    x = tokens ^ MIX[j]
    x = (x ^ (x >> np.uint64(31))) * MIX[(j + 1) % len(MIX)]
    return x ^ (x >> np.uint64(29))


def least_of(order: np.ndarray, block: int) -> np.ndarray:
    """The least of each run of block values, by doubling."""
    found, size = order, 1
    while 2 * size <= block:
        found = np.minimum(found[:-size], found[size:])
        size *= 2
    return np.minimum(found[: len(order) - block + 1], found[block - size :])


def compact_windows(order: np.ndarray, at: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(least token, text, first and last block start) of the nodes of each text's Cartesian tree that hold blocks; at as in text_tokens.

    A node (l, c, r) holds the blocks in [l, r] around c, which are the blocks whose least token is c: a run of starts.
    Neighbouring runs with equal least tokens are one.
    """
    n = np.maximum(np.diff(at) - block + 1, 0)
    if not n.sum():
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    text, ends = np.repeat(np.arange(len(n)), n), np.cumsum(n)
    start = np.arange(ends[-1]) - np.repeat(ends - n, n)
    least = least_of(order, block)[start + at[text]]
    cuts = np.flatnonzero((least[1:] != least[:-1]) | (text[1:] != text[:-1]))
    lo, hi = np.append(0, cuts + 1), np.append(cuts, len(least) - 1)
    return least[lo], text[lo], start[lo], start[hi]


#: spans: hash number, first and last start of the blocks a window covers, packed into one long.
WINDOWS = T.StructType([T.StructField("words", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("spans", T.ArrayType(T.LongType()))])
STARTS = 30


def _by_text(text: np.ndarray, texts: int, *values: np.ndarray) -> list[list[np.ndarray]]:
    """Each of values, whose entries are in the order of their texts, cut at the texts."""
    cuts = np.searchsorted(text, np.arange(texts + 1)).tolist()
    return [[x[a:b] for a, b in pairwise(cuts)] for x in values]


def text_windows(texts: Iterable[str], block: int, count: int, words: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Words, and key and span of each compact window, of each text."""
    for sizes, tokens, at in text_tokens(texts, words):
        keys, spans, owners = [], [], []
        for j in range(count):
            least, text, lo, hi = compact_windows(_mixed(tokens, j), at, block)
            keys.append((least ^ MIX[-1 - j]).view(np.int64))
            spans.append((np.int64(j) << (2 * STARTS)) | (lo << STARTS) | hi)
            owners.append(text)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        yield from zip(sizes.tolist(), *_by_text(owner[order], len(sizes), np.concatenate(keys)[order], np.concatenate(spans)[order]), strict=True)


def block_hashes(tokens: np.ndarray, block: int) -> np.ndarray:
    """A hash of each run of block tokens, from a polynomial modulo 2^64 of well-mixed tokens."""
    base = np.uint64(0x9E3779B97F4A7C15)
    found = np.zeros(len(tokens) - block + 1, np.uint64)
    x = _mixed(tokens, 3)
    # Doubling: runs of 1, 2, 4, ... tokens, put together by the bits of block.
    run, size, done, power = x, 1, 0, base
    rest = block
    while rest:
        if rest & 1:
            piece = run[done : done + len(found)]
            shift = np.uint64(pow(int(base), done, 1 << 64))
            found += piece * shift
            done += size
        rest >>= 1
        if rest:
            run = run[: len(run) - size] + run[size:] * power
            size *= 2
            power = np.uint64(pow(int(base), size, 1 << 64))
    return found ^ (found >> np.uint64(32))


#: keys, los, firsts and tokens have an entry for each cell. firsts: the least token's place under the first hash; tokens: 32 bits of each of the cell's tokens.
BLOCKS = T.StructType([T.StructField(name, T.ArrayType(kind)) for name, kind in (("starts", T.IntegerType()), ("blocks", T.LongType()), ("keys", T.LongType()), ("los", T.IntegerType()), ("firsts", T.IntegerType()), ("tokens", T.BinaryType()))])


def cells_of(tokens: np.ndarray, starts: np.ndarray, block: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """The cells as in BLOCKS: runs of these starts, of block at most, whose blocks have the same least token under every hash function."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), []
    orders = [_mixed(tokens, j) for j in range(count)]
    least = [least_of(x, block)[starts] for x in orders]
    cut = np.diff(starts) > 1
    key = np.zeros(len(starts), np.uint64)
    for x in least:
        cut |= x[1:] != x[:-1]
        key = key * np.uint64(0x9E3779B97F4A7C15) + x
    first = np.append(0, np.flatnonzero(cut) + 1)
    ends = np.append(first[1:], len(starts))
    if (ends - first).max() > block:  # a least token that is repeated makes longer runs
        first = np.concatenate([np.arange(a, b, block) for a, b in zip(first.tolist(), ends.tolist(), strict=True)])
    last = np.append(first[1:], len(starts)) - 1
    lo, raw = starts[first], (_mixed(tokens, 2) >> np.uint64(32)).astype("<u4").tobytes()
    place = lo + (orders[0][lo[:, None] + np.arange(block)] == least[0][first][:, None]).argmax(axis=1)
    held = [raw[a:b] for a, b in zip((4 * lo).tolist(), (4 * (starts[last] + block)).tolist(), strict=True)]
    return key.view(np.int64)[first], lo, place, held


def candidate_blocks(texts: Iterable[str], spans: Iterable[np.ndarray], block: int, count: int, words: int = WORDS) -> Iterator[tuple]:
    """A BLOCKS row of each text: starts and hashes of the blocks that lie in a span of every hash function, and their cells."""
    spans, mask = iter(spans), (1 << STARTS) - 1
    for sizes, tokens, at in text_tokens(texts, words):
        agreed = []
        for first, n, mine in zip(at[:-1].tolist(), np.maximum(np.diff(at) - block + 1, 0).tolist(), spans, strict=False):
            agree, hash_number = np.ones(n, bool), mine >> (2 * STARTS)
            for j in range(count if n else 0):
                own = mine[hash_number == j]
                edge = np.bincount((own >> STARTS) & mask, minlength=n + 1) - np.bincount((own & mask) + 1, minlength=n + 1)
                agree &= np.cumsum(edge[:n]) > 0
            agreed.append(np.flatnonzero(agree) + first)
        starts = np.concatenate(agreed)  # of one text and the next there are block - 1 places between: no cell has both
        keys, los, firsts, held = cells_of(tokens, starts, block, count)
        hashed = block_hashes(tokens, block)[starts].view(np.int64) if len(starts) else np.empty(0, np.int64)
        of_start, of_cell = (np.searchsorted(at, x, "right") - 1 for x in (starts, los))
        blocks = _by_text(of_start, len(sizes), (starts - at[of_start]).astype(np.int32), hashed)
        yield from zip(*blocks, *_by_text(of_cell, len(sizes), keys, (los - at[of_cell]).astype(np.int32), (firsts - at[of_cell]).astype(np.int32), held), strict=True)


class Cell:
    """A cell's tokens and, as they are asked for, the sets of its blocks."""

    def __init__(self, text: int, lo: int, first: int, tokens: bytes, block: int):
        self.text, self.lo, self.first, self.raw, self.block = text, lo, first - lo, tokens, block
        self.array = np.frombuffer(tokens, "<u4")
        self.tokens = self.array.tolist()
        self.all, self.count = set(self.tokens), len(self.tokens) - block + 1
        self.single = len(self.all) == len(self.tokens)
        self.sets: dict[int, set[int]] = {}
        self.held: tuple[np.ndarray, np.ndarray] | None = None

    def contents(self) -> tuple[np.ndarray, np.ndarray]:
        """The cell's different tokens in order, and for each of them and each block 1 if the block has it."""
        if self.held is None:
            names, at = np.unique(self.array, return_inverse=True)
            sums = np.zeros((len(names), len(self.array) + 1), np.int32)
            sums[at, np.arange(1, len(self.array) + 1)] = 1
            np.cumsum(sums, axis=1, out=sums)
            self.held = names, (sums[:, self.block :] > sums[:, : -self.block]).astype(np.float32)
        return self.held

    def at(self, s: int) -> set[int]:
        if s not in self.sets:
            self.sets[s] = set(self.tokens[s : s + self.block])
        return self.sets[s]

    def shared(self, s: int, other: set[int]) -> list[int]:
        """The places of the block's tokens that are in other."""
        return [self.lo + k for k in range(s, s + self.block) if self.tokens[k] in other]


def jaccard(cell: Cell, other: Cell, starts: list[int]) -> np.ndarray:
    """Jaccard similarity of the blocks at starts with each block of other."""
    (names, a), (others, b) = cell.contents(), other.contents()
    at = np.minimum(np.searchsorted(others, names), len(others) - 1)
    in_both = others[at] == names
    a = a[:, starts]
    both = a[in_both].T @ b[at[in_both]]
    return both / (a.sum(axis=0)[:, None] + b.sum(axis=0)[None, :] - both)


def similar(cell: Cell, other: Cell, starts: Iterable[int], similarity: float) -> dict[int, int]:
    """For each of cell's starts that has a block of other of that similarity, the start of one, on the diagonal if there is one there."""
    block, shift, found = cell.block, cell.first - other.first, {}
    a, b = max(0, shift), min(cell.count, other.count + shift)
    single = cell.single and other.single
    need = 2 * similarity / (1 + similarity) * block - 1e-9
    if single and len(cell.all & other.all) < need:
        return found
    if b > a:
        same = cell.array[a : b + block - 1] == other.array[a - shift : b - shift + block - 1]
        if same.all():
            found = {s: s - shift for s in starts if a <= s < b}
        elif single and np.count_nonzero(same) >= need:
            sums = np.cumsum(same)
            sums[block:] -= sums[:-block].copy()
            ok = (sums[block - 1 :] >= need).tolist()
            found = {s: s - shift for s in starts if a <= s < b and ok[s - a]}
    rest = [s for s in starts if s not in found]
    if not rest:
        return found
    # So many of the block's tokens must be anywhere in other.
    theirs = other.all
    held = list(accumulate([x in theirs for x in cell.tokens], initial=0))
    rest = [s for s in rest if held[s + block] - held[s] >= (need if single else similarity * len(cell.at(s)) - 1e-9)]
    if not rest:
        return found
    far = np.abs(np.arange(other.count)[None, :] - np.array(rest)[:, None] + shift)
    far[jaccard(cell, other, rest) < similarity - 1e-6] = 1 << 30
    return found | {s: t for s, t, d in zip(rest, far.argmin(axis=1).tolist(), far.min(axis=1).tolist(), strict=True) if d < 1 << 30}


class Heads:
    """A key's representatives, and for each token those that hold it as the bits of a number, of PART or so at a time.

    One without repeated tokens has a bit, as its blocks are of one size; of others each block has one. owners and sizes: for each bit the representative and its block's size.
    """

    PART, FEW = 1024, 8

    def __init__(self, similarity: float, block: int):
        self.similarity, self.share, self.width = similarity, similarity / (1 + similarity), -(-max(self.PART, block) // 8)
        self.cells, self.parts, self.owners, self.sizes, self.known = [], [], [], [], 0

    def add(self, cell: Cell) -> None:
        self.cells.append(cell)

    def _put_in(self, cell: Cell) -> None:
        sets = [cell.all] if cell.single else [cell.at(s) for s in range(cell.count)]
        if not self.parts or len(self.owners[-1]) + len(sets) > 8 * self.width:
            self.parts.append({})
            self.owners.append([])
            self.sizes.append([])
        part, owners = self.parts[-1], self.owners[-1]
        for held in sets:
            bit = 1 << len(owners)
            for x in held:
                part[x] = part.get(x, 0) | bit
            owners.append(self.known)
            self.sizes[-1].append(min(len(held), cell.block))
        self.known += 1

    def able(self, cell: Cell, i: int) -> np.ndarray:
        """For each block of the cell and each bit of a part, whether it has so many of the block's tokens as a similar block shares."""
        part, (names, inside), sizes = self.parts[i], cell.contents(), np.array(self.sizes[i], np.float32)
        held = np.frombuffer(b"".join([part.get(x, 0).to_bytes(self.width, "little") for x in names.tolist()]), np.uint8).reshape(-1, self.width)
        shared = inside.T @ np.unpackbits(held, axis=1, count=len(sizes), bitorder="little").astype(np.float32)
        # Sets of a and b tokens with that similarity share this part of a + b or more.
        return shared >= (inside.sum(axis=0)[:, None] + sizes) * np.float32(self.share) - np.float32(1e-3)

    def after(self, cell: Cell, left: list[int]) -> Iterator[Cell]:
        """Those that may have a block similar to one of left, or all if they are few, in order; left is what the caller has left by then."""
        if len(self.cells) <= self.FEW:  # most keys never have more, and need no sets
            yield from self.cells
            return
        for held in self.cells[self.known :]:
            self._put_in(held)
        last = -1
        for i, owners in enumerate(self.owners):
            able, at = self.able(cell, i), 0
            while left and at < len(owners):
                before = len(left)
                for k in (np.flatnonzero(able[left, at:].any(axis=0)) + at).tolist():
                    at = k + 1
                    if owners[k] != last:
                        last = owners[k]
                        yield self.cells[last]
                        if len(left) < before:  # fewer may do for what is left
                            break
                else:
                    break


NEAR = T.StructType([T.StructField("text_hash", T.LongType()), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()), T.StructField("owner_hash", T.LongType()), T.StructField("owner_start", T.IntegerType()), T.StructField("near", T.BooleanType())])


def cell_runs(cell: Cell, heads: Heads, left: list[int]) -> Iterator[tuple[int, int, int, int, int, bool]]:
    """NEAR rows of the starts of left that a representative has a similar block to, the first that has; they are taken out of left.

    Equal blocks are left to the classes: a run has one that is not equal. near is false where all that is left of its blocks is equal.
    """
    block = cell.block
    for head in heads.after(cell, left):
        if not left:
            break
        if head.text == cell.text:
            continue
        found = similar(cell, head, left, heads.similarity)
        left[:] = [s for s in left if s not in found]
        run: list[int] = []
        for s in [*sorted(found), None]:
            if run and (s is None or s > run[-1] + 1):
                if any(cell.raw[4 * x : 4 * (x + block)] != head.raw[4 * found[x] : 4 * (found[x] + block)] for x in run):
                    ends = [run[0], run[-1]]
                    own = [k for x in ends for k in cell.shared(x, head.at(found[x]))]
                    theirs = [k for x in ends for k in head.shared(found[x], cell.at(x))]
                    a, b, start, end = min(own), max(own) + 1, min(theirs), max(theirs) + 1
                    differ = cell.tokens[a - cell.lo : b - cell.lo] != head.tokens[start - head.lo : end - head.lo]
                    yield cell.text, a, b, head.text, start, differ
                    yield head.text, start, end, head.text, start, differ
                run = []
            run.append(s)


def near_runs(rows: Iterable[tuple[int, int, int, int, bytes]], block: int, similarity: float) -> Iterator[tuple[int, int, int, int, int, bool]]:
    """NEAR rows from (key, text_hash, lo, first, tokens), sorted by key and then from the owner on.

    Each start is given to the first representative that is similar; a cell with a start left becomes one itself.
    """
    last, heads = None, Heads(similarity, block)
    for key, text, lo, first, tokens in rows:
        if key != last:
            last, heads = key, Heads(similarity, block)
        cell = Cell(text, lo, first, tokens, block)
        left = list(range(cell.count))
        yield from cell_runs(cell, heads, left)
        if left:
            heads.add(cell)


#: Of a key with more cells than TOGETHER: NEAR rows where cell is false, cells with starts left where it is true. Nothing is null.
STEP = T.StructType([T.StructField("cell", T.BooleanType()), *NEAR.fields, *(T.StructField(*x) for x in (("key", T.LongType()), ("place", T.LongType()), ("first", T.IntegerType()), ("tokens", T.BinaryType()), ("left", T.ArrayType(T.IntegerType())), ("turn", T.IntegerType()), ("slices", T.IntegerType())))])
STATE = ["key", "place", "text_hash", "lo", "first", "tokens", "left", "turn", "slices"]


def step_runs(rows: Iterable[tuple], block: int, similarity: float, alone: bool) -> Iterator[tuple]:
    """STEP rows from (group, head, *STATE), sorted by key and group, representatives (head) first, then by place.

    alone: the cells are all of their turn, and those with starts left become representatives; else they are compared with the turn's representatives only.
    """
    last, heads = None, Heads(similarity, block)
    for group, head, key, place, text, lo, first, tokens, left, turn, slices in rows:
        if (key, group) != last:
            last, heads = (key, group), Heads(similarity, block)
        cell = Cell(text, lo, first, tokens, block)
        if head:
            heads.add(cell)
            continue
        rest = list(range(cell.count)) if left is None else [int(x) for x in left]
        for run in cell_runs(cell, heads, rest):
            yield False, *run, key, place, 0, b"", [], turn, slices
        if rest:
            yield True, text, lo, 0, 0, 0, False, key, place, first, tokens, rest, turn, slices
            if alone:
                heads.add(cell)


def find_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", block: int = BLOCK, count: int = HASHES, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, start_word, end_word (exclusive), kind, owner_id, owner_start of each repeated passage.

    kind is copy (the whole text), exact or near. owner_id is the least id among the texts that have the passage; the
    owner's own passage is listed as well, with itself for an owner.
    """
    body = text_of(text)

    @F.pandas_udf(WINDOWS)
    def windows(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(text_windows(texts, block, count, words)), columns=["words", "keys", "spans"])

    @F.pandas_udf(BLOCKS)
    def blocks(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(candidate_blocks(texts, spans, block, count, words)), columns=BLOCKS.names)

    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(body).alias("text_hash"), windows(body).alias("w"))
    rows = materialize(rows.select("doc_id", "text_hash", "w.words", "w.keys", "w.spans"), "windows")
    texts = rows.groupBy("text_hash").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("docs"))
    keyed = rows.select("text_hash", F.explode(F.arrays_zip("keys", "spans")).alias("w")).select("text_hash", F.col("w.keys").alias("key"), F.col("w.spans").alias("span"))
    shared = keyed.groupBy("key").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("a != b").select("key")
    shared = materialize(shared, "shared")  # a table of its own, so that a frequent key's side of the join can be split
    met = keyed.join(shared, "key", "left_semi").groupBy("text_hash").agg(F.collect_set("span").alias("spans"))
    met = met.where(F.size(F.array_distinct(F.transform("spans", lambda x: F.shiftright(x, 2 * STARTS)))) == count)
    met = materialize(met.join(texts.select("text_hash", "rep"), "text_hash"), "met")
    source = docs.select(F.col(key).alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    joined = source.join(met, (source["text_hash"] == met["text_hash"]) & source["doc_id"].eqNullSafe(met["rep"])).select(met["text_hash"], "rep", blocks("text", "spans").alias("b"))
    held = materialize(joined.select("text_hash", "rep", "b.*"), "blocks")  # a repeated row's blocks come twice, which changes no run
    found = held.select("text_hash", "rep", F.explode(F.arrays_zip("starts", "blocks")).alias("x")).select("text_hash", "rep", F.col("x.starts").alias("start"), F.col("x.blocks").alias("block"))
    owner = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "text_hash", "start")).alias("o")
    classes = found.groupBy("block").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b"), owner).where("a != b").select("block", F.col("o.rep").alias("owner_id"), F.col("o.text_hash").alias("owner_hash"), F.col("o.start").alias("owner_start"))
    classes = materialize(classes, "classes")  # a table of its own, so that a frequent block's side of the join can be split
    hits = found.join(classes, "block")
    # Runs of starts with one owner along one diagonal are passages; a text's blocks are at most its words.
    in_text = Window.partitionBy("text_hash").orderBy("start")
    hits = hits.withColumn("diagonal", F.col("start") - F.col("owner_start"))
    changed = lambda c: F.col(c) - F.lag(c).over(in_text)
    other = (F.col("owner_hash") != F.lag("owner_hash").over(in_text)) | (changed("diagonal") != 0)
    runs = hits.withColumn("fresh", F.coalesce((changed("start") > 1) | other, F.lit(True)).cast("int")).withColumn("run", F.sum("fresh").over(in_text))
    first = lambda c: F.min_by(c, "start").alias(c)
    runs = runs.groupBy("text_hash", "rep", "run").agg(F.min("start").alias("lo"), (F.max("start") + block).alias("hi"), first("owner_id"), first("owner_hash"), first("owner_start"))
    exact = runs.select("text_hash", "lo", "hi", "owner_id", "owner_hash", "owner_start", F.lit(False).alias("near"))
    near = _similar_runs(held, block, similarity).join(texts.select(F.col("text_hash").alias("owner_hash"), F.col("rep").alias("owner_id")), "owner_hash")
    near = near.select("text_hash", "lo", "hi", "owner_id", "owner_hash", "owner_start", "near")
    passages = materialize(_near(exact.unionByName(near), similarity, block).select("text_hash", F.col("lo").alias("start_word"), (F.col("hi") + words - 1).alias("end_word"), "kind", "owner_id", "owner_start"), "passages")
    every = rows.select("doc_id", "text_hash").distinct()
    out = every.join(passages, "text_hash").select("doc_id", "text_hash", "start_word", "end_word", "kind", "owner_id", "owner_start")
    copies = rows.join(texts.where("docs > 1"), "text_hash").where(F.col("words") >= block + words - 1)
    copies = copies.select("doc_id", "text_hash", F.lit(0).alias("start_word"), F.col("words").alias("end_word"), F.lit("copy").alias("kind"), F.col("rep").alias("owner_id"), F.lit(0).alias("owner_start")).distinct()
    return out.unionByName(copies)


#: Cells of a key that a task compares with one another. A key with more has them taken in turns.
TOGETHER = 2048


def _batches(rows: Iterable[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    for batch in batched(rows, 4096):
        yield pd.DataFrame(list(batch), columns=names)


def _similar_runs(held: DataFrame, block: int, similarity: float, together: int = TOGETHER) -> DataFrame:
    """NEAR rows of the cells of held; cells of keys that only one text has, or only equal ones, are left out before."""
    cells = held.select("rep", "text_hash", F.explode(F.arrays_zip("keys", "los", "firsts", "tokens")).alias("c"))
    cells = cells.select(F.col("c.keys").alias("key"), "c.tokens", F.struct(F.col("rep").isNull().alias("none"), "rep", "text_hash", F.col("c.los").alias("lo"), F.col("c.firsts").alias("first")).alias("at"))
    # Equal cells are in the classes as a whole: one of them is compared, and copies meet in partial aggregates.
    alike = cells.groupBy("key", "tokens").agg(F.min("at").alias("at"))
    alike = materialize(alike, "cells")
    keys = alike.groupBy("key").agg(F.min("at.text_hash").alias("a"), F.max("at.text_hash").alias("b"), F.count("*").alias("n")).where("a != b").select("key", "n")
    keys = materialize(keys, "keys")
    many = F.col("n") > together
    met = alike.join(keys.where(~many), "key", "left_semi").repartition("key").sortWithinPartitions("key", "at").select("key", "at.text_hash", "at.lo", "at.first", "tokens")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (x for f in frames for x in zip(*(f[c].tolist() for c in ("key", "text_hash", "lo", "first", "tokens")), strict=True))
        return _batches(near_runs(rows, block, similarity), NEAR.names)

    found = met.mapInPandas(compare, NEAR)
    if total := keys.where(many).agg(F.sum("n")).first()[0]:
        for more in _runs_by_turns(alike.join(keys.where(many), "key", "left_semi"), total, block, similarity, together):
            found = found.unionByName(more)
    return materialize(found.distinct(), "near")


def _runs_by_turns(cells: DataFrame, total: int, block: int, similarity: float, together: int) -> list[DataFrame]:
    """NEAR rows of near_runs of cells (key, tokens, at), of whose keys a task has little more than together cells.

    In a turn, each key's next cells, about together of them, are compared in one task; then all later cells are with the turn's representatives, in many.
    So a cell meets the same representatives in the same order as if the key were in one task.
    """
    # Places are in the order of key and at, and a partition's are a run of it.
    ordered = cells.repartitionByRange(math.ceil(4 * total / together), "key", "at").sortWithinPartitions("key", "at")
    ordered = materialize(ordered.select("key", F.monotonically_increasing_id().alias("place"), "at.text_hash", "at.lo", "at.first", "tokens"), "places")
    ordered = ordered.withColumn("run", F.shiftright("place", 33))
    of_key = Window.partitionBy("key")
    turns = ordered.groupBy("key", "run").agg(F.count("*").alias("n"))
    turns = turns.withColumns({"before": F.sum("n").over(of_key.orderBy("run")) - F.col("n"), "all": F.sum("n").over(of_key)})
    turns = turns.select("key", "run", F.floor(F.col("before") / together).cast("int").alias("turn"), F.ceil(2 * F.col("all") / together).cast("int").alias("slices"))
    rest = materialize(ordered.join(turns, ["key", "run"]).withColumn("left", F.lit(None).cast("array<int>")).select(*STATE), "turns")

    def step(rows: DataFrame, alone: bool, name: str) -> DataFrame:
        def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = (x for f in frames for x in zip(*(f[c].tolist() for c in ("slice", "head", *STATE)), strict=True))
            return _batches(step_runs(held, block, similarity, alone), STEP.names)

        return materialize(rows.repartition("key", "slice").sortWithinPartitions("key", "slice", F.desc("head"), "place").mapInPandas(compare, STEP), name)

    found, last = [], rest.agg(F.max("turn")).first()[0]
    for turn in range(last + 1):
        own = step(rest.where(F.col("turn") == turn).withColumns({"slice": F.lit(0), "head": F.lit(False)}), True, "turn")
        found.append(own.where("not cell").select(*NEAR.names))
        if turn < last:
            later = rest.where(F.col("turn") > turn).withColumns({"slice": F.expr("cast(pmod(xxhash64(place), slices) as int)"), "head": F.lit(False)})
            heads = own.where("cell").withColumns({"slice": F.explode(F.sequence(F.lit(0), F.col("slices") - 1)), "head": F.lit(True)})
            parts = step(heads.select(*later.columns).unionByName(later), False, "rest")
            found.append(parts.where("not cell").select(*NEAR.names))
            rest = parts.where("cell").select(*STATE)
    return found


def _near(runs: DataFrame, similarity: float, block: int) -> DataFrame:
    """runs, with those of one pair of texts put together where that makes a near-duplicate passage."""
    runs = runs.withColumn("diagonal", F.col("lo") - F.col("owner_start"))
    pair = Window.partitionBy("text_hash", "owner_hash").orderBy("lo", "hi", "diagonal", "near")
    before = F.max("hi").over(pair.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.col("lo") - before > GAP) | (F.abs(F.col("diagonal") - F.lag("diagonal").over(pair)) > DRIFT)
    chained = runs.withColumns({"before": before, "run": F.row_number().over(pair), "fresh": F.coalesce(apart, F.lit(True)).cast("int")}).withColumn("chain", F.sum("fresh").over(pair))
    whole = Window.partitionBy("text_hash", "owner_hash", "chain")
    span = F.max("hi").over(whole) - F.min("lo").over(whole)
    other = F.max(F.col("hi") - F.col("diagonal")).over(whole) - F.min("owner_start").over(whole)
    # A similar block has this share of equal tokens at least.
    share = F.when(F.col("near"), 2 * similarity / (1 + similarity)).otherwise(1.0)
    inside = F.col("fresh") == 0
    new = F.col("hi") - F.when(inside, F.greatest("lo", F.least("before", "hi"))).otherwise(F.col("lo"))
    same = F.sum(new * share).over(whole)
    open_gap = F.coalesce(F.max(F.when(inside, F.col("lo") - F.col("before"))).over(whole) > 0, F.lit(False))
    straight = F.min("diagonal").over(whole) == F.max("diagonal").over(whole)
    joins = (F.count("*").over(whole) > 1) & (~open_gap | (same >= similarity * (span + other - same)))
    marked = chained.withColumns({"joins": joins, "edited": joins & (open_gap | ~straight)}).withColumn("part", F.when(F.col("joins"), F.col("chain")).otherwise(-F.col("run")))
    first = lambda c: F.min_by(c, "lo").alias(c)
    short = F.max("hi") - F.min("lo") < block
    kind = F.when(F.max("edited") | F.max("near") | short, "near").otherwise("exact").alias("kind")
    return marked.groupBy("text_hash", "owner_hash", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), kind, first("owner_id"), first("owner_start"))


def remove_passages(docs: DataFrame, passages: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with repeated passages cut out of every text but their owner's; whole copies lose their text."""
    cuts = passages.where(~F.col("doc_id").eqNullSafe(F.col("owner_id"))).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("__cuts"))
    named = docs.withColumn("__text", F.xxhash64(text_of(text)))
    joined = named.join(cuts, named[key].eqNullSafe(cuts["__id"]) & (named["__text"] == cuts["__hash"]), "left")

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_cut(x, s) for x, s in zip(texts, spans, strict=True)])

    new = F.when(F.col("__cuts").isNotNull(), cut(text_of(text), F.col("__cuts"))).otherwise(F.col(text))
    return joined.withColumn(text, new).select(*docs.columns)


def _cut(text: str, spans: list | None) -> str:
    if spans is None:
        return text
    at = [m.span() for m in WORD.finditer(text.lower() if len(text.lower()) == len(text) else text)]
    out, last = [], 0
    for a, b in sorted((x["start_word"], x["end_word"]) for x in spans):
        if a < len(at):
            lo, hi = at[a][0], at[min(b, len(at)) - 1][1]
            if lo >= last:
                out.append(text[last:lo])
            last = max(last, hi)
    return "".join(out) + text[last:]


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(table(spark, sf_dir, "documents")).drop("text_hash")


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLES: dict[str, str] = {}
