"""Byte-level BPE as a transducer, and the way back through a UTF-8 state machine.

Encoding. A pattern cuts a text into pieces; a piece is encoded by itself. A sequence of tokens is the encoding of its bytes if each two
neighbours are: no merge across the border between them comes before the merges that make them. So each beginning of a piece has one encoding, which is that of a shorter
beginning and one token more. A nondeterministic machine that begins a token at any byte finds the tokens that end at each place; it is determinised
as texts need it: a state is the set of the open nodes of the vocabulary's trie (the longest one and its suffixes), states and moves are kept when first met. Of the
tokens that end at a place the transducer takes the one that stays apart from the last token before it. Tokens are put out when all encodings that are still
open agree on them, which lags behind by some lengths of the longest token, however long the piece.

Decoding. Tokens' bytes go through an automaton for well-formed UTF-8 that keeps at most three bytes of an unfinished character between tokens; ill-formed
bytes become U+FFFD, one for each longest prefix of a character.

Null texts are empty and have no tokens; rows with one key, ties and other columns pass through, whatever their names; a null list of ids decodes to the empty text.
Special tokens have no meaning. The vocabulary's file is read by the driver and broadcast; it may have MOST_RANKS lines at most.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
MOST_RANKS = 1 << 20
#: Pairs of tokens and pieces that a task's process remembers.
MOST_PAIRS, MOST_PIECES = 1 << 18, 1 << 18
#: Rows that are worked on at once.
ROWS = 512
#: Bytes of a piece after which what is agreed on is put out.
CHUNK = 4096
NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    if len(ranks) > MOST_RANKS:
        raise ValueError(f"a vocabulary has {MOST_RANKS} tokens at most")
    if any(bytes((byte,)) not in ranks for byte in range(256)):
        raise ValueError("a vocabulary has all single bytes")
    return ranks


def merge(ranks: dict[bytes, int], piece: bytes, below: int = NEVER) -> list[bytes]:
    """piece after all merges of rank less than below, least rank first, of equal ones the leftmost."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Transducer:
    """The merges of a vocabulary, determinised as texts need it.

    Nodes of the trie have numbers, 0 is its root. A state is named by its longest open node: moves lead from there by a byte to the next state, ending has the tokens
    that end there, the longest first.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.spines: dict[tuple[int, bool], list[int]] = {}
        self.neighbours: dict[int, bool] = {}
        self.trie: dict[int, int] = {}
        self.spells: list[int | None] = [None]
        self.above = [0]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                after = self.trie.get(node << 8 | byte)
                if after is None:
                    after = self.trie[node << 8 | byte] = len(self.spells)
                    self.spells.append(None)
                    self.above.append(node << 8 | byte)
                node = after
            self.spells[node] = rank
        self.moves: dict[int, int] = {}
        self.ending: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.spells)
        self.suffixes: list[int | None] = [0, *[None] * (len(self.spells) - 1)]

    def spine(self, token: int, right: bool) -> list[int]:
        """The tokens at the left (or right) end of token while it is merged, from its first (last) byte to itself, and NEVER; only that if merges don't lead to it."""
        key = (token, right)
        found = self.spines.get(key)
        if found is None:
            text, found = self.tokens[token], [token]
            while len(text) > 1:
                parts = merge(self.ranks, text, self.ranks[text])
                if len(parts) != 2:
                    found = []
                    break
                text = parts[1] if right else parts[0]
                found.append(self.ranks[text])
            found = self.spines[key] = [*found[::-1], NEVER]
        return found

    def adjacent(self, left: int, right: int) -> bool:
        """Whether left and right stay apart: at no time does a merge across their border come before the next merge on either side of it. Remembered."""
        if len(self.neighbours) >= MOST_PAIRS:
            self.neighbours.clear()
        found = self.neighbours[left << 20 | right] = self._stay_apart(self.spine(left, True), self.spine(right, False))
        return found

    def _stay_apart(self, a: list[int], b: list[int]) -> bool:
        tokens, rank_of = self.tokens, self.ranks.get
        i = j = 0
        while True:
            next_a, next_b = a[i + 1], b[j + 1]
            across = rank_of(tokens[a[i]] + tokens[b[j]], NEVER)
            if across < next_a and across <= next_b:  # of equal ranks the leftmost merge comes first
                return False
            if next_a <= next_b:
                if next_a == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def suffix(self, node: int) -> int:
        """The longest open node of a state but its first."""
        found = self.suffixes[node]
        if found is None:
            above, byte = self.above[node] >> 8, self.above[node] & 255
            found = self.suffixes[node] = self.move(self.suffix(above), byte) if above else 0
        return found

    def move(self, node: int, byte: int) -> int:
        """The state after byte."""
        key = node << 8 | byte
        found = self.moves.get(key)
        if found is None:
            found = self.trie.get(key)
            if found is None:
                found = self.move(self.suffix(node), byte)
            self.moves[key] = found
        return found

    def ends(self, node: int) -> tuple[tuple[int, int], ...]:
        """The tokens that end in a state, the longest first, and their lengths; those that merges don't lead to are none."""
        found = self.ending[node]
        if found is None:
            token = self.spells[node]
            own = ((token, self.lengths[token]),) if token is not None and len(self.spine(token, True)) > 1 else ()
            found = self.ending[node] = own + (self.ends(self.suffix(node)) if node else ())
        return found

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of a piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        known, ending, apart = self.moves.get, self.ending, self.neighbours.get
        out: list[int] = []
        last, at, node = [-1], 0, 0  # last[i] is the last token up to byte i; the first one may be any
        for byte in piece:
            at += 1
            after = known(node << 8 | byte)
            node = self.move(node, byte) if after is None else after
            for token, length in ending[node] or self.ends(node):
                left = last[at - length]
                if left < 0:
                    break
                fits = apart(left << 20 | token)
                if self.adjacent(left, token) if fits is None else fits:
                    break
            last.append(token)
            if not at % CHUNK:
                last, at = self._put_out(last, node, out)
        return out + self._path(last, at)

    def _path(self, last: list[int], at: int) -> list[int]:
        """The tokens up to byte at, but for one before the first byte of last."""
        found = []
        while at > 0:
            found.append(last[at])
            at -= self.lengths[last[at]]
        return found[::-1]

    def _put_out(self, last: list[int], node: int, out: list[int]) -> tuple[list[int], int]:
        """Put out what all places where a token may still begin agree on; what is left of last begins after that."""
        depth = 0
        while node:
            node, depth = self.above[node] >> 8, depth + 1
        open_at = range(len(last) - 1 - depth, len(last))
        borders = None
        for at in open_at:
            met = set()
            while at > 0:
                met.add(at)
                at -= self.lengths[last[at]]
            borders = met if borders is None else borders & met
        agreed = max(borders, default=0)
        out += self._path(last, agreed)
        return last[agreed:], len(last) - 1 - agreed


class Pieces(dict):
    """Pieces of text and their tokens, four bytes each. When MOST_PIECES are held those that weren't met since the last time go."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer, self.older = transducer, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = np.array(self.transducer.encode(piece.encode()), np.int32).tobytes()
        if len(self) >= MOST_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found


class Utf8:
    """Well-formed UTF-8, byte by byte: how many bytes a character still lacks and between which bounds the next one lies."""

    def __init__(self):
        self.held, self.lacks, self.low, self.high = b"", 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        """The characters that data finishes."""
        if not self.lacks and data.isascii():
            return data.decode("ascii")
        found = []
        for byte in data:
            if self.lacks:
                if self.low <= byte <= self.high:
                    self.held += bytes((byte,))
                    self.lacks, self.low, self.high = self.lacks - 1, 0x80, 0xBF
                    if not self.lacks:
                        found.append(self.held.decode())
                        self.held = b""
                    continue
                found.append(self.end())
            if byte < 0x80:
                found.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                self.held = bytes((byte,))
                self.lacks = 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)  # no overlong forms
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)  # no surrogates, nothing beyond U+10FFFF
            else:
                found.append("�")
        return "".join(found)

    def end(self) -> str:
        """What an unfinished character becomes."""
        rest = "�" if self.lacks else ""
        self.held, self.lacks, self.low, self.high = b"", 0, 0x80, 0xBF
        return rest


def whole_tokens(ranks: dict[bytes, int]) -> dict[int, str]:
    """The tokens that begin and end with characters, as text: between two of them the automaton is in its first state."""
    found = {}
    for token, rank in ranks.items():
        machine = Utf8()
        text = machine.feed(token)
        if not machine.lacks and "�" not in text:
            found[rank] = text
    return found


def decode_ids(ids: list[int], tokens: dict[int, bytes], whole: dict[int, str]) -> str:
    """The text of ids, token by token."""
    machine, found = Utf8(), []
    for i in ids:
        text = whole.get(i) if not machine.lacks else None
        found.append(machine.feed(tokens[i]) if text is None else text)
    return "".join(found) + machine.end()


_made: dict[tuple[str, str], object] = {}


def _once(kind: str, ranks: bytes, make: Callable[[dict[bytes, int]], object]) -> object:
    """What a process has made of a vocabulary; processes serve many tasks."""
    key = (kind, hashlib.sha256(ranks).hexdigest())
    if key not in _made:
        _made[key] = make({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())})
    return _made[key]


def _broadcast(spark: SparkSession, path: str):
    ranks = read_ranks(path)
    return spark.sparkContext.broadcast(b"\n".join(base64.b64encode(token) + b" %d" % rank for token, rank in ranks.items()))


@contextmanager
def _uncollected() -> Iterator[None]:
    """What a task keeps has no cycles: the collector would walk through it again and again for nothing."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _added(rows: DataFrame, column: str, kind: T.DataType, made: Callable[[pa.RecordBatch], pa.Array], without: str | None = None) -> DataFrame:
    """rows with a column that made gives for a few rows at a time, less the column without."""
    rows = rows.drop(column)
    kept = [i for i, c in enumerate(rows.columns) if c != without]
    schema = T.StructType([*[rows.schema.fields[i] for i in kept], T.StructField(column, kind)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in kept], made(part)], schema.names)

    return rows.mapInArrow(each, schema)


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """docs with ids, the tokens of each text (an array of int), in the place of a column of that name; without the text if it isn't kept."""
    ranks, at = _broadcast(docs.sparkSession, path), docs.drop(ids).columns.index(text)

    def made(part: pa.RecordBatch) -> pa.Array:
        pieces = _once("pieces", ranks.value, lambda found: Pieces(Transducer(found)))
        cut, tokens_of, flat, ends = regex.compile(pattern).findall, pieces.__getitem__, bytearray(), [0]
        with _uncollected():
            for body in part.column(at):
                flat += b"".join(map(tokens_of, cut(body.as_py() or "")))
                ends.append(len(flat) // 4)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))

    return _added(docs, ids, T.ArrayType(T.IntegerType()), made, None if keep_text else text)


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with text, what ids spell, in the place of a column of that name."""
    ranks, at = _broadcast(rows.sparkSession, path), rows.drop(text).columns.index(ids)

    def made(part: pa.RecordBatch) -> pa.Array:
        tokens, whole = _once("tokens", ranks.value, lambda found: ({rank: token for token, rank in found.items()}, whole_tokens(found)))
        lists = part.column(at)
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy().tolist()
        spans = zip(ends[:-1], ends[1:], lists.is_null().to_pylist(), strict=True)
        return pa.array([decode_ids([] if null else flat[i:j].tolist(), tokens, whole) for i, j, null in spans], pa.string())

    return _added(rows, text, T.StringType(), made)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, keep_text=False)
    decoded = decode(encoded, path)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("text")).alias("decoded_sha256"))


#: Merges can't be expressed in SQL; tests hold the query against another implementation.
QUERIES = {"op12_byte_bpe": op12_byte_bpe}
ORACLES: dict[str, str] = {}
