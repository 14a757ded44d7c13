"""Phrases, byte-level BPE and the filter audit against brute force."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfarer.llm import byte_bpe, filter_audit, phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(docs):
    """Per language: counts of words and of phrases of two and three."""
    found = defaultdict(Counter)
    for _, text, lang in docs:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            words = re.findall(r"[^ \t]+", piece)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    found[lang if lang is not None else "und"][tuple(words[i : i + k])] += 1
    return found


def collocations(docs, least=10, top=2000):
    out = []
    for lang, f in counted(docs).items():
        total, best = sum(n for w, n in f.items() if len(w) == 1), []
        candidates = {w: n for w, n in f.items() if len(w) > 1 and n >= least}
        longer = defaultdict(int)
        for w, n in candidates.items():
            for i in range(len(w) - 1):
                longer[w[i : i + 2]] = max(longer[w[i : i + 2]], n * (len(w) > 2))
        for w, a in candidates.items():
            score, _, left, right = min((1_000_000 * a * a // (f[w[:k]] * f[w[k:]]), k, f[w[:k]], f[w[k:]]) for k in range(1, len(w)))
            if len(w) > 2 or 100 * longer[w] < 50 * a:
                best.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, total, -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def words_of(rng, n):
    """Text of few words, with pieces, tabs and repeated blanks."""
    vocabulary = ["the", "The", "a", "été", "New", "York", "x\x1fy", "語", "z" * 70, "of"]
    return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for _ in range(n))


@pytest.mark.parametrize(("seed", "positions", "least"), [(1, 1 << 21, 10), (2, 64, 3), (3, 7, 2), (4, 1000, 5)])
def test_phrases_equal_brute_force(make_docs, monkeypatch, seed, positions, least):
    monkeypatch.setattr(phrases, "ENTRIES", 32)
    rng = random.Random(seed)
    docs = [(i, rng.choice([words_of(rng, rng.randint(0, 60)), None, "", " \t "]), rng.choice(["en", "fr", None, "und"])) for i in range(60)]
    docs += [(99, " ".join(rng.choice("abc") for _ in range(900)), "en")] * 2  # one long piece, twice
    found = phrases.collocations(make_docs([(i, t, None, lang) for i, t, lang in docs]).repartition(3), least=least, positions=positions)
    assert sorted(tuple(r) for r in found.collect()) == collocations(docs, least)


def test_phrases_are_cut_after_the_first(make_docs):
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{rng.randint(0, 12)}" for _ in range(80)), "en") for i in range(40)]
    found = phrases.collocations(make_docs([(i, t, None, lang) for i, t, lang in docs]), least=2, top=25)
    assert sorted(tuple(r) for r in found.collect()) == collocations(docs, 2, 25)


def test_phrases_of_odd_documents(odd_docs, no_docs):
    rows = [(r.doc_id, r.text, r.lang) for r in odd_docs.collect()]
    assert sorted(tuple(r) for r in phrases.collocations(odd_docs).collect()) == collocations(rows)
    assert phrases.collocations(no_docs).count() == 0


def test_bitmaps_shift_over_blocks():
    ids = np.array([0, 1, 0, 1, -1, 0, 1, 2] * 9)
    maps = phrases.Bitmaps(ids)
    phrase, word, _, bits = maps.extend(maps.word, maps.block, maps.bits)
    pairs = Counter()
    for p, w, b in zip(phrase.tolist(), word.tolist(), bits.tolist(), strict=True):
        pairs[p, w] += b.bit_count()
    want = Counter((a, b) for a, b in zip(ids.tolist(), ids.tolist()[1:], strict=False) if min(a, b) >= 0)
    assert pairs == want


# Byte-level BPE.


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(byte_bpe.public_tokenizers.path(byte_bpe.VOCABULARY))


@pytest.fixture(scope="module")
def reference(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=byte_bpe.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_equal_another_implementation(ranks, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK", 48)
    monkeypatch.setattr(byte_bpe, "MOST_PIECES", 50)
    monkeypatch.setattr(byte_bpe, "MOST_PAIRS", 500)
    pieces, cut, rng = byte_bpe.Pieces(byte_bpe.Transducer(ranks)), byte_bpe.regex.compile(byte_bpe.public_tokenizers.PATTERN).findall, random.Random(1)
    given = ["".join(rng.choice("aàbéß 1٣\n\t\x1c  x'sS!語漢字😀éabc ") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    given += ["".join(rng.choice("abcdeionrst") for _ in range(rng.randint(1, 400))) for _ in range(300)]
    given += ["a" * 5000, "ab" * 3000, " " * 3000 + "x", "\n" * 999, "é" * 2000, "😀" * 700, "<|endoftext|>", "the" * 3000]
    for text in given:
        assert np.frombuffer(b"".join(pieces[p] for p in cut(text)), np.int32).tolist() == reference.encode_ordinary(text), text[:80]


def test_a_small_vocabulary_whose_tokens_merges_miss():
    ranks = {bytes((b,)): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"abcd": 260, b"aa": 261, b"aaaa": 262, b"xyz": 263}
    machine = byte_bpe.Transducer(ranks)
    assert machine.encode(b"xyz") == [263] and machine.encode(b"xyzx") == [*b"xyzx"]  # a piece may be a token that merges don't lead to, a part of one isn't
    rng = random.Random(2)
    for _ in range(2000):
        piece = bytes(rng.choice(b"aabcdxyz") for _ in range(rng.randint(1, 12)))
        assert machine.encode(piece) == ([ranks[piece]] if piece in ranks else [ranks[p] for p in byte_bpe.merge(ranks, piece)])


def test_decoding_ill_formed_bytes(ranks):
    tokens, whole, rng = {r: t for t, r in ranks.items()}, byte_bpe.whole_tokens(ranks), random.Random(3)
    single = [ranks[bytes((b,))] for b in range(256)]
    for _ in range(3000):
        ids = [rng.choice(single) if rng.random() < 0.7 else rng.randrange(len(ranks)) for _ in range(rng.randint(0, 20))]
        assert byte_bpe.decode_ids(ids, tokens, whole) == b"".join(tokens[i] for i in ids).decode("utf-8", "replace")
    for text in ("�", "a�b", "퟿\U0010ffff"):
        assert byte_bpe.decode_ids([ranks[bytes((b,))] for b in text.encode()], tokens, whole) == text


def test_texts_come_back(odd_docs, no_docs, reference, monkeypatch, tmp_path):
    monkeypatch.setattr(byte_bpe, "ROWS", 3)
    path = byte_bpe.public_tokenizers.path(byte_bpe.VOCABULARY)
    docs = odd_docs.withColumn("ids", F.lit("x"))  # a column of that name is replaced
    found = byte_bpe.decode(byte_bpe.encode(docs, path).withColumnRenamed("text", "was"), path)
    assert set(found.columns) == {*docs.columns, "was"}
    rows = found.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.text == (r.was or "") and r.ids == reference.encode_ordinary(r.was or "") and r.key == "x"
    assert byte_bpe.encode(no_docs, path).count() == 0
    none = odd_docs.select("doc_id", F.lit(None).cast("array<int>").alias("ids")).limit(3)
    assert {r.text for r in byte_bpe.decode(none, path).collect()} == {""}
    (tmp_path / "ranks").write_text("YWI= 0\n")
    with pytest.raises(ValueError, match="single bytes"):
        byte_bpe.read_ranks(str(tmp_path / "ranks"))


# The filter audit.


def audited(docs, labels):
    """Part, order and step, each document walked through every order."""
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    rows = []
    for doc, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^ \t-\r]+", text)
        fails = {f for f, x in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in docs)), strict=True) if x}
        rows.append((lang or "", fails, doc in good, doc in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            gone = []
            for i, f in enumerate(order, 1):
                here = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[part, f] += len(here)
                unique = sum(r[0] == part and r[1] == {f} for r in rows)
                out[part, "".join(order), i] = (len(left), len(here), sum(f in r[1] for r in gone), unique, sum(r[2] for r in here), sum(r[3] for r in here))
                gone += here
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def audit(docs, labels):
    found = filter_audit.audit(filter_audit.failures(docs, labels))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(tuple(r) for r in found.collect())


def test_audit_equals_brute_force(make_docs, spark):
    rng = random.Random(1)
    texts = []
    for _ in range(40):
        n = rng.choice([0, 50, 99, 100, 101, 150])
        words = [f"w{rng.randint(0, rng.choice([60, 5000]))}" for _ in range(n)]
        words = [w.upper() + "ABCDEFGH" if rng.random() < rng.choice([0, 0, 0.6]) else w for w in words]
        texts.append(rng.choice([" ", "\n", "\t \x0b"]).join(words) + rng.choice(["", "", " 100%", "|"]))
    docs = [(rng.choice([i, i, None]), rng.choice([texts[i % 40], rng.choice(texts), None]), rng.choice(["en", "fr", None, ""])) for i in range(90)]
    docs += docs[:5]  # repeated rows
    labels = [(rng.randint(0, 99), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(80)] + [(None, 1, 1)]
    made = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audit(make_docs([(i, t, None, lang) for i, t, lang in docs]), made) == audited(docs, labels)


def test_audit_of_odd_documents(odd_docs, no_docs, spark):
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None)]
    made = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.lang) for r in odd_docs.collect()]
    assert audit(odd_docs, made) == audited(rows, labels)
    assert audit(odd_docs, made.limit(0)) == audited(rows, [])
    assert audit(no_docs, made) == []
