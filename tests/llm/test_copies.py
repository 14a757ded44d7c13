"""Exact copies, SimHash, decontamination and repeated passages against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from wayfarer.llm import common, decontamination, exact_dedup, simhash, substring_dedup

BLANKS = re.compile(r"[\x20\x09-\x0D]")


def words(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("aeiou") + str(rng.randint(0, 400)) for _ in range(n)]


def brute_copies(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[hashlib.sha256(BLANKS.sub("", text or "").encode()).hexdigest()].append((doc, len(text or "")))
    found = []
    for sha, members in groups.items():
        n = max(m[1] for m in members)
        keep = min((d for d, k in members if k == n), key=lambda d: (d is None, d or 0))
        found += [(d, keep, len(members), d == keep and k == n, sha) for d, k in members]
    return Counter(found)


def test_exact_copies(make_docs):
    rng = random.Random(1)
    texts = [" ".join(words(rng, 6)) for _ in range(40)] + ["", " \t", None, "é è", "éè"]
    rows = [(i, (t := rng.choice(texts)) and t.replace(" ", rng.choice([" ", "  ", "\n", "\x0b"]))) for i in range(400)] + [(3, "again"), (3, "again"), (None, "again"), (None, None)]
    found = exact_dedup.find_copies(make_docs(rows), capacity=3).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found) == brute_copies(rows)
    kept = exact_dedup.drop_copies(make_docs(rows))
    assert kept.count() == sum(r.kept for r in found)


def test_chains_of_colliding_hashes(spark, make_docs):
    rng = random.Random(16)
    rows = [(i, rng.choice("abcdefg") * rng.randint(0, 9) + " " * rng.randint(0, 2)) for i in range(300)]
    keys = exact_dedup._keys(make_docs(rows), "text", "doc_id", 3)
    index = exact_dedup.build_index(keys, exact_dedup.directory(keys.select("h").distinct(), 2))
    assert index.count() <= 8 and index.agg(F.max(F.size("chain"))).first()[0] > 1
    found = exact_dedup.find_copies(make_docs(rows), capacity=2, hash_bits=3).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found) == brute_copies(rows)


def test_copies_with_text_keys(spark):
    docs = spark.createDataFrame([("b", "same  text", 1), ("a", "same text", 2), ("c", "sametext ", 3), (None, "else", 4), ("b2", "same text ", 5)], "doc_id string, text string, bucket int")
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.find_copies(docs).collect()}
    assert found == {"b": ("b", 4, True), "a": ("b", 4, False), "c": ("b", 4, False), None: (None, 1, True), "b2": ("b", 4, False)}
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and {r.bucket for r in left.collect()} == {1, 4}


def test_directory_splits_overfull_buckets(spark):
    entries = spark.range(3000).select(F.xxhash64("id").alias("h")).unionByName(spark.range(500).select(F.shiftrightunsigned(F.xxhash64("id"), 9).alias("h")))
    cells = exact_dedup.directory(entries, capacity=100)
    bits = cells.first().bits
    held = Counter()
    where = {r.cell: (r.bucket, r.depth) for r in cells.collect()}
    for r in entries.collect():
        held[where[(r.h % (1 << 64)) >> (64 - bits)]] += 1
    assert all(n <= 100 or depth == bits for (_, depth), n in held.items())
    assert len({d for _, d in held}) > 1  # a dense range is deeper


def brute_print(text, width=3):
    parts = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not parts:
        return 0
    grams = [" ".join(parts[i : i + width]) for i in range(max(1, len(parts) - width + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    """prints: (doc, fingerprint) rows; least doc of each component of fingerprints within 3 bits."""
    fps = sorted({f for _, f in prints})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, f in prints:
        r = find(f)
        least[r] = min(least.get(r, 1 << 60), d)
    return {d: least[find(f)] for d, f in prints}


def test_simhash(make_docs):
    rng = random.Random(2)
    base = [words(rng, rng.choice([0, 1, 2, 3, 30, 200])) for _ in range(30)]
    rows = []
    for i in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            if w:
                w[rng.randrange(len(w))] = "changed"
        rows.append((i, (rng.choice([" ", "\n", "\t "])).join(w).upper() if i % 3 else " ".join(w)))
    found = simhash.find_near(make_docs(rows)).collect()
    assert {r.doc_id: r.fp % (1 << 64) for r in found} == {d: brute_print(t) for d, t in rows}
    assert {r.doc_id: r.component_id for r in found} == brute_components([(d, brute_print(t)) for d, t in rows])
    kept = simhash.drop_near(make_docs(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in found})
    assert kept.columns == make_docs([]).columns


def test_links_cover_all_pairs(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        fps |= {f} | {f ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3, 3, 4)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    found = {frozenset((r.u, r.v)) for r in simhash.links(spark.createDataFrame(signed, "fp long")).collect()}
    want = {frozenset((a, b)) for (a,) in signed for (b,) in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3}
    assert found == want


def test_balls_of_links_are_not_broadcast(spark):
    prints = common.materialize(spark.createDataFrame([(i << 8,) for i in range(300)], "fp long"), "prints")  # of known size, unlike local rows
    found = simhash.links(prints)
    assert {frozenset((r.u >> 8, r.v >> 8)) for r in found.collect()} == {frozenset((a, b)) for a in range(300) for b in range(a) if (a ^ b).bit_count() <= 3}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)]
    stars = {r.node: r.root for r in common.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(stars[i] == 0 for i in range(1, 301)) and all(stars[1000 + i] == 1000 for i in range(1, 50))


def brute_items(docs, items, threshold=0.8):
    def grams(text, k):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, len(w)

    held, seen = {}, {}
    for item, text in sorted(items):
        n = grams(text, 1)[1]
        if n:
            s = frozenset(grams(text, min(5, n))[0])
            seen.setdefault(s, item)
    for d, text in docs:
        for s, item in seen.items():
            k = len(next(iter(s)))
            c = len(s & grams(text, k)[0]) / len(s)
            if c >= threshold - 1e-9:
                held[d, item] = round(c, 9)
    return held


def test_items_in_long_documents(spark, make_docs):
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, rng.choice([1, 3, 6, 14, 40, 60])))) for i in range(25)]
    items += [(100, items[5][1].upper()), (101, None), (102, " .. ")]
    rows = []
    for i in range(120):
        body = words(rng, rng.randint(0, 900))
        for _ in range(rng.choice([0, 1, 2])):
            item = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                if item:
                    item[rng.randrange(len(item))] = "edited"
            at = rng.randint(0, len(body))
            body[at:at] = item
        rows.append((i, " ".join(body)))
    docs = make_docs(rows)
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): round(r.containment, 9) for r in decontamination.find_items(docs, table).collect()}
    want = brute_items(rows, items)
    assert found == want and len(want) > 30
    left = decontamination.drop_contaminated(docs, table)
    assert sorted(r.doc_id for r in left.collect()) == sorted({d for d, _ in rows} - {d for d, _ in want})


def brute_passages(rows, block=50):
    """Word positions of each document in blocks of 50 words that another text has as well."""
    split = {d: re.findall(r"[^\W_]+", (t or "").lower()) for d, t in rows}
    texts, seen = dict(rows), defaultdict(set)
    for d, w in split.items():
        for i in range(len(w) - block + 1):
            seen[tuple(w[i : i + block])].add(texts[d])
    return {d: {k for i in range(len(w) - block + 1) if len(seen[tuple(w[i : i + block])]) > 1 for k in range(i, i + block)} for d, w in split.items()}


def passage_rows(rng):
    shared = [words(rng, n) for n in (50, 51, 60, 120, 300)]
    rows = []
    for i in range(60):
        body = words(rng, rng.randint(0, 300))
        for _ in range(rng.choice([0, 1, 2])):
            at = rng.randint(0, len(body))
            body[at:at] = rng.choice(shared)
        rows.append((i, " ".join(body)))
    return rows


def test_passages(make_docs):
    rows = passage_rows(random.Random(6))
    rows += [(100, rows[3][1] + " tail"), (101, "same line here " * 400), (102, "x " + "same line here " * 300)]
    found = substring_dedup.find_passages(make_docs(rows)).collect()
    got = defaultdict(set)
    for r in found:
        assert r.kind != "copy"
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    want = brute_passages(rows)
    for d, spans in want.items():
        assert spans <= got[d]
        extra = got[d] - spans
        assert not extra or any(r.kind == "near" for r in found if r.doc_id == d)
    assert sum(map(len, want.values())) > 1000


def test_near_passages_and_cuts(make_docs):
    rng = random.Random(7)
    passage = words(rng, 400)
    edited = list(passage)
    edited[200] = "edited"
    rows = [(1, " ".join(passage)), (2, " ".join(words(rng, 80) + edited + words(rng, 80))), (3, " ".join(words(rng, 500))), (4, " ".join(passage))]
    found = substring_dedup.find_passages(make_docs(rows))
    kinds = {(r.doc_id, r.kind): (r.start_word, r.end_word, r.owner_id) for r in found.collect()}
    assert kinds[2, "near"] == (80, 480, 1) and kinds[4, "copy"] == (0, 400, 1)
    assert not any(d == 3 for d, _ in kinds)
    cut = {r.doc_id: r.text for r in substring_dedup.remove_passages(make_docs(rows), found).collect()}
    assert cut[1] == rows[0][1] and cut[3] == rows[2][1] and cut[4].strip() == "" and len(cut[2].split()) == 160


def brute_owners(rows, block=50):
    """(document, first word, owner, owner's first word) of each block that two texts have."""
    seen, split = {}, {d: (t or "").split() for d, t in sorted(rows)}
    held = defaultdict(set)
    for d, w in split.items():
        for i in range(len(w) - block + 1):
            b = tuple(w[i : i + block])
            seen.setdefault(b, (d, i))
            held[b].add(d)
    return {(d, i, *seen[b]) for d, w in split.items() for i in range(len(w) - block + 1) if len(held[b := tuple(w[i : i + block])]) > 1}


def test_owners_of_neighbouring_passages(make_docs):
    rng = random.Random(14)
    p, q = words(rng, 90), words(rng, 110)
    rows = [(i, " ".join(words(rng, 60) + w + words(rng, 60))) for i, w in ((1, p), (5, p + q), (9, p + q), (12, q + p))]
    found = substring_dedup.find_passages(make_docs(rows))
    got = {(r.doc_id, r.start_word + k, r.owner_id, r.owner_start + k) for r in found.collect() for k in range(r.end_word - r.start_word - 49) if r.kind == "exact"}
    assert got == brute_owners(rows)
    cut = {r.doc_id: r.text.split() for r in substring_dedup.remove_passages(make_docs(rows), found).collect()}
    assert set(q) <= set(cut[5]) and not set(q) & set(cut[9]) and set(p) <= set(cut[1]) and not set(p) & set(cut[5])


def test_near_passages_without_long_equal_runs(make_docs):
    rng = random.Random(12)
    passages = [words(rng, 300) for _ in range(8)]
    rows = []
    for i, p in enumerate(passages):
        edited = [f"edit{k}" if k % 45 == 30 else w for k, w in enumerate(p)]
        rows += [(i, " ".join(words(rng, 70) + p + words(rng, 70))), (100 + i, " ".join(words(rng, 90) + edited + words(rng, 90)))]
    found = [r for r in substring_dedup.find_passages(make_docs(rows)).collect() if r.doc_id >= 100]
    assert {r.doc_id for r in found} == {100 + i for i in range(8)}
    for r in found:
        assert (r.kind, r.owner_id) == ("near", r.doc_id - 100) and 90 <= r.start_word < r.end_word <= 390
        assert r.start_word - r.owner_start == 20
    assert sum(r.end_word - r.start_word for r in found) >= 0.6 * 8 * 300


def brute_similar(a, b, block=46):
    return {s for s in range(len(a) - block + 1) if any(len(x & y) >= 0.8 * len(x | y) for x in [set(a[s : s + block])] for y in (set(b[t : t + block]) for t in range(len(b) - block + 1)))}


def test_similar_blocks_of_cells():
    rng = random.Random(13)
    for _ in range(40):
        a = [rng.randrange(1 << 32) for _ in range(60)]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 4)] = [rng.randrange(1 << 32) for _ in range(rng.randint(0, 4))]
        if len(b) < 46:
            continue
        cells = [substring_dedup.Cell(i, 0, 20, b"".join(k.to_bytes(4, "little") for k in x), 46) for i, x in enumerate((a, b))]
        assert set(substring_dedup.similar(*cells, range(15), 0.8)) == brute_similar(a, b)


def near_cells(rng, n):
    """Cells of one key: edits of one passage that are less alike to one another than to it, some with repeated tokens."""
    base, rows = [rng.getrandbits(32) for _ in range(75)], []
    for i in range(n):
        tokens = base[:]
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(70)
            tokens[at : at + 5] = [rng.getrandbits(32) for _ in range(5)]
        if rng.random() < 0.2:
            tokens[:6] = tokens[:1] * 6
        cut, end = rng.randint(0, 10), rng.randint(60, 75)
        rows.append((7, i, cut, 45, b"".join(x.to_bytes(4, "little") for x in tokens[cut:end])))
    return rows


def test_large_keys_compare_few_cells(monkeypatch):
    rows, calls = near_cells(random.Random(21), 400), Counter()
    plain = substring_dedup.similar

    def counted(*args):
        found = plain(*args)
        calls[bool(found)] += 1
        return found

    monkeypatch.setattr(substring_dedup, "similar", counted)
    found = list(substring_dedup.near_runs(rows, 46, 0.8))
    assert calls[True] > 300 and calls[False] < 0.2 * calls[True]
    monkeypatch.setattr(substring_dedup.Heads, "PART", 64)
    assert list(substring_dedup.near_runs(rows, 46, 0.8)) == found
    few = calls[False]
    monkeypatch.setattr(substring_dedup.Heads, "FEW", 1 << 30)  # every representative
    assert list(substring_dedup.near_runs(rows, 46, 0.8)) == found
    assert calls[False] > 20 * few


def test_large_keys_are_compared_in_turns(spark, monkeypatch):
    rows = near_cells(random.Random(22), 150) + [(8, *x[1:]) for x in near_cells(random.Random(23), 60)] + [(9, *x[1:]) for x in near_cells(random.Random(24), 20)]
    held = spark.createDataFrame([(None if i == 3 else i, i, [key], [lo], [first], [tokens]) for key, i, lo, first, tokens in rows], "rep long, text_hash long, keys array<long>, los array<int>, firsts array<int>, tokens array<binary>")
    ordered = sorted(rows, key=lambda x: (x[0], x[1] == 3, x[1]))
    different = sorted({(x[0], x[4]): i for i, x in reversed([*enumerate(ordered)])}.values())
    plain = set(substring_dedup.near_runs([ordered[i] for i in different], 46, 0.8))
    turns, written = [], substring_dedup.materialize

    def noted(df, name):
        found = written(df, name)
        if name in ("turn", "rest"):
            turns.append((name, found.where("cell").count()))
        return found

    monkeypatch.setattr(substring_dedup, "materialize", noted)
    found = substring_dedup._similar_runs(held, 46, 0.8, together=25).collect()
    assert {tuple(x) for x in found} == plain and len(found) == len(plain)
    assert len(turns) >= 7 and max(n for name, n in turns if name == "turn") < 100
    assert {tuple(x) for x in substring_dedup._similar_runs(held, 46, 0.8).collect()} == plain


def test_windows_of_texts_taken_together(monkeypatch):
    rng = random.Random(15)
    texts = [" ".join(words(rng, rng.randint(0, 120))) for _ in range(60)] + ["", "Été_à ÉVRY! ΣΑΣ İx 中文 " * 20, "ab" * 40 + " c " + "d" * 9 + " e" * 70, "same word " * 90]
    calls, digest = [], decontamination.xxhash.xxh64_intdigest
    monkeypatch.setattr(decontamination.xxhash, "xxh64_intdigest", lambda *x: calls.append(x) or digest(*x))
    found = list(substring_dedup.text_windows(texts, 46, 2))
    assert [x[0] for x in found] == [len(decontamination.split(x)) for x in texts]
    for text, (_, keys, spans) in zip(texts, found, strict=True):
        [(_, alone, other)] = substring_dedup.text_windows([text], 46, 2)
        assert (keys == alone).all() and (spans == other).all()
        least = len(decontamination.split(text)) - 4 - 45
        for j in range(2):
            held = [(x >> 30 & (1 << 30) - 1, x & (1 << 30) - 1) for x in spans.tolist() if x >> 60 == j]
            assert [i for lo, hi in held for i in range(lo, hi + 1)] == list(range(least))
    assert len(calls) <= 2 * 2  # only of words over 64 bytes, and not of every word
    together = list(substring_dedup.candidate_blocks(texts, [x[2] for x in found], 46, 2))
    for text, row, (_, _, spans) in zip(texts, together, found, strict=True):
        [alone] = substring_dedup.candidate_blocks([text], [spans], 46, 2)
        assert all(list(x) == list(y) for x, y in zip(row, alone, strict=True))
    a, b = (substring_dedup.word_hashes([x])[1].tolist() for x in ("one TWO drei_çinq ab", "AB çinq drei two One"))
    assert a == b[::-1]


def test_odd_rows(spark, odd_docs, no_docs):
    n = odd_docs.count()
    copies = exact_dedup.find_copies(odd_docs).collect()
    assert len(copies) == n
    assert exact_dedup.drop_copies(odd_docs).columns == odd_docs.columns
    near = simhash.find_near(odd_docs).collect()
    assert len(near) == n
    assert {r.fp for r in near if r.doc_id in (3, 4, 5)} == {0}
    assert len({r.component_id for r in near if r.doc_id in (3, 4, 5)}) == 1
    kept = simhash.drop_near(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len({r.root for r in near})
    items = spark.createDataFrame([(1, "two three four five six seven eight"), (None, "alpha beta gamma delta epsilon"), (2, None)], "item_id long, text string")
    assert {r.doc_id for r in decontamination.find_items(odd_docs, items).collect()} == {1, 2, 10, None}
    assert decontamination.drop_contaminated(odd_docs, items).columns == odd_docs.columns
    assert decontamination.drop_contaminated(odd_docs, items.limit(0)).count() == n
    spans = substring_dedup.find_passages(odd_docs)
    assert {r.doc_id for r in spans.collect()} == {6}
    assert substring_dedup.remove_passages(odd_docs, spans).count() == n
    for f in (exact_dedup.find_copies, simhash.find_near, simhash.drop_near, substring_dedup.find_passages):
        assert not f(no_docs).collect()
    assert not decontamination.find_items(no_docs, items).collect()


def test_items_and_documents_with_text_keys(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([("d1", f"so {item} end"), (None, item), ("d2", "nothing here at all to find"), ("9007199254740993", item)], "doc_id string, text string")
    items = spark.createDataFrame([("b", item), ("a", item), (None, "other words that are in no document of these")], "item_id string, text string")
    found = decontamination.find_items(docs, items)
    assert sorted(((r.doc_id, r.item_id) for r in found.collect()), key=repr) == [("9007199254740993", "a"), ("d1", "a"), (None, "a")]
    assert [r.doc_id for r in decontamination.drop_contaminated(docs, items).collect()] == ["d2"]
    # Large numbers next to nulls stay as they are.
    numbers = docs.withColumn("doc_id", F.when(F.col("doc_id").startswith("9"), F.col("doc_id").try_cast("long")))
    assert {r.doc_id for r in decontamination.find_items(numbers, items).collect()} == {9007199254740993, None}
