"""Mixing and sharding against plain Python."""

import math
import random
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from wayfarer.llm import mixing, sharding


def water_fill(sizes):
    """Targets by repeated resharing of what exceeds three times a source."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / whole > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / whole for s in free}
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_and_taken(make_docs):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 80)), rng.choice(["a", "b", "b", "b", "c", "d", "z", None])) for i in range(900)]
    rows += [(1000 + i, "tiny", "tiny") for i in range(3)]
    found = mixing.digest(make_docs(rows)).collect()
    assert len(found) == len(rows)
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
        assert r.size == 0 or (r.taken % r.size == 0 and r.taken <= 3 * r.size)
    want = water_fill(sizes)
    for r in found:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9) and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6 for s in sizes)
    again = mixing.digest(make_docs(rows).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in found)


def test_cells_narrow_down(make_docs, monkeypatch):
    rows = [(i, "w " * (i % 40 + 1), "ab"[i % 2]) for i in range(600)]
    want = sorted((r.doc_id, r.taken) for r in mixing.digest(make_docs(rows)).collect())
    monkeypatch.setattr(mixing, "PER_CELL", 4)
    assert sorted((r.doc_id, r.taken) for r in mixing.digest(make_docs(rows)).collect()) == want


def test_mix_repeats_rows(make_docs):
    docs = make_docs([(i, "w " * 10, "a" if i % 10 else "b") for i in range(200)])
    times = {r.doc_id: r.taken // r.size for r in mixing.digest(docs).collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in times.items() if v})


@pytest.mark.parametrize("per_cell", [1, 5, 100_000])
def test_documents_of_size_0_are_treated_alike(make_docs, monkeypatch, per_cell):
    """A source without words, one at its limit with empty texts among its own, and one with a rest; cells sorted whole or narrowed down."""
    monkeypatch.setattr(mixing, "PER_CELL", per_cell)
    rows = [(i, "", "empty") for i in range(40)] + [(100 + i, "" if i % 2 else "a b", "few") for i in range(40)] + [(200 + i, "" if i % 3 == 0 else "w " * (i + 1), "many") for i in range(60)]
    docs = make_docs(rows)
    times = Counter(r.doc_id for r in mixing.mix(docs).collect())
    taken = {r.doc_id: r for r in mixing.digest(docs).collect()}
    assert not any(times[i] for i in range(40))
    assert {times[100 + i] for i in range(40)} == {mixing.MOST_EPOCHS}  # the source is at its limit: three epochs and nothing more
    assert all(times[i] <= mixing.MOST_EPOCHS and times[i] * r.size == r.taken for i, r in taken.items())
    monkeypatch.setattr(mixing, "PER_CELL", 7)
    assert times == Counter(r.doc_id for r in mixing.mix(docs).collect())


def test_better_documents_come_first(make_docs):
    rows = [(i, "good words here " * 5 if i % 2 else "!!! ### 123 %%% *** " * 4, "a") for i in range(600)] + [(9000 + i, "x " * 15, "b") for i in range(600)] + [(19000 + i, "x " * 15, "c") for i in range(600)]
    taken = {r.doc_id: r.taken > 0 for r in mixing.digest(make_docs(rows)).collect()}
    assert sum(taken[i] for i in range(1, 600, 2)) > 1.3 * sum(taken[i] for i in range(0, 600, 2))


@pytest.mark.parametrize("total", [0, 1, 2, 3, 5, 7, 16, 17, 100, 1000])
def test_positions_are_a_permutation(spark, total):
    rows = spark.range(total).select(sharding.place(F.col("id"), total).alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(total))


def check_law(rows, n):
    counts = Counter(r.shard for r in rows)
    assert len(rows) == n
    assert max(counts.values(), default=0) - min((counts[s] for s in range(16)), default=0) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_shards(make_docs):
    rows = [(i, f"text {i}") for i in range(500)] + [(9999, "same")] * 50
    found = sharding.digest(make_docs(rows)).collect()
    check_law(found, 550)
    assert {r.law for r in found} == {"rows"} and {r.grown_shard for r in found} == {None}
    again = sharding.digest(make_docs(rows).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_many_equal_rows_are_dealt_over_tasks(make_docs):
    rows = [(i, f"text {i}") for i in range(300)] + [(9999, "same")] * 200
    found = sharding.assign_shards(make_docs(rows), heavy=20, per_part=32)
    check_law(found.collect(), 500)
    again = sharding.assign_shards(make_docs(rows).repartition(6), heavy=20, per_part=32)
    key = lambda df: sorted((r.doc_id, r.shard, r.slot) for r in df.collect())
    assert key(found) == key(again)


def test_rows_alike_in_key_and_text_have_places_of_their_own(make_docs):
    rows = [(i, f"text {i}") for i in range(100)] + [(9999, "same", f"s{i % 90}" if i % 91 else None) for i in range(180)] + [(9999, None, None, "x")] * 30 + [(9999, "", "x", None)] * 30
    found = sharding.assign_shards(make_docs(rows), heavy=20, per_part=32)
    check_law(found.collect(), 340)
    again = sharding.assign_shards(make_docs(rows[::-1]).repartition(7), heavy=20, per_part=32)
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(found) == key(again)


def chained(*parts):
    """XXH64 over values in turn, each one's hash the seed of the next: strings, longs ("q") and ints ("i")."""
    seed = 42
    for kind, value in parts:
        seed = xxhash.xxh64_intdigest(value if kind == "s" else struct.pack("<" + kind, value), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_places_are_recomputed(make_docs):
    rows = [(i, f"text {i % 50}") for i in range(300)]
    found = {r.doc_id: (r.shard, r.slot) for r in sharding.digest(make_docs(rows)).collect()}
    order = []
    for doc, text in rows:
        t, crc = chained(("s", text.encode())), zlib.crc32(text.encode())
        u = chained(("i", sharding.SEED), *[x for v in (len(text) + 1, crc, t) for x in (("i", 0), ("q", v))])
        order.append((chained(("q", doc), ("q", t), ("q", u)), doc))
    n, a = len(rows), 18  # 17 * 17 < 300 <= 18 * 18
    b = -(-n // a)

    def turned(x):
        left, right = divmod(x, b)
        for i in range(sharding.ROUNDS):
            other = right if i % 2 == 0 else left
            moved = chained(("i", sharding.SEED), ("i", i), ("q", other))
            left, right = ((left + moved) % a, right) if i % 2 == 0 else (left, (right + moved) % b)
        return left * b + right

    for number, (_, doc) in enumerate(sorted(order)):
        at = turned(number)
        while at >= n:
            at = turned(at)
        assert found[doc] == (at % 16, at // 16)


def test_written_shards(make_docs, tmp_path):
    back = sharding.write_shards(make_docs([(i, f"t{i}") for i in range(64)], extra=False), str(tmp_path / "out"))
    check_law(back.collect(), 64)


def test_odd_rows(odd_docs, no_docs):
    n = odd_docs.count()
    check_law(sharding.assign_shards(odd_docs).collect(), n)
    assert set(sharding.assign_shards(odd_docs).columns) == set(odd_docs.columns) | {"slot"}
    rows = sharding.digest(odd_docs).collect()
    check_law(rows, n)
    assert all(r.size == 1 and r.text_crc32 == 0 for r in rows if r.doc_id == 3)
    assert len(mixing.digest(odd_docs).collect()) == n
    assert mixing.mix(odd_docs).columns == odd_docs.columns
    assert not mixing.digest(no_docs).collect() and not mixing.mix(no_docs).collect() and not sharding.digest(no_docs).collect()
