"""Identity in order of requests, in batch and on streams, against the rules applied one request at a time."""

import random
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from wayfarer.operators import identity, replay
from wayfarer.streaming import hooks
from wayfarer.streaming import sessions as streams

from .conftest import T0
from .test_analytics import event, visitor

SIGNALS = ("person_external_id", "ga_id", "person_email", "fingerprint", "anonymous_id", "click_id")
REQUESTS = "request_id string, workspace_id string, at timestamp, " + ", ".join(f"{s} string" for s in SIGNALS)


def made_requests(seed, n):
    rng, found = random.Random(seed), []
    for i in range(n):
        given = {s: (f"{s[:2]}{rng.randint(0, 12)}" if rng.random() < p else None) for s, p in zip(SIGNALS, (0.05, 0.15, 0.05, 0.5, 0.4, 0.2), strict=True)}
        found.append((f"r{i:04}", rng.choice(["w1", "w1", "w2"]), T0 + timedelta(seconds=rng.randint(0, n // 2)), *[given[s] for s in SIGNALS]))
    return found


def one_by_one(requests, visitors):
    """(actions, visitors) with plain lists."""
    held = [dict(v) for v in visitors]
    add = lambda values, x: values if x is None else [x] + [v for v in values if v != x]
    actions = {}
    for number, workspace, at, *given in sorted(requests, key=lambda r: (r[2], r[0])):
        signals = {k: v for k, v in zip(SIGNALS, given, strict=True) if v is not None}
        hits = lambda v: any((v[k] == x) if k in v else (x in v[replay.MANY[k]]) for k, x in signals.items())  # noqa: B023, E731
        found = sorted((v for v in held if v["workspace_id"] == workspace and v["status"] != "merged" and hits(v)), key=lambda v: (v["first_seen_at"], v["id"]))
        if not found:
            v = {"id": replay.created_id(number), "workspace_id": workspace, "person_external_id": None, "person_email": None, "ga_id": signals.get("ga_id"), "first_seen_at": at, "status": "anonymous", "merged_into_id": None}
            v |= {c: [signals[k]] if k in signals else [] for k, c in replay.MANY.items()}
            held.append(v)
            actions[number] = ("create", v["id"], [])
            continue
        first, rest = found[0], found[1:]
        may = any(k in signals for k in identity.STRONG) or sum(k in signals for k in identity.WEAK) >= 2
        for v in rest if may else []:
            for c in replay.MANY.values():
                first[c] = first[c] + [x for x in v[c] if x not in first[c]]
            v["status"], v["merged_into_id"] = "merged", first["id"]
        for k, c in replay.MANY.items():
            first[c] = add(first[c], signals.get(k))
        first["ga_id"] = signals.get("ga_id") or first["ga_id"]
        actions[number] = ("merge" if rest and may else "update", first["id"], [v["id"] for v in rest] if may else [])
    return actions, {v["id"]: v for v in held}


def start():
    """Visitors that exist, some with signals in common, one merged."""
    rows = [visitor("a", workspace_id="w1", first_seen_at=-9, person_email="pe1", fingerprints=["fi1", "fi2"], anonymous_ids=["an1"]), visitor("b", workspace_id="w1", first_seen_at=-8, ga_id="ga2", fingerprints=["fi2"], click_ids=["cl3"]), visitor("c", workspace_id="w2", first_seen_at=-7, person_external_id="pe3"), visitor("d", workspace_id="w1", first_seen_at=-9, fingerprints=["fi3"], status="merged", merged_into_id="a"), visitor("e", workspace_id="w1", first_seen_at=-6, anonymous_ids=["never asked for"])]
    plain = []
    for r in rows:
        v = {"id": r["id"], "workspace_id": r["workspace_id"], "first_seen_at": T0 + timedelta(minutes=r["first_seen_at"]), "status": r["status"], "merged_into_id": r.get("merged_into_id")}
        plain.append(v | {k: r.get(k) for k in replay.ONE} | {c: r.get(c) or [] for c in replay.MANY.values()})
    return rows, plain


def compare(actions, held, found):
    want, visitors = found
    assert {r.request_id: (r.action, r.visitor_id, r.merged_ids) for r in actions} == want
    for r in held:
        v = visitors[r.id]
        assert (r.status, r.merged_into_id) == (v["status"], v["merged_into_id"])
        if r.status != "merged":
            assert (r.ga_id, r.fingerprints, r.anonymous_ids, r.click_ids) == (v["ga_id"], v["fingerprints"], v["anonymous_ids"], v["click_ids"])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replayed_requests_equal_one_at_a_time(spark, make, seed):
    rows, plain = start()
    given = made_requests(seed, 150)
    actions, changed = replay.replay(spark.createDataFrame(given, REQUESTS), make("visitors", rows))
    held = changed.collect()
    found = one_by_one(given, plain)
    compare(actions.collect(), held, found)
    touched = {v for a in found[0].values() for v in (a[1], *a[2])}
    assert {r.id for r in held} == touched and "e" not in touched


def test_one_request_at_a_time_equals_resolve(spark, make):
    rows, _ = start()
    visitors = make("visitors", rows)
    given = [r for r in made_requests(5, 40)]
    asked = spark.createDataFrame(given, REQUESTS)
    want = {r.request_id: (r.action, r.visitor_id, r.merged_ids) for r in identity.resolve(asked, visitors).collect()}
    for number in ("r0001", "r0007", "r0020"):
        actions, _ = replay.replay(asked.where(F.col("request_id") == number), visitors)
        one = actions.first()
        action, who, merged = want[number]
        assert (one.action, one.merged_ids) == (action, merged) and one.visitor_id == (who or replay.created_id(number))


def test_the_order_of_weak_signals_decides(spark, make):
    ask = lambda *rows: spark.createDataFrame([(n, "w", T0 + timedelta(seconds=t), None, None, None, f, a, None) for n, t, f, a in rows], REQUESTS)
    none = make("visitors", [])
    both = [("1", 0, "f", None), ("2", 1, None, "a"), ("3", 2, "f", "a"), ("4", 3, None, "a")]
    actions, _ = replay.replay(ask(*both), none)
    assert [(r.request_id, r.action) for r in actions.orderBy("request_id").collect()] == [("1", "create"), ("2", "create"), ("3", "merge"), ("4", "update")]
    actions, _ = replay.replay(ask(("3", 0, "f", "a"), ("1", 1, "f", None), ("2", 2, None, "a")), none)
    assert {r.action for r in actions.collect()} == {"create", "update"}
    actions, changed = replay.replay(ask(("x", 0, None, None), ("y", 0, None, None)), none)  # without signals each is new
    assert [r.action for r in actions.collect()] == ["create"] * 2 and changed.count() == 2
    assert replay.replay(ask(("x", 0, "f", None)).limit(0), none)[0].count() == 0


def test_identities_on_a_stream(spark, make, tmp_path):
    given = sorted(made_requests(9, 90), key=lambda r: (r[2], r[0]))
    source = str(tmp_path / "in")
    for i in range(0, 90, 30):  # the query starts anew after each part
        spark.createDataFrame(given[i : i + 30], REQUESTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(REQUESTS).parquet(source)
        streams.resolve_identities(stream, str(tmp_path / "state"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        if i == 30:  # the last part goes on from a snapshot
            before = sorted(streams.identities(spark, str(tmp_path / "state")).collect())
            number = streams.snapshot_identities(spark, str(tmp_path / "state"))
            assert number == streams.snapshot_identities(spark, str(tmp_path / "state")) and sorted(streams.identities(spark, str(tmp_path / "state")).collect()) == before
    _, actions = streams.identity_tables(str(tmp_path / "state"))
    assert streams.snapshot_identities(spark, str(tmp_path / "nothing")) is None
    held = streams.identities(spark, str(tmp_path / "state"))
    compare(actions.read(spark).collect(), held.collect(), one_by_one(given, []))
    assert held.select("id").distinct().count() == held.count()


def test_merged_lists_and_touchpoints(spark, make):
    points = lambda *at: [{"p": t, "timestamp": t} for t in at]
    days = [f"2026-01-{d:02}T00:00:00Z" for d in range(1, 31)]
    v = make("visitors", [visitor("a", first_seen_at=0, fingerprints=["x", "y"], anonymous_ids=None, attribution_path=points(*days[:20], "odd")), visitor("b", first_seen_at=1, fingerprints=["y", "z"], anonymous_ids=["n"], attribution_path=points(*days[10:], "2025-12-31T00:00:00Z")), visitor("c", first_seen_at=2, fingerprints=["z", "w"], attribution_path=points(*[f"2026-02-{d:02}T00:00:00Z" for d in range(1, 29)])), visitor("d", first_seen_at=3, fingerprints=["q"])])
    groups = v.select(F.col("id").alias("visitor_id"), F.when(F.col("id") == "d", "d").otherwise("a").alias("survivor_id"))
    after = {r.id: r for r in identity.merge(v, groups).collect()}
    assert after["a"].fingerprints == ["x", "y", "z", "w"] and after["a"].anonymous_ids == ["n"] and after["d"].fingerprints == ["q"]
    times = [p["timestamp"] for p in after["a"].attribution_path]
    every = sorted({*days, "2025-12-31T00:00:00Z", *[f"2026-02-{d:02}T00:00:00Z" for d in range(1, 29)]}) + ["odd"]
    assert times == every[-50:]


def test_hooks_by_event_type(spark, make, tmp_path):
    e = make("events", [event(1, "a", "sale", amount_cents=5), event(2, "a", "lead"), event(3, "gone", "sale", amount_cents=7), event(4, "a", "share")])
    seen = []
    registry = hooks.Hooks(make("visitors", [visitor("a"), visitor("b", merged_into_id="a")]), budget_seconds=20)
    registry.register("sale", lambda rows, n: (n, [r.id for r in rows.collect()]))
    registry.register("sale", lambda rows, n: 1 / 0)  # stops nothing
    registry.register("lead", lambda rows, n: seen.append((n, rows.count())), detached=True)
    registry.register("identify", lambda rows, n: seen.append("never"))
    assert registry(e, 7) == {"sale": [(7, ["1"])]} and seen == [(7, 1)]  # an event without a visitor goes to no hook
    slow = hooks.Hooks(budget_seconds=0.2)
    slow.register("sale", lambda rows, n: time.sleep(1))
    slow.register("sale", lambda rows, n: "in time")
    assert slow(e, 0) == {"sale": ["in time"]}
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    streams.deliver(stream, registry, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert seen[1:] == [(0, 1)]
