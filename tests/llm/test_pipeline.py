"""The stages in order, on a small folder of tables."""

import random
import re
from pathlib import Path

import corpus_pipeline
from wayfarer.llm import common, registry, simhash


def folder(spark, make_docs, path, rows, items):
    make_docs(rows, extra=False).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, make_docs, tmp_path):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("xyz") * rng.randint(1, 3) for _ in range(n))
    rows = [(i, text(80), f"s{i % 4}", "en") for i in range(150)]
    leak = text(30)
    rows += [(200, rows[0][1], "s0", "en"), (201, rows[1][1] + " end", "s1", "en"), (202, f"{text(40)} {leak} {text(40)}", "s2", "en"), (203, "", "s3", "en"), (204, "12 34 !!", "s3", None)]
    path = folder(spark, make_docs, tmp_path, rows, [(1, leak), (2, text(30))])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.collect()}
        if name != "sharding":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    assert kept["language_id"] == {r[0] for r in rows} - {203, 204}
    assert kept["near_dedup"] == kept["language_id"] - {200, 201} or kept["near_dedup"] == kept["language_id"] - {200}
    assert kept["decontamination"] == kept["near_dedup"] - {202}
    assert kept["mixing"] <= kept["decontamination"] and kept["sharding"] == kept["mixing"]
    scratch = Path(common.scratch_path(spark, "x").removeprefix("file:")).parents[1]
    held = set(scratch.iterdir()) if scratch.exists() else set()
    again = corpus_pipeline.run(spark, path)
    assert [sorted(x.name for x in f.iterdir()) for f in set(scratch.iterdir()) - held] == [["sharding"]]
    assert sorted((r.doc_id, r.shard, r.slot) for r in again.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in docs.collect())


def test_near_dedup_broadcasts_no_balls(spark, make_docs, tmp_path, monkeypatch):
    text = " ".join(f"w{i}" for i in range(400))
    path = folder(spark, make_docs, tmp_path, [(i, f"{text} {i}", "s", "en") for i in range(9)] + [(9, "other words", "s", "en")], [(1, "x")])
    plans, connected = [], simhash.connected
    monkeypatch.setattr(simhash, "connected", lambda edges: plans.append(edges._jdf.queryExecution().executedPlan().toString()) or connected(edges))
    kept = corpus_pipeline.drop_near_copies(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in simhash.find_near(spark.read.parquet(f"{path}/documents.parquet")).collect()}
    assert plans and not any("Broadcast" in p for p in plans)


def test_empty_and_odd_tables(spark, make_docs, tmp_path):
    path = folder(spark, make_docs, tmp_path / "a", [], [(1, "x")])
    assert corpus_pipeline.run(spark, path).count() == 0
    path = folder(spark, make_docs, tmp_path / "b", [(None, None, None, None), (1, None, "s", "en"), (1, "word one two", None, "en"), (1, "word one two", None, "en"), (None, "word one two three", "s", None)], [(None, None)])
    assert corpus_pipeline.run(spark, path).count() >= 1


def test_a_query_for_each_operator():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries())
    assert numbers == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())
