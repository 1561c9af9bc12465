import zlib
from dataclasses import replace

from pyspark.sql import functions as F

from tallyline.llm import shards


def placed(spark, tree, n=4000):
    return {r.id: r.shard for r in shards.with_shard(spark.range(n), F.col("id"), tree).collect()}


def test_a_further_shard_takes_rows_only_into_itself(spark):
    for n in (24, 25):
        before, after = placed(spark, shards.tree(n)), placed(spark, shards.tree(n + 1))
        moved = {i for i in before if before[i] != after[i]}
        assert {after[i] for i in moved} == {n} and 4000 / (n + 1) * 0.6 < len(moved) < 4000 / (n + 1) * 1.5


def test_movement_stays_in_subtrees_whose_weight_changes(spark):
    old = shards.tree(24)
    heavier = tuple(replace(s, weight=3.0) if s.number == 9 else s for s in old)
    before, after = placed(spark, old), placed(spark, heavier)
    moved = [(before[i], after[i]) for i in before if before[i] != after[i]]
    region = {s.number: s.region for s in old}
    rack = {s.number: s.rack for s in old}
    assert moved and all(region[b] == region[9] for _, b in moved)  # into its region only
    assert all(rack[b] == rack[9] for a, b in moved if region[a] == region[b])  # and within it into its rack only
    share = sum(s == 9 for s in after.values()) / 4000
    assert 0.6 < share / (3 / 26) < 1.4
    gone = tuple(replace(s, weight=0.0) if s.number == 9 else s for s in old)
    assert 9 not in placed(spark, gone).values()


def test_rows_of_any_kind_get_a_shard_and_a_slot(docs, no_docs, rows):
    out = shards.assign(docs.withColumn("shard", F.lit("clash"))).collect()
    assert len(out) == len(rows) and {r.law for r in out} == {"key"}
    want = sorted(((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=repr) == want
    held = {}
    for r in out:
        held.setdefault(r.shard, []).append(r)
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    for own in held.values():
        own.sort(key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        ids = [r.doc_id for r in own if r.doc_id is not None]
        assert ids == sorted(ids)
    assert len({r.shard for r in out if r.doc_id is None}) == 1
    assert shards.assign(no_docs).count() == 0


def test_the_plan_runs_no_python(docs):
    plan = shards.assign(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
