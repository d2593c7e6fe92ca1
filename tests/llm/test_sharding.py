import zlib
from collections import Counter

from inkstone.llm import sharding
from tests.llm.common import awkward, documents, empty, run

TREE = sharding.Topology.regular(4, 2, 5)


def test_query(spark, sf_dir):
    got = run(spark, "op5_sharding", sf_dir)
    texts = dict(documents(spark, sf_dir))
    assert len(got) == len(texts) and set(got.law) == {"key"} and got.shard.between(0, 39).all()
    for r in got.itertuples():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw)) and r.grown_shard in (r.shard, 40)
    for _, rows in got.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))


def shards(spark, tree, n=4000):
    return {r.id: r.shard for r in sharding.place(spark.range(n), "id", tree).collect()}


def test_shares_follow_weights_and_movement_stays_in_the_subtree(spark):
    before = shards(spark, TREE)
    assert max(Counter(before.values()).values()) < 1.6 * 100 and len(set(before.values())) == 40
    heavier = sharding.Topology(tuple(sharding.Shard(s.shard, s.region, s.rack, 3.0 if s.shard == 7 else 1.0) for s in TREE.shards))
    after = shards(spark, heavier)
    region = {s.shard: s.region for s in TREE.shards}
    rack = {s.shard: (s.region, s.rack) for s in TREE.shards}
    for k, (a, b) in ((k, (before[k], after[k])) for k in before if before[k] != after[k]):
        assert region[b] == region[7] and (region[a] != region[b] or rack[b] == rack[7] or rack[a] == rack[b]), k
    assert Counter(after.values())[7] > 1.8 * Counter(before.values())[7]
    grown = shards(spark, TREE.with_region())
    moved = [k for k in before if before[k] != grown[k]]
    assert moved and {grown[k] for k in moved} == {40}


def test_awkward_rows(spark):
    docs = awkward(spark, [None, "", "é", "x" * 100_000, "é"])
    docs = docs.union(docs).union(spark.createDataFrame([(None,) * 9], docs.schema))
    rows = sharding.shard_documents(docs, TREE, TREE.with_region()).collect()
    assert len(rows) == 11 and {r["size"] for r in rows} == {16, 18, 100_016}
    for s, n in Counter(r.shard for r in rows).items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert sharding.shard_documents(empty(spark), TREE).count() == 0
