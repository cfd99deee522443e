import zlib

from pyspark.sql import functions as F
from tests_llm_help import documents

from factloom.llm import hash_tree as H


def placed(spark, tree, count=20_000):
    keys = spark.range(count)
    return {r["id"]: r["s"] for r in keys.select("id", H.shard_of(F.col("id"), tree).alias("s")).collect()}


def test_shares_follow_weights(spark):
    tree = [H.Leaf("a", "r", 0, 1), H.Leaf("a", "r", 1, 3), H.Leaf("b", "r", 2, 2), H.Leaf("b", "s", 3, 2), H.Leaf("b", "s", 4, 0)]
    got = list(placed(spark, tree).values())
    assert 4 not in got
    for shard, share in ((0, 1 / 8), (1, 3 / 8), (2, 1 / 4), (3, 1 / 4)):
        assert abs(got.count(shard) / len(got) - share) < 0.015


def test_one_more_shard_takes_only_into_itself(spark):
    tree = H.even_tree(16)
    before, after = placed(spark, tree), placed(spark, H.grown_tree(tree))
    moved = [after[k] for k in before if before[k] != after[k]]
    assert set(moved) == {16} and abs(len(moved) / len(before) - 1 / 17) < 0.01


def test_weight_changes_stay_in_their_subtree(spark):
    tree = H.even_tree(16)
    heavier = [x._replace(weight=2.0) if x.shard == 5 else x for x in tree]
    region, rack = tree[5].region, tree[5].rack
    place = {x.shard: x for x in tree}
    before, after = placed(spark, tree), placed(spark, heavier)
    for key, shard in before.items():
        old, new = place[shard], place[after[key]]
        if old.region != new.region:
            assert new.region == region
        elif old.rack != new.rack:
            assert (new.region, new.rack) == (region, rack)
        elif old != new:
            assert new.shard == 5


def test_slots(spark, monkeypatch):
    docs = documents(spark, ["é" * (k % 9) for k in range(3000)])
    hot = docs.limit(1).crossJoin(spark.range(1500)).drop("id")
    docs = docs.union(hot.select(docs.columns)).repartition(5)
    rows = H.assign_shards(docs, H.even_tree(16)).collect()
    assert len(rows) == 4500
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len({r["shard"] for r in rows if r["doc_id"] == 0}) == 1


def test_edges(edge_docs, edge_texts, no_docs):
    rows = H.assign_shards(edge_docs, H.even_tree(4)).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        if r["doc_id"] is not None:
            raw = (edge_texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert r["shard"] is not None and r["slot"] is not None
    assert H.assign_shards(no_docs, H.even_tree(4)).collect() == []
