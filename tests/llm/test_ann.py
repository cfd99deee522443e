import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, rank int"


def table(spark, vectors, first=0):
    rows = [(first + k, None if v is None else [None if x is None else float(x) for x in v], 0) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def exact(vectors, query, count):
    x = np.array(vectors, dtype=np.float32).astype(float)
    score = x @ x[query]
    order = [k for k in np.lexsort((np.arange(len(x)), -score)) if k != query]
    return [(k, score[k]) for k in order[:count]]


def test_hilbert_neighbours_touch():
    side = 8
    cells = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    keys = ann.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(side**3))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_best_pairs_break_ties_by_id():
    q, rows = np.array([[1.0, 0.0]]), np.array([[1.0, 5.0], [1.0, 0.0], [0.5, 0.0], [1.0, 1.0]])
    who, what, score = ann.best_pairs(q, np.array([7]), rows, np.array([9, 7, 3, 2]), 2)
    assert who.tolist() == [7, 7] and what.tolist() == [2, 9] and score.tolist() == [1.0, 1.0]


@pytest.mark.parametrize("clustered", [True, False])
def test_recall(spark, clustered):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((60, 16))
    x = rng.standard_normal((3000, 16)) * (0.15 if clustered else 1)
    x = (x + centres[rng.integers(0, 60, 3000)] * clustered).astype(np.float32)
    got = {}
    found = ann.nearest(table(spark, x), F.col("id") % 20 == 0, count=10, block=32)
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(range(0, 3000, 20))
    hits = 0
    for q, near in got.items():
        want = exact(x, q, 10)
        assert sorted(near) == list(range(1, 11))
        hits += len({k for k, _ in want} & {k for k, _ in near.values()})
        for k, score in near.values():
            assert abs(score - float(x[k].astype(float) @ x[q].astype(float))) < 1e-9
    assert hits / (10 * len(got)) >= 0.9


def test_equal_vectors_take_the_smallest_ids(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.tile([[3.0, 1.0, 0.0, 0.0]], (300, 1)), rng.standard_normal((100, 4))])
    found = ann.nearest(table(spark, x), F.col("id") == 240, count=5, block=16).orderBy("rank")
    assert [r["vec_id"] for r in found.collect()] == [k for k, _ in exact(x, 240, 5)]


def test_groups_of_queries_and_a_common_vector(spark, monkeypatch):
    """Queries of a block go to several groups; half of all rows, queries among them, are equal."""
    monkeypatch.setattr(ann, "QUERIES", 7)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 6))
    x[::2] = x[0]
    x = x.astype(np.float32)
    found = ann.nearest(table(spark, x).withColumn("same", F.lit(1)), F.col("id") % 4 == 0, count=5, block=16)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert set(got) == set(range(0, 400, 4))
    hits = sum(len(set(got[q].values()) & {k for k, _ in exact(x, q, 5)}) for q in got)
    assert hits >= 0.9 * 5 * len(got)
    assert list(got[300].values()) == [k for k, _ in exact(x, 300, 5)]


def test_edges(spark):
    bad = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0]]
    good = [[1.0, 0.0], [0.9, 0.1], [0.0, 2.0]]
    df = table(spark, good + bad)
    df = df.union(df.limit(2)).union(table(spark, [[5.0, 5.0]]).withColumn("vec_id", F.lit(None).cast("long")))
    rows = ann.nearest(df, F.col("id") >= 0).collect()
    near = {(r["query_id"], r["rank"]): r["vec_id"] for r in rows}
    assert near == {(0, 1): 1, (0, 2): 2, (1, 1): 0, (1, 2): 2, (2, 1): 1, (2, 2): 0}
    assert ann.nearest(df.limit(0), F.col("id") >= 0).collect() == []
    assert ann.nearest(df, F.col("id") < 0).collect() == []
