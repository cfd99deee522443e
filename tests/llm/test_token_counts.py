import numpy as np
from tests_llm_help import documents, invented

from factloom.llm import token_counts as T


def test_every_limit_by_hand(spark, monkeypatch):
    monkeypatch.setattr(T, "GROUP", 16)
    texts = invented(120, seed=5, low=0, high=80) + ["", None]
    lengths = [r["n"] for r in documents(spark, texts).select(T.token_count("text").alias("n")).collect()]
    n = np.array(lengths)
    hist = T.length_histogram(documents(spark, texts))
    asked = spark.createDataFrame([(0,), (7,), (7,), (50,), (10**6,), (None,)], "m int")
    for totals, limits in ((T.context_totals(hist), sorted(set(lengths))), (T.context_totals(hist, asked), [0, 7, 50, 10**6])):
        rows = sorted(totals.collect(), key=lambda r: r["limit"])
        assert [r["limit"] for r in rows] == limits
        for r in rows:
            m = r["limit"]
            assert r["n_docs"] == (n == m).sum()
            assert (r["docs_within"], r["docs_cut"]) == ((n <= m).sum(), (n > m).sum())
            assert r["tokens_within"] == n[n <= m].sum()
            assert r["tokens_kept"] == np.minimum(n, m).sum()
            assert r["tokens_lost"] == (n - np.minimum(n, m)).sum()
            assert abs(r["share_within"] - (n <= m).mean()) < 1e-12
    shares = [0.1, 0.5, 0.9, 1.0]
    got = {r["share"]: r["n_tokens"] for r in T.length_quantiles(T.context_totals(hist), shares).collect()}
    assert got == {s: sorted(lengths)[int(np.ceil(s * len(n) - 1e-9)) - 1] for s in shares}


def test_edges(edge_docs, no_docs):
    rows = T.context_totals(T.length_histogram(edge_docs)).collect()
    assert sum(r["n_docs"] for r in rows) == edge_docs.count()
    assert T.context_totals(T.length_histogram(no_docs)).collect() == []
