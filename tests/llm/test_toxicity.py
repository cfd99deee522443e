import random

import numpy as np
from pyspark.sql import functions as F
from tests_llm_help import documents, invented

from factloom.llm import toxicity as T

BAD = ["idiot", "moron", "worthless", "pathetic", "trash", "scum", "badword", "badwords"]


def sown(count, seed):
    rng, texts, toxic = random.Random(seed), invented(count, seed=seed, low=20, high=80), []
    for k in range(count):
        toxic.append(int(rng.random() < 0.25))
        if toxic[-1]:
            words = texts[k].split()
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
            texts[k] = " ".join(words)
    return texts, toxic


def test_held_out_accuracy(spark):
    texts, toxic = sown(900, 12)
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(k, toxic[k]) for k in range(600)], "doc_id long, toxic int")
    chain = T.train(docs, labels)
    assert [link.category for link in chain.links] == ["kind_1", "kind_2", "kind_3", "toxic"]
    assert chain.recall > 0.95 and chain.clean_rejected < 0.02
    scored = {r["doc_id"]: r for r in T.score(docs, chain).collect()}
    fresh = range(600, 900)
    assert np.mean([scored[k]["rejected"] == bool(toxic[k]) for k in fresh]) > 0.97
    kept = T.clean_documents(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in scored.items() if not r["rejected"]}


def presence(x):
    rows, terms = np.nonzero(x)
    return T.Presence(rows, terms, len(x), x.shape[1])


def test_later_links_use_earlier_probabilities():
    rng = np.random.default_rng(0)
    x = rng.random((400, 6)) < 0.4
    labels = {"one": x[:, 0] * 1.0, "two": np.maximum(x[:, 0], x[:, 1]) * 1.0}
    chain = T.fit_chain(presence(x), labels, list("abcdef"))
    assert len(chain.links[1].weights) == len(chain.links[0].weights) + 1
    assert chain.links[1].weights[6] > 0.5


def test_fit_is_the_ridge_optimum():
    """Against plain Newton steps on dense numbers."""
    rng = np.random.default_rng(1)
    x = rng.random((300, 12)) < 0.3
    y = (x[:, 0] | (rng.random(300) < 0.2)).astype(float)
    dense = np.concatenate([x, np.ones((300, 1))], axis=1)
    shrink = np.append(np.full(12, T.RIDGE), 1e-6)
    w = np.zeros(13)
    for _ in range(30):
        p = 1 / (1 + np.exp(-dense @ w))
        curve = dense.T @ (dense * (p * (1 - p))[:, None]) + np.diag(shrink)
        w += np.linalg.solve(curve, dense.T @ (y - p) - shrink * w)
    assert np.allclose(T._fit(presence(x), y), w, atol=1e-4)


def test_scores_by_hand(spark):
    """Every probability again from the chain's weights, one document and one term at a time."""
    texts, toxic = sown(300, 21)
    texts += ["", None, "idiot " * 3000]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(k, toxic[k]) for k in range(300)], "doc_id long, toxic int")
    chain = T.train(docs, labels)
    got = {r["doc_id"]: r for r in T.score(docs, chain).collect()}
    for key, text in enumerate(texts):
        words = set((text or "").lower().split())
        terms = words | {f"{w[:4]}*" for w in words if len(w) > 4}
        earlier = []
        for link in chain.links:
            total = 0.0
            if link.weights is not None:
                total = link.weights[-1] + sum(
                    v for w, v in zip(chain.words, link.weights, strict=False) if w in terms
                )
                total += sum(p * v for p, v in zip(earlier, link.weights[len(chain.words) :], strict=False))
            earlier.append(0.0 if link.weights is None else 1 / (1 + np.exp(-total)))
            assert abs(got[key]["chances"][link.category] - earlier[-1]) < 1e-9
        assert got[key]["rejected"] == (got[key]["chances"]["toxic"] >= chain.threshold)


def test_an_equal_probability_rejects(spark):
    chain = T.Chain([], [T.Link("toxic", np.array([0.0]))], 0.5)
    assert [r["rejected"] for r in T.score(documents(spark, ["a", None]), chain).collect()] == [True, True]


def test_groups_share_terms():
    """Documents of three kinds with terms of their own, beside a term that all have."""
    kind = np.arange(90) % 3
    x = np.zeros((120, 10), dtype=bool)
    x[:, 9] = True
    x[np.arange(90), kind] = x[np.arange(90), kind + 3] = True
    y = np.array([1.0] * 90 + [0.0] * 30)
    found = T.groups_of(presence(x), y, np.ones(10))
    for label in found.values():
        assert len(set(kind[label[:90] > 0])) == 1 and label.sum() == 30


def test_threshold():
    p, y = np.array([0.9, 0.8, 0.4, 0.3, 0.1]), np.array([1, 1, 0, 1, 0])
    t = T.best_threshold(p, y)
    assert 0.1 < t <= 0.3 and T.best_threshold(p, y * 0) > 1


def test_nothing_is_rejected_where_nothing_was_learned(spark):
    """Labels without a term in common: all documents have one probability, and all stay."""
    assert T.best_threshold(np.full(50, 0.1), np.arange(50) % 10 == 0) > 1
    texts, _ = sown(60, 4)
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(k, int(k in (3, 30))) for k in range(60)], "doc_id long, toxic int")
    assert T.clean_documents(docs, labels).count() == 60


def test_sample_is_bounded(spark):
    texts, toxic = sown(300, 3)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    chain = T.train(documents(spark, texts), labels, sample=80)
    full = T.train(documents(spark, texts), labels)
    assert len(chain.words) < len(full.words)


def test_edges(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one_sided = spark.createDataFrame([(k, 1) for k in range(5)] + [(None, 0), (6, None)], "doc_id long, toxic int")
    for labels in (none, one_sided):
        kept = T.clean_documents(edge_docs, labels)
        assert kept.count() == edge_docs.count() and kept.columns == edge_docs.columns
    both = spark.createDataFrame([(k, k % 2) for k in range(10)] * 2, "doc_id long, toxic int")
    chain = T.train(edge_docs, both)
    out = T.score(edge_docs, chain)
    assert out.count() == edge_docs.count()
    assert T.score(no_docs, chain).collect() == []
    assert T.clean_documents(no_docs, both).filter(F.lit(True)).collect() == []
