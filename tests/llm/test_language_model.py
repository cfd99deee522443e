import math
import random
import zlib
from collections import Counter

import numpy as np
from tests_llm_help import documents, invented

from factloom.llm import language_model as L


def is_held(key):
    return zlib.crc32(str(key).encode()) % 7 == 2


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["\n"]


def by_hand(texts):
    counts = Counter(w for k, t in enumerate(texts) if not is_held(k) for w in words(t))
    total, kinds = sum(counts.values()), len(counts)
    return {
        k: (
            is_held(k),
            len(words(t)),
            sum(counts[w] > 0 for w in words(t)),
            total,
            sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words(t)),
        )
        for k, t in enumerate(texts)
    }


def check(rows, want):
    assert len(rows) == len(want)
    for r in rows:
        held, tokens, known, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, tokens, known, total)
        assert abs(r["base_score"] - base) < 1e-8 * max(1, abs(base))
        assert r["score"] < 0 or r["train_tokens"] == 0


def test_base_by_hand(spark, monkeypatch):
    texts = invented(80, seed=3) + ["", None, "never-seen words\x0bhere", "É\xa0É é"]
    docs = documents(spark, texts)
    check(L.scored_documents(docs, classes=20).collect(), by_hand(texts))
    monkeypatch.setattr(L, "HOT", 8)
    check(L.scored_documents(docs, classes=5).collect(), by_hand(texts))


def test_probabilities_sum_to_one():
    counts = L.Counts(100, 6, ["", "\n", "a", "b"], {"a": 40, "b": 20, "c": 15}, np.array([30, 10, 40, 20]))
    rng = np.random.default_rng(4)
    start = L.started(counts)
    own = L.Parameters(*(p + rng.normal(0, 0.5, p.shape).astype(np.float32) for p in start))
    scorer = L.Scorer(own, counts)
    # The words of the class for other words: c (15 of 30 tokens), two more, and an unseen one.
    other = [(n + 1) / (counts.other_tokens + counts.other_distinct + 1) for n in (15, 8, 7, 0)]
    assert abs(sum(other) - 1) < 1e-12
    for before in ([], [2], [3, 2], [2, 0]):
        chances = []
        for k in range(4):
            classes = np.array([*before, k])
            chances.append(math.exp(scorer.log_probabilities(classes, np.array([0]))[-1]))
        assert abs(sum(chances) - 1) < 1e-5


def test_training_learns_word_order(spark):
    rng = random.Random(1)
    texts = [" ".join(["red", "green", "blue"] * rng.randint(5, 30)) for _ in range(300)]
    rows = L.scored_documents(documents(spark, texts), classes=8, rounds=3).collect()
    held = [r for r in rows if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert len(held) > 20 and gain > 0.1


def test_gradient_follows_the_loss():
    rng = np.random.default_rng(3)
    counts = L.Counts(100, 6, ["", "\n", "a", "b"], {"a": 40, "b": 20}, np.array([30, 10, 40, 20]))
    trainer = L.Trainer(L.started(counts, 4), L.noise_of(counts), 0)
    target, one = rng.integers(0, 4, 500), rng.integers(0, 5, 500)
    target = np.where(one < 4, one, target)
    scorer = lambda: L.Scorer(trainer.own, counts)
    pairs = np.stack([one % 4, target], axis=1).ravel()
    before = scorer().log_probabilities(pairs, np.arange(0, 1000, 2))[1::2].mean()
    for _ in range(60):
        trainer.step(target, one % 4, np.full(500, 4))
    after = scorer().log_probabilities(pairs, np.arange(0, 1000, 2))[1::2].mean()
    assert after > before + 0.3


def test_edges(edge_docs, no_docs, spark):
    rows = L.scored_documents(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["n_tokens"] == by[1]["n_tokens"] == 1
    assert all(math.isfinite(r["score"]) for r in rows)
    assert L.scored_documents(no_docs).collect() == []
    held = next(k for k in range(50) if is_held(k))
    (only,) = L.scored_documents(documents(spark, ["a b"], first=held)).collect()
    assert only["train_tokens"] == 0 and only["base_score"] == 0
