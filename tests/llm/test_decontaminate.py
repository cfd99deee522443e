import random
import re

import numpy as np
import pytest
from tests_llm_help import documents, invented

from factloom.llm import decontaminate as D

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def judged(texts, items, window=13):
    owners = {}
    for name, text in items:
        own = words(text)
        size = min(window, len(own))
        for k in range(len(own) - size + 1 if size else 0):
            owners.setdefault(tuple(own[k : k + size]), set()).add(str(name))
    out = {}
    for key, text in texts:
        own, hit, found = words(text), set(), set()
        for size in {len(w) for w in owners}:
            for k in range(len(own) - size + 1):
                if names := owners.get(tuple(own[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= names
        bad = len(hit) > 0 and 20 * len(hit) >= len(own)
        out[key] = (len(own), len(hit), sorted(found), bad)
    return out


@pytest.fixture
def case(spark):
    rng = random.Random(8)
    items = invented(25, seed=2, low=14, high=50) + ["Tiny item", "solo", "", None, "one, two; three FOUR"]
    items += items[:2]
    texts = invented(60, seed=3, low=1, high=300)
    for k in range(0, 60, 2):
        source = words(items[rng.randrange(25)])
        cut = rng.randint(8, len(source))
        begin = rng.randint(0, len(source) - cut)
        at = rng.randrange(len(texts[k]))
        texts[k] = texts[k][:at] + " " + ", ".join(source[begin : begin + cut]).upper() + " " + texts[k][at:]
    texts += ["tiny-item here", "SOLO", "one two three", "one two three four", items[0] + " " + items[0], "", None]
    return items, texts


def found(rows):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in rows}


def test_by_hand(spark, case):
    items, texts = case
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    out = D.overlaps(documents(spark, texts), table)
    want = judged(list(enumerate(texts)), list(enumerate(items)))
    got = out.collect()
    assert found(got) == want
    assert all(r["n_items"] == len(r["items"]) for r in got)
    assert any(w[3] for w in want.values()) and any(w[1] and not w[3] for w in want.values())
    kept = D.clean_documents(documents(spark, texts), table)
    assert {r["doc_id"] for r in kept.collect()} == {k for k, w in want.items() if not w[3]}


def test_small_bitmap_changes_nothing(spark, case, monkeypatch):
    monkeypatch.setattr(D, "MOST_BITS", 1 << 16)
    monkeypatch.setattr(D, "BITS_EACH", 1)
    items, texts = case
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = D.overlaps(documents(spark, texts), table).collect()
    assert found(got) == judged(list(enumerate(texts)), list(enumerate(items)))


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    text = [w.encode() for w in words(" ".join(invented(40)))] + [b"z" * 500]
    whole = D._hash_words(text)
    monkeypatch.setattr(D, "BLOCK", 64)
    assert (D._hash_words(text) == whole).all()
    assert len(np.unique(whole)) == len(set(text))
    assert len(D.shingle_hashes(whole[:2], 3)) == 0


def test_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([("a", "one TWO"), ("b", None), (None, "word")], "item_id string, text string")
    rows = D.overlaps(edge_docs, items).collect()
    assert len(rows) == edge_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[4]["items"] == ["a"] and by[4]["contaminated"] and by[4]["n_hit"] == 2
    assert by[3]["n_hit"] == 1 and by[1]["n_words"] == 0 and not by[1]["contaminated"]
    assert D.overlaps(no_docs, items).collect() == []
    nothing = D.overlaps(edge_docs, items.limit(0)).collect()
    assert len(nothing) == len(rows) and not any(r["n_hit"] for r in nothing)
    kept = D.clean_documents(edge_docs, items)
    assert kept.count() == len(rows) - 2
    assert kept.columns == [c for c in edge_docs.columns if c != "__row"]
