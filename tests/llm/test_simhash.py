import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tests_llm_help import classes_of, documents, invented

from factloom.llm import simhash
from factloom.llm.components import components


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \t\x0b\x85\xa0Zé", max_size=80))
def test_fingerprint_by_hand(text):
    assert simhash.fingerprint_of(text) == slow_print(text)


def test_fingerprint_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "COUNTED", 3)
    text = " ".join(invented(5))
    assert simhash.fingerprint_of(text) == slow_print(text)


def near_prints(count, seed):
    """Numbers in chains of few differing bits, and others far away."""
    rng = random.Random(seed)
    out = {0}
    while len(out) < count:
        start = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            out.add(start)
            for _ in range(rng.randint(1, 5)):
                start ^= 1 << rng.randrange(64)
    return sorted(out)


def all_links(prints, radius=4):
    a = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None]) <= radius
    return [(prints[i], prints[j]) for i, j in zip(*np.nonzero(near), strict=True)]


def test_forest_joins_all_links(monkeypatch):
    monkeypatch.setattr(simhash, "RUN", 16)
    prints = near_prints(600, 3)
    want = classes_of(prints, all_links(prints))
    half = np.array(prints[::2], dtype=np.uint64), np.array(prints[1::2], dtype=np.uint64)
    links = []
    for left, right in ((half[0], half[0]), (half[1], half[1]), half):
        a, b = simhash.forest(left, right, 4)
        links += list(zip(a.tolist(), b.tolist(), strict=True))
        assert len(a) < len(left) + len(right)
    assert classes_of(prints, links) == want


def test_tiles_of_a_table(spark):
    prints = near_prints(500, 5)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    got = {r["fingerprint"]: r["root"] for r in simhash.fingerprint_classes(table, tile=20).collect()}
    back = dict(zip(signed, prints, strict=True))
    want = classes_of(prints, all_links(prints))
    groups = {}
    for p, root in got.items():
        groups.setdefault(root, set()).add(want[back[p]])
    assert len(got) == len(prints)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_documents_by_hand(spark):
    base = invented(60, seed=4, low=30, high=90)
    texts = base + base[:10] + [t + " more" for t in base[10:30]] + ["", None, " "]
    docs = documents(spark, texts)
    prints = {k: slow_print(t) for k, t in enumerate(texts)}
    keys = list(prints)
    links = [
        (a, b) for a in keys for b in keys if a < b and (prints[a] ^ prints[b]).bit_count() <= 4
    ]
    want = classes_of(keys, links)
    got = simhash.near_duplicates(docs, tile=7).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["fingerprint"] & (2**64 - 1) for r in got} == prints
    kept = simhash.first_of_each(docs, tile=7)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert kept.columns == docs.columns


def test_edges(edge_docs, no_docs):
    got = simhash.near_duplicates(edge_docs)
    rows = got.collect()
    assert len(rows) == edge_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    assert by[0] == by[1] == by[2] == {(0, 0)}
    assert by[6].pop()[1] == by[7].pop()[1] == 6
    assert by[None].pop()[1] is None
    kept = simhash.first_of_each(edge_docs)
    assert kept.columns == [c for c in edge_docs.columns if c != "__row"]
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 3, 4, 5, 6, 8, 9]
    assert kept.filter("doc_id is null").count() == 1
    assert simhash.near_duplicates(no_docs).collect() == []
    assert simhash.first_of_each(no_docs).collect() == []


def test_components(spark):
    rng = random.Random(2)
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(7, k) for k in range(200, 260)]
    noise = [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)]
    links = chain + star + noise + [(5, 5), (160, 100), (7, 200)]
    table = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["root"] for r in components(table).collect()}
    assert got == classes_of({n for pair in links for n in pair}, links)
    assert components(table.limit(0)).collect() == []
