import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_help import classes_of, documents, invented

import corpus_pipeline
from factloom.llm import near_copies, simhash
from factloom.session import cut_lineage


def shingled(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def first_ones(texts):
    """The least place of each class over links of at least 0.8, by comparing all pairs."""
    sets = [shingled(t) for t in texts]
    links = [
        (a, b)
        for a in range(len(sets))
        for b in range(a)
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    ]
    return sorted(set(classes_of(range(len(sets)), links).values()))


def changed(text, count, rng):
    words = text.split()
    for k in rng.sample(range(len(words)), count):
        words[k] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def kept(spark, texts):
    out = corpus_pipeline.drop_near_copies(spark, documents(spark, texts), "")
    return sorted(r["doc_id"] for r in out.collect())


@pytest.mark.parametrize("sample", [10_000, 1])
def test_the_stage_drops_all_near_copies(spark, monkeypatch, sample):
    """Two to four words changed of 200, in groups and chains, beside texts around the bound."""
    monkeypatch.setattr(near_copies, "SAMPLE", sample)
    rng = random.Random(8)
    base = invented(12, seed=3, low=200, high=200)
    texts = [changed(t, n, rng) for t in base for n in (0, 2, 2, 4, 5, 6, 9)]
    step = invented(1, seed=5, low=150, high=150)[0]
    for _ in range(12):
        step = changed(step, 2, rng)
        texts.append(step)
    passage = " ".join(invented(1, seed=6, low=40, high=40))
    texts += [f"{passage} {t}" for t in invented(30, seed=7, low=30, high=60)]
    texts += ["", None, " ", "a b", "A  b", "a b c d e", "a b c d e f"]
    rng.shuffle(texts)
    want = first_ones(texts)
    assert len(want) < len(texts) - 50
    assert kept(spark, texts) == want


def test_equal_fingerprints_are_no_near_copies(spark):
    """A line that makes up over half of all shingles decides the fingerprint, not the text."""
    one, two = invented(2, seed=11, low=60, high=60)
    texts = [f"{'same ' * 90}{t}" for t in (one, two)]
    assert len({simhash.fingerprint_of(t) for t in texts}) == 1
    assert kept(spark, texts) == first_ones(texts) == [0, 1]


def test_groups_whose_hubs_miss_members(spark, monkeypatch):
    """Copies that are just near or just not near each other, with every number of hub rounds."""
    rng = random.Random(12)
    base = invented(3, seed=13, low=120, high=120)
    texts = [changed(t, rng.randint(1, 3), rng) for t in base for _ in range(25)]
    want = first_ones(texts)
    assert len(want) > 3
    for hubs in (1, 3):
        monkeypatch.setattr(near_copies, "HUBS", hubs)
        assert kept(spark, texts) == want


def test_edge_rows(spark, edge_docs, edge_texts, no_docs):
    """Null keys come last, all columns stay but the two that are named in the docstring."""
    docs = edge_docs.withColumn("__near", edge_docs.lang).withColumn("root", edge_docs.lang)
    out = near_copies.first_of_each(docs)
    assert sorted(out.columns) == sorted(c for c in docs.columns if c not in ("__row", "__near"))
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect())
    want = first_ones([*edge_texts, "no id"])
    assert found == [(k == len(edge_texts), 0 if k == len(edge_texts) else k) for k in want]
    assert near_copies.first_of_each(no_docs).count() == 0


def test_wide_bitmaps_differ_in_no_more_bits_than_sets_and_part_large_ones():
    draw = np.random.default_rng(1)
    for n in (1, 40, 700, 3000, 20000):
        one = np.unique(draw.integers(0, 2**64, n, dtype=np.uint64))
        for share in (0.3, 0.6, 0.9, 1.0):
            added = draw.integers(0, 2**64, int(n * (1 - share)), dtype=np.uint64)
            two = np.unique(np.concatenate([one[: int(np.ceil(n * share))], added]))
            differ = len(np.setxor1d(one, two))
            bits = [near_copies.wide_bitmap(x).view("<u8") for x in (one, two)]
            assert near_copies.bits_apart(*bits) <= differ
            if n >= 700 and share <= 0.6:
                # The short bitmap lets such pairs pass, since it is full.
                assert 9 * near_copies.bits_apart(*bits) > len(one) + len(two)


def test_sets_of_large_texts_that_are_no_near_copies_are_not_shuffled(spark, monkeypatch):
    words = [f"w{i}" for i in range(6000)]
    texts = [" ".join(words), " ".join([*words[:5900], *(f"x{i}" for i in range(100))])]
    texts.append(" ".join([*words[:3000], *(f"y{i}" for i in range(3000))]))
    rows = spark.createDataFrame(list(enumerate(texts)), "__row long, text string")
    common = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    rows = rows.select("*", near_copies._described(rows["text"], common).alias("near")).select(
        "__row", "text", "near.*"
    )
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a long, b long")
    met = {}

    def write(df, label, keep=False):
        met[label] = sorted(tuple(r) for r in df.collect()) if label in ("likely", "closer") else 0
        return cut_lineage(df, label, keep)

    monkeypatch.setattr(near_copies, "cut_lineage", write)
    near = near_copies._similar(pairs, rows, "text").collect()
    assert [tuple(r) for r in near] == [(0, 1)]
    assert met == {**met, "likely": [(0, 1), (0, 2), (1, 2)], "closer": [(0, 1)]}


def test_fingerprints_link_first_and_are_checked(spark, monkeypatch):
    """All that op2 links is tried before anything else, and what is no near copy stays apart."""
    rng = random.Random(21)
    base = invented(6, seed=22, low=300, high=300)
    texts = [changed(t, n, rng) for t in base for n in (0, 1, 1, 2, 30)]
    texts += [f"{'same ' * 90}{t}" for t in invented(2, seed=11, low=60, high=60)]
    seen = []

    def similar(pairs, rows, text, own=near_copies._similar):
        seen.append([tuple(r) for r in pairs.select("a", "b").collect()])
        place = {r["__row"]: r["text"] for r in rows.collect()}
        seen[-1] = [(texts.index(place[a]), texts.index(place[b])) for a, b in seen[-1]]
        return own(pairs, rows, text)

    monkeypatch.setattr(near_copies, "_similar", similar)
    assert kept(spark, texts) == first_ones(texts)
    prints = [simhash.fingerprint_of(t) for t in texts]
    want = [
        (a, b) for a in range(len(texts)) for b in range(a)
        if (prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS
    ]
    assert len(want) > 6
    assert classes_of(range(len(texts)), seen[0]) == classes_of(range(len(texts)), want)


def test_pairs_meet_a_few_times_however_much_they_share(spark):
    """Texts of 1,000 words that share nearly all first shingles, and some that share one passage."""
    rng = random.Random(23)
    base = invented(1, seed=24, low=1000, high=1000)[0]
    texts = [changed(base, 10, rng) for _ in range(12)]
    texts += [f"{base[:400]} {t}" for t in invented(4, seed=25, low=300, high=300)]
    common = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    rows = spark.createDataFrame(list(enumerate(texts)), "__row long, text string")
    rows = rows.select("__row", near_copies._described(rows["text"], common).alias("near"))
    rows = rows.select("__row", F.col("__row").alias("root"), "near.*")
    words = rows.select("*", F.posexplode("words").alias("at", "word"))
    rooted = words.select(
        "__row", "root", "size", "at", "word", *near_copies._flat_bits(), *near_copies._earlier_words()
    )
    met = near_copies._meetings(rooted).groupBy("a", "b").count().collect()
    sets = [set(near_copies.shingle_set(t).tolist()) for t in texts]
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                assert (a, b) in {(r["a"], r["b"]) for r in met}
    assert len(met) >= 40 and sum(r["count"] for r in met) <= 3 * len(met)
