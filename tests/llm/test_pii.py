import re

import pytest
from pyspark.sql import functions as F
from tests_llm_help import documents, invented

from factloom.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    turned = [int(d) for d in reversed(digits)]
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(turned)) % 10 == 0


def passes(kind, body):
    digits = re.sub("[^0-9]", "", body)
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(p) <= 255 for p in body.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def spans(text):
    return [
        (k, m.start(), m.end())
        for k, kind in enumerate(BASE)
        for m in re.finditer(BASE[kind], text or "")
        if passes(kind, m.group())
    ]


TRICKY = [
    "a@b.c_d@e.f g@h i@j..k l@m.n-o.p",
    "x.y+z%w@ex-ample.co.uk, été@exemple.fr 你a@b.cc",
    "1.2.3.4.5.6.7.8 999.1.1.1 255.255.255.255 0001.02.3.00255 1.2.3.256",
    "4111 1111 1111 1111, 4111-1111-1111-1112 and 4111111111111111 42",
    "card:4012888888881881. 6011000990139424-7 0000000000000000",
    "+1 (988) 555-2485 +44 20 7946 0958 +12 +1234567 +1234567890123456 ++15550001111",
    "tel +1.555.000.1111() and 5 +1 555 000 1111 2222 33",
    "1" * 3000,
    "1 " * 3000,
    "a" * 3000 + "@",
    "@" * 50 + "." * 50 + "+" * 50,
    "\U0001f600 a@b.cc \U0001f600 1.2.3.4 \U0001f600 +1 555 000 1111",
    "(555) 123-4567 mail me: jo (at) example (dot) org or 555.123.4567",
    " ".join(f"u{k}@mail{k % 7}.example.com 10.0.{k % 300}.{k % 256}" for k in range(700)),
]


@pytest.fixture(scope="module")
def texts():
    return TRICKY + ["", None, "plain words only"]


def test_base_spans_by_hand(spark, texts):
    out = pii.find_spans(documents(spark, texts), None)
    for row in out.collect():
        text = texts[row["doc_id"]]
        want = spans(text)
        assert [(s["kind"], s["start"], s["end"]) for s in row["base"]] == want
        assert row["spans"] == row["base"]
        assert all(text[s["start"] : s["end"]] == s["body"] for s in row["base"])


def cover(text, found):
    """Redaction by hand: overlapping spans become one, named by the first."""
    out, reach, merged = "", 0, []
    for start, end, kind in sorted((s, e, k) for k, s, e in found):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        out += text[reach:start] + f"[{pii.KINDS[kind].upper()}]"
        reach = end
    return out + text[reach:]


def test_redaction_by_hand(spark, texts):
    docs = documents(spark, texts).withColumns({"spans": F.lit(1), "base": F.lit(2)})
    out = pii.redact(docs.drop("spans", "base"), None)
    assert out.columns == documents(spark, []).columns if texts else True
    for row in out.collect():
        text = texts[row["doc_id"]]
        assert row["text"] == (None if text is None else cover(text, spans(text)))


def test_trees_add_and_never_take_away(spark):
    filler = invented(240, seed=6)
    texts = []
    for k, t in enumerate(filler):
        good = [f"joe{k}@mail.example.com", f"10.1.{k}.7", "4111 1111 1111 1111", f"+1 (555) 010-2{k:03d}"]
        bad = [f"order {k:03d} 4111 1111 1111 1112", f"v{k}.300.400.500", f"ref 12{k}-{k}-77", "x @ y"]
        texts.append(f"{t} {good[k % 4]} and {t} {bad[k % 4]} {t}")
    docs = documents(spark, texts)
    model = pii.train(docs)
    assert model is not None and len(model.trees) == pii.TREES
    for row in pii.find_spans(docs, model).collect():
        base = [(s["kind"], s["start"], s["end"]) for s in row["base"]]
        assert base == spans(texts[row["doc_id"]])
        every = [(s["kind"], s["start"], s["end"]) for s in row["spans"]]
        assert set(base) <= set(every) and every == sorted(every)


def test_planted_spans_are_found(spark):
    """A model that learned from other texts finds what the base patterns do not know."""
    filler = invented(900, seed=8)
    learn = []
    for k, t in enumerate(filler[:800]):
        good = [
            f"joe.b{k}@mail.example.com", f"{k % 224}.{k * 7 % 256}.{k % 250}.{k % 91}", "4111 1111 1111 1111", f"+1 (555) 010-2{k:03d}",
        ]
        bad = [f"order {k:03d} 4111 1111 1111 1112", f"v{k}.300.400.500", f"lot 12{k}-{k}", "x @ y"]
        learn.append(f"{t} {good[k % 4]} and {t} {bad[k // 4 % 4]} {t}")
    model = pii.train(documents(spark, learn))
    plants = [
        "mary (at) example (dot) org", "jo.w[at]site[dot]example[dot]net", "(517) 555-0938",
        "001 (212) 555-0199", "192[.]168[.]7[.]21", "4111.1111.1111.1111",
    ]
    clean = ["version 300.400.500.600", "4111.1111.1111.1113", "plain at words dot end"]
    texts = [f"{t} {plants[k % 6]} {t}" for k, t in enumerate(filler[800:860])]
    texts += [f"{t} {clean[k % 3]} {t}" for k, t in enumerate(filler[860:])]
    hit, wrong, missed = 0, 0, set()
    for row in pii.find_spans(documents(spark, texts), model).collect():
        k, bodies = row["doc_id"], {s["body"] for s in row["spans"]}
        base = [(s["kind"], s["start"], s["end"]) for s in row["base"]]
        assert base == spans(texts[k])
        assert all(texts[k][s["start"] : s["end"]] == s["body"] for s in row["spans"])
        hit += k < 60 and plants[k % 6] in bodies
        missed |= {plants[k % 6]} - bodies if k < 60 else set()
        wrong += k >= 60 and len(row["spans"]) > len(base)
    assert hit >= 54 and wrong <= 2, missed
    gone = pii.redact(documents(spark, texts[:6]), model).collect()
    assert sum(plants[r["doc_id"]] not in r["text"] for r in gone) >= 5


def test_candidates_beside_base_spans(spark):
    """Candidates keep their places when base spans are blanked out, whatever the text holds."""
    always = pii.Trees([0.0], [1.0], [0.0] * 4)
    text = "é \U0001f600 call (555) 123-4567 or +1 555 000 1111, a@b.org jo (at) example (dot) org"
    row = pii.find_spans(documents(spark, [text]), always).first()
    bodies = {s["body"] for s in row["spans"]}
    assert {"+1 555 000 1111", "a@b.org", "(555) 123-4567", "jo (at) example (dot) org"} <= bodies
    assert all(text[s["start"] : s["end"]] == s["body"] for s in row["spans"])


def test_many_candidates_in_one_text(spark):
    """Work in proportion to the text: forty thousand candidates."""
    always = pii.Trees([0.0], [1.0], [float("inf"), float("inf"), 0.0, float("inf")])
    text = "a 123-456 b " * 10_000
    row = pii.find_spans(documents(spark, [text]), always).selectExpr("size(spans) n").first()
    assert row["n"] == 10_000


def test_calibration():
    row = lambda k, m, n, g: {"kind": k, "margin": m, "n": n, "good": g}
    counts = [row(0, 2.0, 50, 50), row(0, 1.0, 10, 0), row(1, 1.0, 5, 5), row(2, 1.0, 90, 10)]
    assert pii.calibrated(counts) == [2.0, float("inf"), float("inf"), float("inf")]


def test_edges(edge_docs, no_docs):
    out = pii.find_spans(edge_docs, pii.train(edge_docs))
    assert out.count() == edge_docs.count()
    assert all(r["spans"] == [] for r in out.select("spans").collect())
    assert pii.find_spans(no_docs, pii.train(no_docs)).collect() == []
    kept = pii.redact_documents(edge_docs)
    assert kept.filter("text is null").count() == edge_docs.filter("text is null").count()
    assert kept.count() == edge_docs.count()


def test_trees_learn_from_all_documents(spark):
    """More documents than a sample would hold; only those that its hash order puts last have spans."""
    spans_of = ["mail joe{0}@x.example.com lot 12{0}-7", "at 10.1.{0}.7 or v{0}.300.400.500"]
    order = spark.range(8_600).orderBy(F.xxhash64("id"), "id").collect()
    texts = {r["id"]: spans_of[k % 2].format(k % 250) if k >= 8_000 else "plain words" for k, r in enumerate(order)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = pii.train(docs)
    assert model is not None and len(model.trees) == pii.TREES


def test_candidates_of_rows_without_a_key_and_of_repeated_keys_count(spark):
    text = "write to joe@x.example.com or call 555-123-4567 now"
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (8, None)], "doc_id long, text string")
    found = pii.candidates(docs).groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()
    assert {(r["kind"], r["label"]): r["n"] for r in found} == {(0, 1.0): 3, (2, 0.0): 3, (3, 0.0): 3}
