import random
import re
from collections import Counter

import pytest
from tests_llm_help import documents, invented

from factloom.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    seen = Counter(windows)
    hit = {k + o for k, w in enumerate(windows) if seen[w] > 1 for o in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
    }


def answers(df):
    return [
        (r["doc_id"], r["measures"].asDict(), r["base_failed"], r["broken_rules"], r["kept"])
        for r in df.collect()
    ]


def same(df, texts):
    found = answers(df)
    assert len(found) == len(texts)
    for key, counts, failed, broken, kept in found:
        want = slow_counts(texts[key])
        assert {c: counts[c] for c in want} == want
        few, again = want["n_words"] < 20, want["n_repeat_words"] * 100 > want["n_words"] * 30
        assert failed == (few or again)
        assert kept == (not failed and not broken)


def test_counts_by_brute_force(spark):
    rng = random.Random(3)
    texts = invented(20, seed=4)
    for _ in range(60):
        words = rng.choices("a b c the é 你好 #x *".split(), k=rng.randint(0, 60))
        gaps = rng.choices([" ", "\n", " \t", "\x0b", "\r\n", "\n\n"], k=len(words))
        texts.append("".join(w + g for w, g in zip(words, gaps, strict=True)))
    run = " ".join(f"w{k}" for k in range(9))
    texts += [f"{run} {run}", f"{run} x {run} y {run}", "one " * 400, "\x00 a\x00b $", None, "", " \n"]
    same(quality_rules.judged(documents(spark, texts)), texts)


def test_no_window_is_missed_when_hashes_agree(spark, monkeypatch):
    """With a hash that gives few values, windows are still compared as words."""
    from pyspark.sql import functions as F

    real = F.xxhash64
    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(3)))
    texts = [*invented(15, seed=5), "x " + "a b c d e f g h " * 2]
    same(quality_rules.judged(documents(spark, texts)), texts)


@pytest.mark.parametrize(
    ("text", "name"),
    [
        (" ".join(f"the of words{k}" for k in range(20)), None),
        (" ".join(f"abcdefghijklmnop{k}" for k in range(30)), "word_length"),
        (" ".join(f"another{k} ##" for k in range(20)), "symbols"),
        (" ".join(f"word{k}" for k in range(60)), "stop_words"),
        ("\n".join(f"- the line of words{k}" for k in range(30)), "bullet_lines"),
        ("\n".join(f"the line of {k}..." for k in range(30)), "ellipsis_lines"),
        ("\n".join(["same"] * 30 + [f"and the line {k}" for k in range(20)]), "repeated_lines"),
    ],
)
def test_each_rule(spark, text, name):
    (found,) = answers(quality_rules.judged(documents(spark, [text])))
    assert found[3] == ([name] if name else [])
    assert found[4] == (name is None and not found[2])


def test_other_languages_need_no_stop_words(spark):
    docs = documents(spark, [" ".join(f"word{k}" for k in range(60))])
    assert answers(quality_rules.judged(docs.replace("en", "xx", "lang")))[0][4]
    assert answers(quality_rules.judged(docs.drop("lang")))[0][4]


def test_edge_rows(spark, edge_docs, edge_texts, no_docs):
    names = [*edge_docs.columns, "measures", "kept", "broken_rules", "base_failed"]
    docs = edge_docs.selectExpr("*", "1 measures", "2 kept", "3 broken_rules", "4 base_failed")
    out = quality_rules.judged(docs)
    assert sorted(out.columns) == sorted(names)
    got = {r["doc_id"]: r["measures"]["n_words"] for r in out.collect()}
    assert out.count() == edge_docs.count()
    assert all(got[k] == len(WORD.findall(t or "")) for k, t in enumerate(edge_texts))
    assert quality_rules.judged(no_docs).count() == 0


def test_long_text(spark):
    text = " ".join(f"w{k % 997}" for k in range(60_000))
    ((_, counts, failed, _, kept),) = answers(quality_rules.judged(documents(spark, [text])))
    assert counts["n_repeat_words"] == counts["n_words"] == 60_000
    assert failed and not kept
