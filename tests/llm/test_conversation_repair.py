import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest

from factloom.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]")
GRAMMAR = re.compile(r"(s?(ua)+)?")
EMPTY = hashlib.sha256(b"").hexdigest()


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        if not WORD.search(text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append(None if WORD.findall(text)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Every way to edit, insertions of up to two rows at each place, judged by the grammar."""
    found = faults(rows)
    best = None

    def go(k, cost, audit, lines):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        initials = "".join(x[:1] or "?" for x, _ in lines)
        # Prefixes of the grammar only.
        if not re.fullmatch(r"s?(ua)*u?", initials):
            return
        for inserts in ([], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]):
            own = lines + [(r, "") for r in inserts]
            paid, told = cost + 2 * len(inserts), audit + "I" * len(inserts)
            if k == len(rows):
                if GRAMMAR.fullmatch("".join(x[:1] or "?" for x, _ in own)):
                    way = (paid, told, "\n".join(f"{r}:{t}" for r, t in own))
                    best = way if best is None or way < best else best
                continue
            _, role, text = rows[k]
            go(k + 1, paid + 3, told + "D", own)
            if found[k] not in ("blank", "duplicate"):
                extra = found[k] == "truncated"
                go(k + 1, paid + extra, told + "K", own + [(role, text)])
                for name in ("user", "assistant"):
                    go(k + 1, paid + 2 + extra, told + "R", own + [(name, text)])

    go(0, 0, "", [])
    return best


def slow_report(rows):
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", EMPTY)
    found = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, audit, text = cheapest(rows)
    counts = [found.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def made_conversations(count, seed, most=4):
    rng = random.Random(seed)
    for conv in range(count):
        turn = 0
        for _ in range(rng.randint(1, most)):
            turn += rng.choice([1, 1, 1, 2, 3])
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""])
            yield conv, turn, role, rng.choice(["Yes.", "No!", "Why?  ", "well", " \n", "", "ok \t", "Yes."])


def by_conversation(rows):
    order = sorted(rows, key=lambda r: (r[0], r[1]))
    return {c: [r[1:] for r in some] for c, some in groupby(order, key=lambda r: r[0])}


def reports(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("block", [512, 2])
def test_reports_by_brute_force(spark, monkeypatch, block):
    """Blocks of two rows put most conversations into several blocks."""
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = list(made_conversations(120, seed=6))
    got = reports(repair.repairs(spark.createDataFrame(rows, SCHEMA)))
    assert got == {c: slow_report(some) for c, some in by_conversation(rows).items()}


def test_each_ending_is_made_once(monkeypatch):
    made, real = [], repair.extended
    monkeypatch.setattr(repair, "extended", lambda t, c: made.append(c) or real(t, c))
    sigs = ["ua", "uaua", "saua", "-ua", "Ua", "u", "aU", "suA"]
    got = dict(repair.automaton(sorted(sigs, key=lambda s: s[::-1])))
    assert len(made) == len({s[k:] for s in sigs for k in range(len(s))})
    for sig in sigs:
        table = repair.EMPTY
        for letter in reversed(sig):
            table = real(table, letter)
        assert got[sig] == table


def slow_damage(conv, turn, role, text):
    conv, turn, role, text = (" " if x is None else x for x in (conv, turn, role, text))
    draw = zlib.crc32(f"{conv}:{turn}".encode()) % 20
    if draw == 1:
        text = ""
    if draw == 2:
        text = re.sub("[.!?]", "", text)
    if draw == 4:
        role = "user"
    return [(role, text)] * {0: 0, 3: 2}.get(draw, 1)


def test_damage_and_the_whole_query(spark):
    rows = [(c, t, r, x) for c, t, r, x in made_conversations(150, seed=7, most=3)]
    rows += [(None, 1, "user", "Hi."), (None, None, None, "Ho."), (900, None, "user", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = [
        (c, t, *x) for c, t, r, text in rows for x in slow_damage(c, t, r, text)
    ]
    got = sorted(map(str, repair.damaged(df).collect()))
    assert len(got) == len(kept)
    per = {}
    for c, t, r, x in sorted(kept, key=lambda k: (str(k[0]), k[1] is not None, k[1] or 0)):
        per.setdefault(c, []).append((t, r, x))
    want = {c: slow_report(per.get(c, [])) for c in {r[0] for r in rows}}
    assert reports(repair.repairs(repair.damaged(df), df)) == want


def test_one_long_conversation(spark):
    """Cut into many blocks, compared with one table over all its rows."""
    rng = random.Random(9)
    rows = [
        (1, t, rng.choice(["user", "assistant", "tool"]), f"text {t}" + rng.choice([".", ""]))
        for t in range(3000)
    ]
    rows = [(c, t, r, "same." if t % 3 == 0 else x) for c, t, r, x in rows]
    found = reports(repair.repairs(spark.createDataFrame(rows, SCHEMA).repartition(4)))[1]
    seen, table = set(), repair.EMPTY
    letters = []
    for _, _, role, text in rows:
        letter = role[0] if role[0] in "sua" else "o"
        letter = letter if text.endswith(".") else letter.upper()
        letters.append("-" if (role, text) in seen else letter)
        seen.add((role, text))
    for letter in reversed(letters):
        table = repair.extended(table, letter)
    ways = [
        (way[0] + 2 * len(repair.CLOSING[t]), way[1] + repair.CLOSING[t])
        for t, way in enumerate(table[repair.NOTHING])
        if way
    ]
    assert found[5:7] == min(ways)
    assert found[2] == letters.count("-")


def test_edge_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repairs(none).count() == 0
    rows = [(1, 1, "user", "a" * 200_000 + "."), (1, 1, "user", "a" * 200_000 + "."), (2, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 conv", "2 block", "3 seq", "4 sig", "5 mark")
    got = reports(repair.repairs(df))
    assert got[1][:7] == (0, 0, 1, 0, 1, 5, "KDI")
    assert got[2] == (0, 1, 0, 0, 0, 3, "D", EMPTY)
    assert reports(repair.repairs(none, df)) == {c: (0, 0, 0, 0, 0, 0, "", EMPTY) for c in (1, 2)}
