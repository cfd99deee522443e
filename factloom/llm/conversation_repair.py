"""Conversation structure repair with a suffix-shared automaton.

Each row of a conversation becomes one letter: its role's initial and whether it must go or is
truncated. Spark deals the distinct signatures by range of their reversed letters, so signatures that
end alike come one after the other; each node of the automaton is one such ending, made once for all
conversations, and holds the cheapest way through it from each grammar state and its audit.

A conversation may hold any share of all rows. It is cut into blocks of at most ``BLOCK`` rows; a
node's table tells the cost for every state before and after the block, and one pass over a
conversation's blocks from the end, a few numbers each, chooses among them.
"""

from __future__ import annotations

import hashlib
from functools import cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import ROW, numbered
from factloom.session import cut_lineage

SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
BLOCK = 512

#: Grammar states of ``(s?(ua)+)?``: nothing yet, after system, after user, after assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: The state that an inserted or renamed row leads to, and the role it gets.
FOLLOWING = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEPT = {
    "s": {NOTHING: SYSTEM},
    "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
#: Inserts that end a conversation in each state.
CLOSING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
GONE = "-"


# ---- the automaton ---------------------------------------------------------------------------


@cache
def moves(letter: str) -> tuple[tuple[tuple[int, int, str], ...], ...]:
    """For each state before a row: states after it, cost and edits, inserts before the row included."""
    out = []
    for state in range(STATES):
        best: dict[int, tuple[int, str]] = {}
        at = state
        for inserts in range(3):
            ways = [(at, 3, "D")]
            if letter != GONE:
                extra = letter.isupper()
                ways.append((FOLLOWING[at], 2 + extra, "R"))
                after = KEPT.get(letter.lower(), {}).get(at)
                if after is not None:
                    ways.append((after, 0 + extra, "K"))
            for after, cost, edit in ways:
                way = (2 * inserts + cost, "I" * inserts + edit)
                best[after] = min(best.get(after, way), way)
            at = FOLLOWING[at]
        out.append(tuple((after, *way) for after, way in best.items()))
    return tuple(out)


Table = tuple[tuple[tuple[int, str] | None, ...], ...]
EMPTY: Table = tuple(tuple((0, "") if p == t else None for t in range(STATES)) for p in range(STATES))


def extended(table: Table, letter: str) -> Table:
    """The table of an ending with one more letter in front.

    Edits of the same rows are no prefixes of each other, so the least of two is decided within
    them, and a least way is made of least ways.
    """
    out = []
    for ways in moves(letter):
        row: list[tuple[int, str] | None] = [None] * STATES
        for after, cost, edits in ways:
            for end, rest in enumerate(table[after]):
                if rest is not None:
                    way = (cost + rest[0], edits + rest[1])
                    if row[end] is None or way < row[end]:
                        row[end] = way
        out.append(tuple(row))
    return tuple(out)


def automaton(signatures, node=EMPTY):
    """``signature, table`` for signatures in the order of their reversed letters.

    Only the path to the last signature is held. An ending shared with it is not made again.
    """
    path, last = [node], ""
    for signature in signatures:
        turned = signature[::-1]
        del path[len(commonprefix([last, turned])) + 1 :]
        for letter in turned[len(path) - 1 :]:
            path.append(extended(path[-1], letter))
        last = turned
        yield signature, path[-1]


_NODES = "sig string, costs array<int>, ranks array<int>, audits array<string>"


def _flat(batches):
    names = [f.split()[0] for f in _NODES.split(", ")]
    kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]

    def signatures():
        for batch in batches:
            yield from batch.column(0).to_pylist()

    def out(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
        )

    rows = []
    for signature, table in automaton(signatures()):
        ways = [way or (None, None) for row in table for way in row]
        order = {a: k for k, a in enumerate(sorted({a for _, a in ways if a is not None}))}
        rows.append(
            (signature, [c for c, _ in ways], [order.get(a) for _, a in ways], [a for _, a in ways])
        )
        if len(rows) == 200:
            yield out(rows)
            rows = []
    if rows:
        yield out(rows)


def signature_tables(blocks: DataFrame) -> DataFrame:
    """``sig, costs, ranks, audits``, four states before by four after, for each distinct ``sig``."""
    sigs = blocks.select("sig").distinct().withColumn("turned", F.reverse("sig"))
    sigs = sigs.repartitionByRange("turned").sortWithinPartitions("turned")
    return sigs.select("sig").mapInArrow(_flat, _NODES)


def _chosen(batches):
    """The states before and after each block, as one number, of the cheapest way.

    Blocks come from the last of a conversation to its first. Of each only the four best states
    after it are kept until its conversation is whole.
    """
    name, blocks, picks, best = None, [], bytearray(), None

    def walked():
        state = NOTHING
        for k in range(len(blocks) - 1, -1, -1):
            end = picks[STATES * k + state]
            yield name, blocks[k], STATES * state + end
            state = end

    def out(rows):
        kinds = (pa.string(), pa.int64(), pa.int32())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["conv", "block", "way"])

    rows = []
    for batch in batches:
        for conv, block, costs, ranks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != name or best is None:
                for row in walked():
                    rows.append(row)
                    if len(rows) == 5000:
                        yield out(rows)
                        rows = []
                name, blocks, picks = conv, [], bytearray()
                best = [(len(CLOSING[s]) * COSTS["I"], len(CLOSING[s])) for s in range(STATES)]
            ways = [
                min(
                    (costs[STATES * p + t] + best[t][0], ranks[STATES * p + t], best[t][1], t)
                    for t in range(STATES)
                    if costs[STATES * p + t] is not None
                )
                for p in range(STATES)
            ]
            order = {r: k for k, r in enumerate(sorted({w[1:3] for w in ways}))}
            best = [(w[0], order[w[1:3]]) for w in ways]
            picks.extend(w[3] for w in ways)
            blocks.append(block)
    rows.extend(walked())
    if rows:
        yield out(rows)


# ---- rows ------------------------------------------------------------------------------------


def damaged(rows: DataFrame, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """The contract's damage, by crc32 of ``conv:turn`` modulo 20; nulls count as one space.

    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 doubles it, 4 makes it the user's.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn, role, text)]
    draw = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    texts = F.when(draw == 1, "").when(draw == 2, F.translate(shown[3], ENDS, "")).otherwise(shown[3])
    copies = F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1)
    return rows.select(
        F.col(conv).alias(conv),
        F.col(turn).alias(turn),
        F.when(draw == 4, "user").otherwise(shown[2]).alias(role),
        texts.alias(text),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("__copy"),
    ).drop("__copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in one order of all conversations, numbered in ``seq``.

    Tasks take ranges of the order, so a large conversation lies in many of them.
    """
    order = ["conv", F.col("turn").asc_nulls_first(), "mark", "role", "text", ROW]
    dealt = numbered(rows).withColumn("mark", F.xxhash64("role", "text"))
    dealt = dealt.repartitionByRange("conv", F.col("turn").asc_nulls_first(), "mark", ROW)
    dealt = dealt.sortWithinPartitions(*order)
    return cut_lineage(dealt.drop("mark").withColumn("seq", F.monotonically_increasing_id()), "turns")


def _blocks(rows: DataFrame) -> DataFrame:
    """``conv, block, lines, sig``: at most ``BLOCK`` neighbouring rows of a conversation each."""
    rows = _ordered(rows)
    # A row is a duplicate unless it is the first of its conversation, role and text.
    first = rows.groupBy("conv", "role", F.sha2("text", 256)).agg(F.min("seq").alias("seq"))
    line = F.struct("seq", "turn", "role", "text")
    both = rows.select("conv", "seq", line.alias("line"), F.lit(None).cast("long").alias("first"))
    both = both.unionByName(
        first.select("conv", "seq", F.lit(None).alias("line"), F.col("seq").alias("first"))
    )
    block = F.expr(f"seq div {BLOCK}").alias("block")
    grouped = both.groupBy("conv", block).agg(
        F.sort_array(F.collect_list("line")).alias("lines"), F.collect_list("first").alias("firsts")
    )

    def told(x: Column) -> Column:
        bare = F.rtrim(x["text"], F.lit(SPACES))
        fault = (
            F.when(bare == "", "blank")
            .when(~F.array_contains("firsts", x["seq"]), "duplicate")
            .when(~F.right(bare, F.lit(1)).isin(*ENDS), "truncated")
        )
        return F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text"), fault.alias("fault"))

    def letter(x: Column) -> Column:
        first = F.left(x["role"], F.lit(1))
        known = F.when(first.isin(*KEPT), first).otherwise("o")
        return (
            F.when(x["fault"].isin("blank", "duplicate"), GONE)
            .when(x["fault"] == "truncated", F.upper(known))
            .otherwise(known)
        )

    lines = grouped.select("conv", "block", F.transform("lines", told).alias("lines"))
    sig = F.array_join(F.transform("lines", letter), "")
    return cut_lineage(lines.withColumn("sig", sig), "blocks")


_REPORT = (
    "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long,"
    " audit string, repaired_sha256 string"
)
LEGAL = {"su", "ua", "au"}


class _Report:
    """What is told of one conversation, row by row; no more than its audit is held."""

    def __init__(self, conv):
        self.conv, self.hash, self.empty = conv, hashlib.sha256(), True
        self.audit, self.cost, self.state = [], 0, NOTHING
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.low = self.high = self.last = None
        self.turns = self.illegal = 0
        self.before = None

    def line(self, role, text=""):
        self.hash.update((f"{role}:{text}" if self.empty else f"\n{role}:{text}").encode())
        self.empty = False

    def add(self, lines, audit):
        self.audit.append(audit)
        rows = iter(lines)
        for edit in audit:
            self.cost += COSTS[edit]
            row = None if edit == "I" else next(rows)
            if row is not None:
                self.seen(row)
                if edit == "D":
                    continue
                self.cost += row["fault"] == "truncated"
            if edit == "K":
                self.state = KEPT[row["role"][0]][self.state]
                self.line(row["role"], row["text"])
            else:
                self.state = FOLLOWING[self.state]
                self.line(NAMES[self.state], row["text"] if row else "")

    def seen(self, row):
        if row["fault"]:
            self.faults[row["fault"]] += 1
        turn, initial = row["turn"], row["role"][:1]
        if turn is not None and turn != self.last:
            self.low = turn if self.low is None else self.low
            self.high = self.last = turn
            self.turns += 1
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial

    def told(self):
        self.add([], CLOSING[self.state])
        gaps = 0 if self.low is None else int(self.high - self.low) + 1 - self.turns
        counts = (gaps, *self.faults.values(), self.illegal, self.cost)
        return self.conv, *counts, "".join(self.audit), self.hash.hexdigest()


def _reports(batches):
    names = [f.split()[0] for f in _REPORT.split(", ")]
    text, number = pa.string(), pa.int64()
    kinds = [text, *[number] * 6, text, text]

    def out(rows):
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names)

    current, rows = None, []
    for batch in batches:
        for conv, lines, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if current is None or current.conv != conv:
                if current is not None:
                    rows.append(current.told())
                current = _Report(conv)
            current.add(lines, audit)
            if len(rows) == 1000:
                yield out(rows)
                rows = []
    if current is not None:
        rows.append(current.told())
    if rows:
        yield out(rows)


def repairs(
    rows: DataFrame,
    every: DataFrame | None = None,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows are taken by turn, null turns first; rows of one turn follow a hash of role and text. A null
    conversation, role or text is one space, so a null text is blank and a null role needs another.
    A role counts by its first letter; an empty or unknown one can only be renamed or deleted.
    Conversations of ``every`` without rows have zeros, an empty audit and the empty text's digest.
    An empty table gives an empty one; columns not named are not looked at.
    """
    as_text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, role, text)]
    plain = rows.select(
        as_text[0].alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        as_text[1].alias("role"),
        as_text[2].alias("text"),
    )
    blocks = _blocks(plain)
    nodes = cut_lineage(signature_tables(blocks), "nodes")
    tables = blocks.select("conv", "block", "sig").join(nodes, "sig").drop("sig")
    tables = cut_lineage(tables, "tables")
    dealt = tables.select("conv", "block", "costs", "ranks").repartition("conv")
    ways = dealt.sortWithinPartitions("conv", F.desc("block")).mapInArrow(
        _chosen, "conv string, block long, way int"
    )
    edits = tables.select("conv", "block", "audits").join(ways, ["conv", "block"])
    edits = edits.select("conv", "block", F.get("audits", F.col("way")).alias("audit"))
    lines = blocks.join(edits, ["conv", "block"]).select("conv", "block", "lines", "audit")
    lines = lines.repartition("conv").sortWithinPartitions("conv", "block")
    found = lines.select("conv", "lines", "audit").mapInArrow(_reports, _REPORT)

    ids = (rows if every is None else every).select(F.col(conv).alias("id")).distinct()
    ids = ids.withColumn("conv", F.coalesce(F.col("id").cast("string"), F.lit(" ")))
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    counts = "gaps blank duplicate truncated illegal cost".split()
    out = ids.join(found, "conv", "left").na.fill(0, counts).na.fill(nothing)
    return out.select(F.col("id").alias(conv), *counts, *nothing)
