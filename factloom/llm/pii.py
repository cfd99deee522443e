"""Personal data: base patterns, wider candidates, and boosted trees that choose among these.

Base spans of four kinds are found by patterns with checks and always stay. High-recall generators
propose more spans, which may overlap: written-out addresses, local phone numbers, grouped digits,
loose dotted numbers. Gradient boosted trees look at the format of a candidate and at the words
around it; thresholds per kind, calibrated on held-out candidates, select the spans that are added.

The trees learn from all texts, in which confirmed spans are written in ways that the base patterns
do not know: spelled-out signs, no country code, other separators. These are the positives. Some of
them are spoilt, so that a check fails, and count as negatives like all other candidates. Equal
candidates are counted and fitted once with their count as weight, so the fit grows with the formats
there are and not with the texts. Where texts are judged, base spans are blanked out first, so
candidates never touch them.

Everything works on the arrays of one row with built-in functions, the trees included, which are
written as CASE expressions: no shuffle, no Python. Arrays are worked on in blocks, so that a text
with very many spans costs time in proportion.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: Trees, depth of a tree, and one of so many documents held out.
TREES, DEPTH, HELD_OUT = 20, 4, 4
#: Share of chosen candidates that must be confirmed on held-out ones, and the least of these.
PRECISION, LEAST_HELD = 0.99, 20
BLOCK, CONTEXT = 64, 24

#: The base patterns. A run that cannot match from its first character cannot match from a later
#: one, so starts within runs are skipped and nothing is tried twice.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has no span of the kind.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
GENERATORS = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9][a-z0-9._%+-]{0,63}+(?:@|\x20?[(\[{](?:at|@)[)\]}]\x20?)"
    r"[a-z0-9-]{1,63}+(?:(?:\.|\x20?[(\[{](?:dot|\.)[)\]}]\x20?)[a-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9.])[0-9]{1,4}+(?:(?:[.]|[\[({][.][\])}]|\x20dot\x20)[0-9]{1,4}+){2,5}+(?![.]?[0-9])",
    "card": r"(?<![0-9])[0-9]{3,6}+(?:[\x20.-]?[0-9]{2,7}+){1,5}+(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)?(?:[0-9]{1,3}+[\x20.-]?)?\(?[0-9]{2,5}+\)?(?:[\x20./-][0-9]{2,5}+){1,4}+(?![0-9])",
}
CUES = {
    "email": "mail|contact|write|reach",
    "ip": "ip|host|server|address|client",
    "card": "card|visa|credit|debit|payment",
    "phone": "phone|call|tel|mobile|fax|dial",
}
SPAN = "struct<kind:int,start:int,end:int,body:string>"
PLACED = "struct<start:int,end:int,body:string>"
CANDIDATE = "struct<kind:int,start:int,end:int,body:string,before:string,after:string>"
#: One of so many confirmed spans is spoilt when texts to learn from are rewritten.
SPOILT = 4


PART = "struct<gap:int,size:int,body:string,tail:string,head:string>"


def _matches(text: Column, pattern: str, around: bool) -> Column:
    """``gap, size, body`` of all matches, leftmost first: the length of the text since the match
    before, the match's own length, and the match; the last entry has no match. With ``around`` also
    the ``tail`` and ``head`` of the text since the match before."""

    def part(between, body):
        tail = F.lower(F.right(between, F.lit(CONTEXT))) if around else F.lit(None).cast("string")
        head = F.left(between, F.lit(1)) if around else F.lit(None).cast("string")
        return F.struct(
            F.length(between).alias("gap"),
            F.coalesce(F.length(body), F.lit(0)).alias("size"),
            body.alias("body"),
            tail.alias("tail"),
            head.alias("head"),
        )

    return F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0), part
    )


def _placed(parts: Column) -> Column:
    """``start, end, body`` of matches, in code points from 0; ``parts`` must be a plain column.

    Lengths are summed within blocks, then over blocks.
    """
    empty = F.array().cast(f"array<{PLACED}>")
    begin = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(state, part):
        start = state["at"] + part["gap"]
        end = start + part["size"]
        span = F.struct(start.alias("start"), end.alias("end"), part["body"].alias("body"))
        return F.struct(
            end.alias("at"),
            F.when(part["body"].isNull(), state["spans"])
            .otherwise(F.concat(state["spans"], F.array(span)))
            .alias("spans"),
        )

    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(parts) / BLOCK).cast("int") - 1)),
        lambda k: F.aggregate(F.slice(parts, k * BLOCK + 1, BLOCK), begin, step),
    )
    shifted = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{PLACED}>>").alias("spans")),
        lambda state, block: F.struct(
            (state["at"] + block["at"]).alias("at"),
            F.concat(
                state["spans"],
                F.array(
                    F.transform(
                        block["spans"],
                        lambda s: F.struct(
                            (s["start"] + state["at"]).alias("start"),
                            (s["end"] + state["at"]).alias("end"),
                            s["body"].alias("body"),
                        ),
                    )
                ),
            ).alias("spans"),
        ),
    )
    return F.flatten(shifted["spans"])


def luhn(digits: Column) -> Column:
    """Whether up to 32 digits pass the check sum; leading zeros change nothing."""
    padded = F.lpad(digits, 32, "0")
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(32)),
        F.lit(0),
        lambda sum_, k: sum_
        + F.when(
            k % 2 == 1,
            F.substr(F.translate(padded, "0123456789", "0246813579"), k, F.lit(1)).cast("int"),
        ).otherwise(F.substr(padded, k, F.lit(1)).cast("int")),
    )
    return total % 10 == 0


def digits_of(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _octets(body: Column) -> Column:
    """Whether all dotted parts are numbers of at most 255, leading zeros aside."""

    def fits(part):
        short = F.regexp_replace(part, "^0+", "")
        return (F.length(part) > 0) & (
            (F.length(short) < 3) | ((F.length(short) == 3) & (short <= "255"))
        )

    return F.forall(F.split(body, r"\."), fits)


def _passes(kind: str, body: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets(body)
    size = F.length(digits_of(body))
    if kind == "card":
        return size.between(16, 19) & luhn(digits_of(body))
    return size.between(8, 15)


def _checked(kind: str):
    return lambda s: _passes(kind, s["body"])


def _kind_spans(df: DataFrame, text: str, patterns: dict[str, str], prefix: str) -> DataFrame:
    """A column of spans per kind: ``prefix`` and the kind's name."""
    none = F.array().cast(f"array<{PART}>")
    raw = {}
    for kind, pattern in patterns.items():
        some = F.col(text).rlike("[0-9]") if kind != "email" else F.col(text).rlike("@|(?i)\\bat\\b")
        mark = NEEDED[kind] if patterns is BASE else None
        if mark:
            some = F.contains(F.col(text), F.lit(mark))
        raw[f"{prefix}{kind}"] = F.when(some, _matches(F.col(text), pattern, patterns is GENERATORS)).otherwise(none)
    df = df.withColumns(raw)
    if patterns is GENERATORS:
        df = df.withColumns({f"{name}_around": _around(F.col(name)) for name in raw})
    return df.withColumns({name: _placed(F.col(name)) for name in raw})


def _around(parts: Column) -> Column:
    """``before, after`` of each match, from the pieces of text between matches."""
    count = F.size(parts) - 1
    both = F.zip_with(
        F.slice(parts, F.lit(1), count),
        F.slice(parts, F.lit(2), count),
        lambda x, y: F.struct(x["tail"].alias("before"), y["head"].alias("after")),
    )
    return F.when(count > 0, both)


def with_base_spans(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``__base``: checked spans by kind, then by start. ``text`` must not be null."""
    df = _kind_spans(df, text, BASE, "__base_")
    kinds = []
    for k, kind in enumerate(KINDS):
        spans = F.filter(F.col(f"__base_{kind}"), _checked(kind))
        kinds.append(_as_spans(spans, k))
    return df.withColumn("__base", F.concat(*kinds)).drop(*[f"__base_{k}" for k in KINDS])


def _as_spans(spans: Column, kind: int) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(F.lit(kind).alias("kind"), s["start"], s["end"], s["body"]),
    )


def with_candidates(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``__all``: spans of all generators, with what stands before and after them.

    What stands around a candidate is cut from the pieces between the candidates of its kind.
    """
    df = _kind_spans(df, text, GENERATORS, "__wide_")

    def of_kind(k: int, kind: str) -> Column:
        spans, none = F.col(f"__wide_{kind}"), F.array().cast(f"array<{CANDIDATE}>")
        both = F.zip_with(
            spans,
            F.col(f"__wide_{kind}_around"),
            lambda s, c: F.struct(
                F.lit(k).alias("kind"), s["start"], s["end"], s["body"], c["before"], c["after"]
            ),
        )
        return F.when(F.size(spans) > 0, both).otherwise(none)

    extra = [f"__wide_{kind}{end}" for end in ("", "_around") for kind in KINDS]
    whole = F.concat(*[of_kind(k, kind) for k, kind in enumerate(KINDS)])
    return df.withColumn("__all", whole).drop(*extra)


def features(c: Column) -> list[Column]:
    """Numbers that describe the format of a candidate and what stands around it."""
    body, digits = c["body"], digits_of(c["body"])
    size = F.length(digits)
    number = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    out = [number(c["kind"] == k) for k in range(len(KINDS))]
    out += [
        number(F.length(body)),
        number(size),
        number(luhn(F.right(digits, F.lit(32)))),
        number(F.length(F.regexp_replace(body, "[^.]", ""))),
        number(F.length(F.regexp_replace(body, r"[^\x20-]", ""))),
        number(F.length(F.regexp_replace(body, "[^(@]", ""))),
        number(body.startswith("+")),
        number(body.contains("@")),
        number((size > 0) & (size <= 40) & _octets(F.regexp_replace(body, "[^0-9]+", "."))),
        number(c["before"].rlike(r"[\p{L}0-9]$")),
        number(c["after"].rlike(r"[\p{L}0-9]")),
    ]
    out += [number(c["before"].rlike(cue)) for cue in CUES.values()]
    return out


class Trees(NamedTuple):
    """Trees as nested ``(feature, threshold, left, right)`` or a leaf's number, with weights."""

    trees: list
    weights: list[float]
    thresholds: list[float]


def _tree(node) -> float | tuple:
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return (
        split.featureIndex(),
        float(split.threshold()),
        _tree(node.leftChild()),
        _tree(node.rightChild()),
    )


def _case(node: float | tuple, values: Column) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    feature, threshold, left, right = node
    return F.when(values[feature] <= threshold, _case(left, values)).otherwise(_case(right, values))


def margin(model: Trees, values: Column) -> Column:
    """The sum of all trees for an array of features."""
    total = F.lit(0.0)
    for tree, weight in zip(model.trees, model.weights, strict=True):
        total = total + _case(tree, values) * F.lit(weight)
    return total


def _written_otherwise(kind: Column, body: Column, draw: Column) -> Column:
    """A span as people write it whom the base patterns do not know; spoilt for one draw of a few."""
    spoil = draw % SPOILT == 0
    way = F.shiftright(draw, 8) % 3

    def one_of(*ways: Column) -> Column:
        return F.when(way == 0, ways[0]).when(way == 1, ways[1]).otherwise(ways[2])

    name, domain = F.substring_index(body, "@", 1), F.substring_index(body, "@", -1)
    email = one_of(
        F.concat(name, F.lit(" (at) "), F.replace(domain, F.lit("."), F.lit(" (dot) "))),
        F.concat(name, F.lit("[at]"), F.replace(domain, F.lit("."), F.lit("[dot]"))),
        F.concat(name, F.lit("(at)"), domain),
    )
    numbers = F.when(spoil, F.regexp_replace(body, "^[0-9]+", "300")).otherwise(body)
    ip = one_of(*[F.replace(numbers, F.lit("."), F.lit(d)) for d in ("[.]", "(.)", " dot ")])
    digits = digits_of(body)
    last = F.right(digits, F.lit(1))
    other = F.concat(F.left(digits, F.length(digits) - 1), F.translate(last, "0123456789", "1234567890"))
    card = F.when(spoil, other).otherwise(digits)
    card = F.regexp_replace(card, "([0-9]{4})(?=[0-9])", "$1.")
    local = F.regexp_replace(body, r"^\+[0-9]{1,3}[\x20.-]*", "")
    phone = one_of(local, F.regexp_replace(body, r"^\+", "00"), F.translate(local, "-.", "  "))
    return F.when(kind == 0, email).when(kind == 1, ip).when(kind == 2, card).otherwise(phone)


def rewritten(df: DataFrame, text: str) -> DataFrame:
    """``df``, with ``__base``, with its spans written otherwise; ``__good`` lists those not spoilt."""

    def drawn(s):
        return F.pmod(F.xxhash64(s["kind"], s["start"], s["body"]), F.lit(1 << 20))

    good = F.filter("__base", lambda s: (drawn(s) % SPOILT != 0) | s["kind"].isin(0, 3))
    good = F.transform(
        good, lambda s: F.concat(s["kind"].cast("string"), _written_otherwise(s["kind"], s["body"], drawn(s)))
    )
    df = df.withColumns({"__good": good, "__merged": merged_spans(F.col("__base"))})

    def fill(s, body):
        draw = F.pmod(F.xxhash64(s["kind"], s["start"], body), F.lit(1 << 20))
        return _written_otherwise(s["kind"], body, draw)

    return df.withColumn(text, replaced(F.col(text), F.col("__merged"), fill)).drop("__merged")


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``held, kind, label, values, n``: the candidates of all rewritten texts, equal ones counted.

    A candidate is positive if it is a confirmed span, written otherwise and not spoilt. Rows of one
    key are held out together, those without a key by their text.
    """
    named = F.when(F.col(key).isNull(), F.xxhash64(text, F.lit("held"))).otherwise(
        F.xxhash64(key, F.lit("held"))
    )
    rows = docs.select(
        (F.pmod(named, F.lit(HELD_OUT)) == 0).alias("held"),
        F.coalesce(text, F.lit("")).alias("text"),
    )
    rows = rewritten(with_base_spans(rows, "text"), "text")
    # Exploded, so that the text is not rewritten again for each generator.
    once = F.explode(F.array(F.struct("text", "__good"))).alias("once")
    rows = with_candidates(rows.select("held", once).select("held", "once.*"), "text")
    found = rows.select("held", "__good", F.explode("__all").alias("c"))
    body = F.concat(F.col("c.kind").cast("string"), F.col("c.body"))
    return (
        found.select(
            "held",
            F.col("c.kind").alias("kind"),
            F.array_contains("__good", body).cast("double").alias("label"),
            F.array(*features(F.col("c"))).alias("values"),
        )
        .groupBy("held", "kind", "label", "values")
        .agg(F.count("*").cast("double").alias("n"))
    )


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Trees | None:
    """Trees from the ``candidates`` of all documents.

    Without candidates of both sorts there are no trees, and nothing is added to the base spans.
    """
    found = cut_lineage(candidates(docs, key, text), "candidates")
    fit = found.filter("not held")
    sorts = fit.agg(F.min("label"), F.max("label")).first()
    if tuple(sorts) != (0.0, 1.0):
        return None
    size = len(features(F.lit(None).cast(CANDIDATE)))
    wide = [F.col("values")[k].alias(f"f{k}") for k in range(size)]
    joined = VectorAssembler(
        inputCols=[f"f{k}" for k in range(size)], outputCol="features"
    ).transform(fit.select("label", "n", *wide))
    boosted = GBTClassifier(
        maxIter=TREES, maxDepth=DEPTH, seed=7, cacheNodeIds=False, weightCol="n"
    ).fit(joined)
    trees = [_tree(tree._java_obj.rootNode()) for tree in boosted.trees]
    model = Trees(trees, list(boosted.treeWeights), [])
    held = found.filter("held").select(
        "kind", F.round(margin(model, F.col("values")), 6).alias("margin"), "label", "n"
    )
    counts = held.groupBy("kind", "margin").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("good")
    )
    return model._replace(thresholds=calibrated(counts.collect()))


def calibrated(counts: list) -> list[float]:
    """Per kind the least margin above which enough held-out candidates are confirmed.

    A kind with too few held-out candidates, or none that hold, gets no additions.
    """
    out = []
    for kind in range(len(KINDS)):
        best, n, good = math.inf, 0, 0.0
        own = sorted((r for r in counts if r["kind"] == kind), key=lambda r: -r["margin"])
        for row in own:
            n, good = n + row["n"], good + row["good"]
            if n >= LEAST_HELD and good >= PRECISION * n:
                best = row["margin"]
        out.append(best)
    return out


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    name = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":",
                F.element_at(name, s["kind"] + 1),
                s["start"].cast("string"),
                s["end"].cast("string"),
            ),
        ),
        ",",
    )


def find_spans(docs: DataFrame, model: Trees | None, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: checked spans, and these with the chosen candidates.

    Both are arrays of kind (a place in ``KINDS``), start, end (exclusive, in code points) and body,
    by kind and then start, in place of columns of those names. A null text has no spans; each row
    is read on its own, whatever repeats.
    """
    kept = [c for c in docs.columns if c not in ("base", "spans")]
    df = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    df = with_base_spans(df, "__text")
    chosen = F.array().cast(f"array<{SPAN}>")
    live = [k for k, t in enumerate(model.thresholds) if t < math.inf] if model else []
    if live:
        # Blanked out, base spans are in no candidate; the text keeps its length.
        df = df.withColumn("__merged", merged_spans(F.col("__base")))
        blank = replaced(F.col("__text"), F.col("__merged"), lambda s, body: F.repeat(F.lit("\x01"), F.length(body)))
        df = df.withColumn("__text", F.when(F.size("__base") > 0, blank).otherwise(F.col("__text")))
        df = with_candidates(df.drop("__merged"), "__text")
        df = df.withColumn("__all", F.filter("__all", lambda c: c["kind"].isin(live)))
        least = F.array(*[F.lit(float(t)) for t in model.thresholds])
        valued = F.transform(
            "__all", lambda c: F.struct(c.alias("c"), F.array(*features(c)).alias("v"))
        )
        picked = F.filter(
            valued,
            # Rounded as the thresholds are.
            lambda x: F.round(margin(model, x["v"]), 6) >= F.element_at(least, x["c"]["kind"] + 1),
        )
        chosen = F.transform(
            picked,
            lambda x: F.struct(
                x["c"]["kind"].alias("kind"),
                x["c"]["start"].alias("start"),
                x["c"]["end"].alias("end"),
                x["c"]["body"].alias("body"),
            ),
        )
    df = df.withColumn("__more", chosen)
    both = F.array_sort(F.concat("__base", "__more"))
    spans = F.when(F.size("__more") > 0, both).otherwise(F.col("__base"))
    return df.select(*kept, F.col("__base").alias("base"), spans.alias("spans"))


def kind_count(spans: Column, kind: str) -> Column:
    place = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == place)).cast("long")


def merged_spans(spans: Column) -> Column:
    """``kind, start, end`` by start; spans that overlap become one, of the first one's kind.

    A span of kind -1 and no length at the beginning comes first.
    """
    span = "struct<kind:int,start:int,end:int>"
    ordered = F.array_sort(
        F.transform(
            spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        )
    )
    return F.aggregate(
        ordered,
        F.struct(
            F.array().cast(f"array<{span}>").alias("done"),
            F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end")).alias("last"),
        ),
        lambda a, s: F.when(
            s["start"] < a["last"]["end"],
            F.struct(
                a["done"],
                F.struct(
                    a["last"]["kind"].alias("kind"),
                    a["last"]["start"].alias("start"),
                    F.greatest(a["last"]["end"], s["end"]).alias("end"),
                ).alias("last"),
            ),
        ).otherwise(
            F.struct(
                F.concat(a["done"], F.array(a["last"])).alias("done"),
                F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")).alias(
                    "last"
                ),
            )
        ),
        lambda a: F.concat(a["done"], F.array(a["last"])),
    )


def replaced(whole: Column, merged: Column, fill) -> Column:
    """The text with each of ``merged_spans`` replaced by ``fill(span, body)``.

    Spans are replaced in blocks, each on its own part of the text. Both columns must be plain ones.
    """

    def block(k):
        own = F.slice(merged, k * BLOCK + 1, BLOCK)
        begin = F.element_at(own, 1)["start"]
        after = F.element_at(merged, F.least(k * BLOCK + BLOCK + 1, F.size(merged)))["start"]
        end = F.when((k + 1) * BLOCK < F.size(merged), after).otherwise(F.length(whole))
        part = F.substr(whole, begin + 1, end - begin)
        return F.array_join(
            F.transform(
                own,
                lambda s, n: F.concat(
                    F.when(
                        s["kind"] >= 0,
                        fill(s, F.substr(part, s["start"] - begin + 1, s["end"] - s["start"])),
                    ).otherwise(""),
                    F.substr(
                        part,
                        s["end"] - begin + 1,
                        F.coalesce(F.try_element_at(own, n + 2)["start"], end) - s["end"],
                    ),
                ),
            ),
            "",
        )

    count = F.ceil(F.size(merged) / BLOCK).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), count - 1), block), "")


def redact(docs: DataFrame, model: Trees | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with every span of ``text`` replaced by its kind in brackets.

    Null texts stay null. Columns ``base`` and ``spans`` are dropped.
    """
    columns = [c for c in docs.columns if c not in ("base", "spans")]
    df = find_spans(docs.select(*columns), model, text)
    df = df.withColumn("__merged", merged_spans(F.col("spans")))
    whole, name = F.col(text), F.array(*[F.lit(f"[{kind.upper()}]") for kind in KINDS])
    joined = replaced(
        whole, F.col("__merged"), lambda s, body: F.element_at(name, F.greatest(F.lit(0), s["kind"]) + 1)
    )
    changed = F.when(whole.isNull() | (F.size("spans") == 0), whole).otherwise(joined)
    return df.withColumn(text, changed).select(*columns)


def redact_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` redacted by trees that learn from them; ``n_chars``, if there, follows the text."""
    out = redact(docs, train(docs, key, text), text)
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.length(text).cast(kind))
