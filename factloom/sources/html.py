"""HTML readers: document parts, visible text and index links.

The helpers read one document at a time inside the tasks and emit flat rows;
sections, fact matching, typing and joins are left to Spark.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence
from functools import partial
from html import unescape
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import let, strip

# Send the helpers with the tasks, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HIDDEN = {"script", "style", "template"}
HEAD_ONLY = {"html", "head", "title", "meta", "link", "base", "script", "style"}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
    "source", "track", "wbr",
}

# Fact tags with the namespace prefix are tried first, then bare ones (fixed values).
PREFIXED_FACTS = {"ix:nonfraction", "ix:nonnumeric"}
BARE_FACTS = {"nonfraction", "nonnumeric"}

# Tags that define contexts and units, by local name (fixed values).
MEMBERS = {"explicitmember", "typedmember"}
DEFINITIONS = {"context", "unit", *MEMBERS}

# Columns of a fact tag and the attributes they come from (fixed values).
FACT_ATTRIBUTES = {
    "name": "name",
    "fact_id": "id",
    "context_ref": "contextref",
    "unit_ref": "unitref",
    "decimals": "decimals",
    "precision": "precision",
    "scale": "scale",
    "sign": "sign",
    "format": "format",
}
RESOLVED_FIELDS = ("schema_url", "unit", "entity", "scenario", "instant", "start", "end")

PART_SCHEMA = (
    "pos int, end_pos int, kind string, reached boolean, tag string, text string, "
    + ", ".join(f"{f} string" for f in FACT_ATTRIBUTES)
    + ", "
    + ", ".join(f"`{f}` string" for f in RESOLVED_FIELDS)
)
ROWS_PER_BATCH = 4096
PART_COLUMNS = ["pos", "end_pos", "kind", "reached", "tag", "text", *FACT_ATTRIBUTES, *RESOLVED_FIELDS]


_TOKEN = re.compile(
    r"""
    <!--.*?--!?>                                                     # comment
  | <(?:!(?!--)|\?)[^>]*>                                             # declaration
  | </(?P<end>[a-zA-Z][^\s/>]*)[^>]*>                                # end tag
  | </[^a-zA-Z][^>]*>                                                # junk
  | <(?P<raw>(?i:script|style))(?=[\s>])[^>]*(?<!/)>                  # hidden content
      (?:.*?(?=</(?i:(?P=raw))[\s/>])|.*)
  | <(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?)*+)>
    """,
    re.DOTALL | re.VERBOSE,
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")


def _attributes(source: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name; the first of equal ones stands."""
    given: dict[str, str] = {}
    escaped = "&" in source
    for name, value in _ATTRIBUTE.findall(source):
        if value[:1] in ("'", '"') and value[-1:] == value[0]:
            value = value[1:-1]
        given.setdefault(name.lower(), unescape(value) if escaped else value)
    return given


def read_tokens(html: str) -> Iterator[tuple[str, str]]:
    """What a document is made of: ``open:TAG`` with its attributes, ``close:TAG``, and ``text``.

    A text ends at any tag or comment; comments, declarations and scripts give nothing.
    """
    at = 0
    for token in _TOKEN.finditer(html):
        start = token.start()
        if start > at:
            data = html[at:start]
            yield "text", unescape(data) if "&" in data else data
        at, kind = token.end(), token.lastgroup
        if kind == "attrs":
            _, _, tag, attrs = token.groups()
            tag = tag.lower()
            yield f"open:{tag}", attrs
            if attrs[-1:] == "/" and tag not in VOID:
                yield f"close:{tag}", ""
        elif kind == "end":
            yield f"close:{token['end'].lower()}", ""
    if at < len(html):
        yield "text", unescape(html[at:])


TOKEN = "struct<kind:string,body:string>"
#: Tokens that are folded at once.
FOLDED = 512


def _lister(tags: dict[str, str | None]):
    """Reads a page into its texts and those of its tags that ``tags`` names."""

    def listed(html: str) -> list[dict]:
        out = []
        for kind, body in read_tokens(html):
            event, _, tag = kind.partition(":")
            if tag:
                if tag not in tags:
                    continue
                named = tags[tag] if event == "open" else None
                body = _attributes(body).get(named) if named else None
            out.append({"kind": kind, "body": body})
        return out

    return listed


def html_tokens(c: Column, tags: dict[str, str | None]) -> Column:
    """Array of ``kind, body``: the texts of a page and those of its tags that ``tags`` names.

    The body of an opening tag is its attribute that ``tags`` asks for, or null without it.
    """
    listed = _lister(tags)

    @F.pandas_udf(f"array<{TOKEN}>")
    def tokens(values: pd.Series) -> pd.Series:
        return values.map(listed, na_action="ignore")

    return tokens(c)


def folded(tokens: Column, begin: Column, out: str, step) -> Column:
    """What ``step`` (state, token) puts into the array ``out`` of its state, over all tokens.

    Tokens are folded in blocks and each block starts an array of its own, so the work grows with
    the number of tokens and not with its square.
    """
    held = f"array<{out}>"

    def block(state: Column, k: Column) -> Column:
        start = F.struct(state["own"].alias("own"), F.array().cast(held).alias("out"))
        inner = F.aggregate(F.slice(tokens, k * FOLDED + 1, FOLDED), start, step)
        return let(
            inner,
            lambda done: F.struct(
                done["own"].alias("own"), F.array_append(state["out"], done["out"]).alias("out")
            ),
        )

    last = F.greatest(F.lit(0), F.ceil(F.size(tokens) / FOLDED).cast("int") - 1)
    start = F.struct(begin.alias("own"), F.array().cast(f"array<{held}>").alias("out"))
    return F.flatten(F.aggregate(F.sequence(F.lit(0), last), start, block, lambda s: s["out"]))


class _Tag(NamedTuple):
    """What the reader asks of a tag, by its name."""

    name: str
    heading: bool
    fact: bool
    void: bool
    starts_body: bool
    local: str
    defines: bool


class _PartReader:
    """Collects headings, texts, fact tags, contexts and units in document order.

    Without ``resolve`` contexts, units and prefixes are left alone. With ``facts_only`` headings and
    texts keep their places, but no rows are made of them.
    """

    def __init__(self, fact_tags: set[str], resolve: bool = True, facts_only: bool = False):
        self.fact_tags = fact_tags
        self.resolve = resolve
        self.facts_only = facts_only
        self.rows: list[dict] = []
        self.size = 0
        self.open: list[tuple[_Tag, dict | None]] = []
        self.count: dict[str, int] = {}
        self.collecting: list[dict] = []
        self.in_body = False
        self.headings = 0
        self.definition: dict | None = None
        self.contexts: dict[str, dict] = {}
        self.units: dict[str, list[str]] = {}
        self.namespaces: dict[str, str] = {}

    def told(self, name: str) -> _Tag:
        name = name.lower()
        local = name.rpartition(":")[2]
        return _Tag(
            name,
            name in HEADINGS,
            name in self.fact_tags,
            name in VOID,
            name not in HEAD_ONLY,
            local,
            self.resolve and local in DEFINITIONS,
        )

    def open_tag(self, tag: _Tag, attrs: str) -> None:
        name, count = tag.name, self.count
        given: dict[str, str] = {}
        if tag.fact or tag.defines or self.resolve and "xmlns:" in attrs:
            given = _attributes(attrs)
            if self.resolve:
                for key, value in given.items():
                    if key.startswith("xmlns:"):
                        self.namespaces.setdefault(key[6:], value)
        if not self.in_body and (
            name == "body" or tag.starts_body and not count.get("head")
        ):
            self.in_body = True
        row = None
        if tag.fact or tag.heading and self.in_body:
            pos, self.size = self.size, self.size + 1
            if tag.fact or not self.facts_only:
                row = {
                    "kind": "fact" if tag.fact else "heading",
                    "tag": name,
                    "reached": self.in_body and not self.headings and not count.get("template"),
                    "pos": pos,
                    "text": [],
                }
                if tag.fact:
                    for field, attribute in FACT_ATTRIBUTES.items():
                        row[field] = given.get(attribute)
                    row["fact_id"] = row["fact_id"] or None
                self.rows.append(row)
                self.collecting.append(row)
        if tag.defines:
            if tag.local == "context":
                self.definition = self.contexts.setdefault(given.get("id", ""), {})
            elif tag.local == "unit":
                self.units.setdefault(given.get("id", ""), [])
                self.definition = {"unit": given.get("id", "")}
            elif self.definition is not None:
                self.definition.setdefault("axes", []).append(given.get("dimension", ""))
        if not tag.void:
            self.open.append((tag, row))
            count[name] = count.get(name, 0) + 1
            self.headings += tag.heading

    def close_tag(self, name: str) -> None:
        count = self.count
        if not count.get(name):
            return
        closed = ""
        while closed != name:
            tag, row = self.open.pop()
            closed = tag.name
            count[closed] -= 1
            self.headings -= tag.heading
            if row is not None:
                row["end_pos"] = self.size - 1
                self.collecting.remove(row)
            if tag.defines and tag.local in ("context", "unit"):
                self.definition = None

    def text_node(self, data: str) -> None:
        if self.count.get("template"):
            return
        text = data.strip()
        if self.definition is not None:
            self._define(self.open[-1][0].local if self.open else "", text)
        for row in self.collecting:
            row["text"].append(text if row["kind"] == "heading" else data)
        if not text:
            return
        parent = self.open[-1][0].name if self.open else ""
        if not self.in_body and not self.count.get("head") and parent in ("", "html"):
            self.in_body = True
        if self.in_body and not self.headings and parent not in PREFIXED_FACTS:
            if not self.facts_only:
                self.rows.append({"kind": "text", "reached": True, "pos": self.size, "text": [text]})
            self.size += 1

    def _define(self, local: str, text: str) -> None:
        if not text:
            return
        if "unit" in self.definition:
            if local == "measure":
                self.units[self.definition["unit"]].append(text)
        elif local in ("identifier", "instant", "startdate", "enddate"):
            self.definition[local] = text
        elif local in MEMBERS:
            self.definition.setdefault("members", []).append(text)

    def read(self, html: str) -> _PartReader:
        """Goes through what ``read_tokens`` tells, without naming each event."""
        at, tags = 0, {}
        for token in _TOKEN.finditer(html):
            start, end = token.span()
            if start > at:
                data = html[at:start]
                self.text_node(unescape(data) if "&" in data else data)
            at, kind = end, token.lastgroup
            if kind == "attrs":
                name, attrs = token.group("start", "attrs")
                tag = tags.get(name)
                if tag is None:
                    tag = tags[name] = self.told(name)
                self.open_tag(tag, attrs)
                if attrs[-1:] == "/" and not tag.void:
                    self.close_tag(tag.name)
            elif kind == "end":
                self.close_tag(token["end"].lower())
        if at < len(html):
            self.text_node(unescape(html[at:]))
        return self

    def finish(self) -> list[dict]:
        last = self.size - 1
        for row in self.rows:
            kind = row["kind"]
            if kind == "text":
                row["end_pos"], row["text"] = row["pos"], row["text"][0]
                continue
            row.setdefault("end_pos", last)
            row["text"] = "".join(row["text"])
            if kind == "fact" and self.resolve:
                self._resolve(row)
        return self.rows

    def _resolve(self, row: dict) -> None:
        """Look up prefix, context and unit, which live in the same document."""
        prefix, colon, _ = (row["name"] or "").partition(":")
        if colon:
            row["schema_url"] = self.namespaces.get(prefix.lower())
        row["unit"] = "/".join(self.units.get(row["unit_ref"] or "", [])) or None
        context = self.contexts.get(row["context_ref"] or "")
        if context:
            pairs = zip(context.get("axes", []), context.get("members", []))
            row.update(
                entity=context.get("identifier"),
                scenario=", ".join(f"{a}={m}" for a, m in pairs) or None,
                instant=context.get("instant"),
                start=context.get("startdate"),
                end=context.get("enddate"),
            )


def read_parts(html: str, resolve: bool = True, facts_only: bool = False) -> list[dict]:
    """Parts of one document; empty unless some fact tag carries an id."""
    lowered = html.lower()
    for fact_tags in (PREFIXED_FACTS, BARE_FACTS):
        if not any(t in lowered for t in fact_tags):
            continue
        rows = _PartReader(fact_tags, resolve, facts_only).read(html).finish()
        if any(r["kind"] == "fact" and r["fact_id"] for r in rows):
            return rows
    return []


def document_parts(
    pages: DataFrame,
    filing_id: str = "filing_id",
    html: str = "html",
    keep: Sequence[str] = (),
    facts_only: bool = False,
) -> DataFrame:
    """One row per heading, text and fact tag: ``filing_id, pos, kind, ...``.

    ``pos`` counts the rows of a document, ``end_pos`` is the last position
    inside a tag, ``reached`` is false below headings and outside the body.
    Columns named in ``keep`` are carried along, which spares a join later. With ``facts_only``
    headings and texts are read, but only the rows of fact tags are returned, which are the same.
    """
    carried = ["filing_id", *keep]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources: list[int] = []
            columns: list[list] = [[] for _ in PART_COLUMNS]
            for i, source in enumerate(batch["html"]):
                rows = read_parts(source.as_py() or "", facts_only=facts_only)
                sources += [i] * len(rows)
                for name, column in zip(PART_COLUMNS, columns):
                    column += [row.get(name) for row in rows]
                if len(sources) >= ROWS_PER_BATCH:
                    yield _part_batch(batch, carried, sources, columns)
                    sources, columns = [], [[] for _ in PART_COLUMNS]
            if sources:
                yield _part_batch(batch, carried, sources, columns)

    chosen = pages.select(F.col(filing_id).alias("filing_id"), *keep, F.col(html).alias("html"))
    kinds = dict(chosen.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carried)
    return chosen.mapInArrow(parse, f"{schema}, {PART_SCHEMA}")


def _met_by_id(pages: DataFrame, known: DataFrame, read, kinds: dict[str, str], out: str) -> DataFrame:
    """``filing_id, known`` and in ``out`` what ``read`` finds in the page, as an array of structs.

    ``kinds`` names the fields; ``met`` is added, the last place in ``known`` of the ``fact_id``. A
    filing stays in its row, so nothing has to bring its parts together again.
    """
    names = list(kinds)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts, begin = batch.column("known"), 0
            ids, bounds = facts.values.field("fact_id"), facts.offsets.to_pylist()

            def made(end: int) -> pa.RecordBatch:
                arrays = [
                    pa.array(column, type=PART_KINDS.get(name, pa.string()))
                    for name, column in zip(names, columns)
                ]
                parts = pa.StructArray.from_arrays(
                    [*arrays, pa.array(met, type=pa.int32())], names=[*names, "met"]
                )
                lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), parts)
                same = batch.slice(begin, end - begin)
                return pa.RecordBatch.from_arrays(
                    [same.column("filing_id"), same.column("known"), lists],
                    names=["filing_id", "known", out],
                )

            ends, columns, met = [0], [[] for _ in names], []
            for i, source in enumerate(batch.column("html")):
                rows = read(source.as_py() or "")
                own = ids.slice(bounds[i], bounds[i + 1] - bounds[i]).to_pylist()
                place = {fact_id: k for k, fact_id in enumerate(own)}
                met += [place.get(row.get("fact_id")) for row in rows]
                for name, column in zip(names, columns):
                    column += [row.get(name) for row in rows]
                ends.append(len(met))
                if len(met) >= ROWS_PER_BATCH:
                    yield made(i + 1)
                    begin, ends, columns, met = i + 1, [0], [[] for _ in names], []
            if len(ends) > 1:
                yield made(batch.num_rows)

    none = F.array().cast(dict(known.dtypes)["known"])
    joined = pages.select("filing_id", "html").join(known, "filing_id", "left")
    chosen = joined.select("filing_id", "html", F.coalesce("known", none).alias("known"))
    given = dict(chosen.dtypes)
    fields = ",".join(f"{name}:{kind}" for name, kind in kinds.items())
    return chosen.mapInArrow(
        parse,
        f"filing_id {given['filing_id']}, known {given['known']}, {out} array<struct<{fields},met:int>>",
    )


def known_parts(pages: DataFrame, known: DataFrame) -> DataFrame:
    """``filing_id, known, parts``: what :func:`document_parts` tells of a filing, as one array.

    ``known`` holds one array of facts for each ``filing_id``, and of equal ids the last one stands.
    A part has the columns that the walk over the document needs, and in ``met`` the place of the
    fact of its id in ``known``.
    """
    return _met_by_id(pages, known, partial(read_parts, resolve=False), WALKED, "parts")


def known_tags(pages: DataFrame, known: DataFrame) -> DataFrame:
    """``filing_id, known, tags``: the fact tags of a filing, as :func:`known_parts` has its parts."""

    def read(html: str) -> list[dict]:
        given = read_fact_tags(html)
        return [{"name": g.get("name"), "fact_id": g.get("id") or None} for g in given]

    return _met_by_id(pages, known, read, {"name": "string", "fact_id": "string"}, "tags")


def read_fact_tags(html: str) -> list[dict[str, str]]:
    """Attributes of the fact tags of one document, those that ``read_parts`` finds, in order."""
    lowered = html.lower()
    for fact_tags in (PREFIXED_FACTS, BARE_FACTS):
        if not any(t in lowered for t in fact_tags):
            continue
        given = [
            _attributes(token["attrs"])
            for token in _TOKEN.finditer(html)
            if token.lastgroup == "attrs" and token["start"].lower() in fact_tags
        ]
        if any(attributes.get("id") for attributes in given):
            return given
    return []


def fact_tags(pages: DataFrame, filing_id: str = "filing_id", html: str = "html") -> DataFrame:
    """``filing_id, kind, name, fact_id`` of the fact tags alone.

    The same as those columns of the facts among ``document_parts``, but neither texts nor contexts
    are put together, which takes most of its time.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources: list[int] = []
            names: list[str | None] = []
            ids: list[str | None] = []
            for i, source in enumerate(batch["html"]):
                given = read_fact_tags(source.as_py() or "")
                sources += [i] * len(given)
                names += [attributes.get("name") for attributes in given]
                ids += [attributes.get("id") or None for attributes in given]
            filings = batch.column("filing_id").take(pa.array(sources, type=pa.int32()))
            columns = [filings, pa.array(names, type=pa.string()), pa.array(ids, type=pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["filing_id", "name", "fact_id"])

    chosen = pages.select(F.col(filing_id).alias("filing_id"), F.col(html).alias("html"))
    kind = dict(chosen.dtypes)["filing_id"]
    tags = chosen.mapInArrow(parse, f"filing_id {kind}, name string, fact_id string")
    return tags.select("filing_id", F.lit("fact").alias("kind"), "name", "fact_id")


#: Columns that the walk over a document needs.
WALKED = {
    "pos": "int", "end_pos": "int", "kind": "string", "reached": "boolean", "tag": "string",
    "text": "string", "name": "string", "fact_id": "string",
}
PART_KINDS = {"pos": pa.int32(), "end_pos": pa.int32(), "reached": pa.bool_()}


def _part_batch(batch: pa.RecordBatch, carried, sources, columns) -> pa.RecordBatch:
    """Part rows with the carried columns of the document each row comes from."""
    origin = pa.array(sources, type=pa.int32())
    arrays = [batch.column(c).take(origin) for c in carried] + [
        pa.array(column, type=PART_KINDS.get(name, pa.string()))
        for name, column in zip(PART_COLUMNS, columns)
    ]
    return pa.RecordBatch.from_arrays(arrays, names=[*carried, *PART_COLUMNS])


def _shown_strings(tokens: Column) -> Column:
    """The texts outside hidden elements, each stripped, blank ones dropped."""

    def step(state: Column, token: Column) -> Column:
        kind, depth = token["kind"], state["own"]
        deeper = F.when(kind == "text", depth).when(kind.startswith("open:"), depth + 1)
        seen = (kind == "text") & (depth == 0)
        return F.struct(
            deeper.otherwise(F.greatest(F.lit(0), depth - 1)).alias("own"),
            F.when(seen, F.array_append(state["out"], token["body"]))
            .otherwise(state["out"])
            .alias("out"),
        )

    # Without hidden elements all texts are seen.
    hidden = F.exists(tokens, lambda t: t["kind"] != "text")
    texts = F.when(hidden, folded(tokens, F.lit(0), "string", step)).otherwise(
        F.transform(tokens, lambda t: t["body"])
    )
    return F.filter(F.transform(texts, strip), lambda x: x != "")


def visible_strings(c: Column) -> Column:
    """Array of the visible texts of a page, each stripped; null stays null."""
    return let(html_tokens(c, dict.fromkeys(HIDDEN)), _shown_strings)


def visible_texts(c: Column, separator: str = "\n") -> Column:
    """``visible_text`` of each element of an array."""
    listed = _lister(dict.fromkeys(HIDDEN))

    @F.pandas_udf(f"array<array<{TOKEN}>>")
    def tokens(values: pd.Series) -> pd.Series:
        return values.map(
            lambda texts: [None if x is None else listed(x) for x in texts], na_action="ignore"
        )

    return F.transform(tokens(c), lambda t: F.array_join(_shown_strings(t), separator))


def visible_text(c: Column, separator: str = "\n") -> Column:
    """Visible strings, each stripped, joined by ``separator``."""
    return F.array_join(visible_strings(c), separator)


#: What ends a line of text (fixed values).
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def page_text(c: Column) -> Column:
    """Readable text of a page: visible strings cut into lines and phrases, blank ones dropped."""

    def phrases(line: Column) -> Column:
        return F.transform(F.split(strip(line), "  ", -1), strip)

    lines = F.split(visible_text(c), LINE_ENDS, -1)
    parts = F.flatten(F.transform(lines, phrases))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


#: Tags of an index page and the attributes that count.
_TABLE_TAGS = {"table": "summary", "tr": None, "td": None, "a": "href"}
_ROW = "struct<label:string,href:string>"


def index_rows(c: Column, summary: str = "Document Format Files") -> Column:
    """Array of ``(label, href)`` for table rows with at least three cells.

    Rows of the first table with that summary: text of the first cell, first link of the third.
    """
    none = F.lit(None).cast("string")

    def at(phase: Column, cells=None, inside=None, label=None, href=None, linked=None) -> Column:
        """Where the reader stands: before, inside or after the table, and what the row has so far."""
        given = {
            "phase": phase,
            "cells": F.lit(0) if cells is None else cells,
            "inside": F.lit(False) if inside is None else inside,
            "label": F.lit("") if label is None else label,
            "href": none if href is None else href,
            "linked": F.lit(False) if linked is None else linked,
        }
        return F.struct(*[v.alias(k) for k, v in given.items()])

    def step(state: Column, token: Column) -> Column:
        kind, body, own = token["kind"], token["body"], state["own"]
        row = [own[n] for n in ("cells", "inside", "label", "href", "linked")]
        cells, inside, label, href, linked = row
        within = own["phase"] == 1
        ends = within & kind.isin("open:tr", "close:tr", "close:table")
        cell_link = (kind == "open:a") & inside & (cells == 3) & ~linked
        moved = (
            F.when(~within, at(F.when((own["phase"] == 0) & (kind == "open:table") & body.eqNullSafe(F.lit(summary)), 1).otherwise(own["phase"]), *row))
            .when(ends, at(F.when(kind == "close:table", 2).otherwise(1)))
            .when(kind == "open:td", at(own["phase"], cells + 1, F.lit(True), label, href, linked))
            .when(kind == "close:td", at(own["phase"], cells, F.lit(False), label, href, linked))
            .when(cell_link, at(own["phase"], cells, inside, label, body, F.lit(True)))
            .when((kind == "text") & inside & (cells == 1), at(own["phase"], cells, inside, F.concat(label, body), href, linked))
            .otherwise(own)
        )
        made = F.struct(F.lower(strip(label)).alias("label"), href.alias("href"))
        out = F.when(ends & (cells >= 3), F.array_append(state["out"], made)).otherwise(state["out"])
        return F.struct(moved.alias("own"), out.alias("out"))

    return let(
        html_tokens(c, _TABLE_TAGS),
        lambda tokens: F.when(tokens.isNotNull(), folded(tokens, at(F.lit(0)), _ROW, step)),
    )
