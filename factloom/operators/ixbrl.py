"""Inline documents: typed facts, fact matching, sections and match reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.constants import BLANK_HEADING_TITLE, NO_HEADING_TITLE
from factloom.functions.text import float_or_null, int_or_null, let, present
from factloom.operators.align import first_per_key
from factloom.operators.facts import NUMERIC, TEXT
from factloom.sources.html import PART_COLUMNS, folded, known_parts, known_tags

FACT_COLUMNS = [
    "concept_name",
    "prefix",
    "schema_url",
    "fact_type",
    "value",
    "unit",
    "decimals",
    "precision",
    "context_id",
    "context_entity",
    "context_scenario",
    "period_instant",
    "period_start",
    "period_end",
]


PART_KEYS = [
    "filing_id", "pos", "end_pos", "kind", "reached", "tag", "text", "name", "fact_id",
]


def _is_named_fact() -> Column:
    return (F.col("kind") == "fact") & F.col("name").isNotNull()


def _fact_values() -> dict[str, Column]:
    """The columns of a fact from those of its tag.

    The number is the text without separators, scaled by a power of ten and
    signed; a zero format means 0, a comma format swaps the separators.
    """
    gaps = " \xa0\t\r\n"
    form = F.lower(F.col("format"))
    swapped = (
        form.contains("comma-decimal") | form.contains("commadot") | form.contains("commadecimal")
    )
    zero = form.contains("zero") & ~form.contains("nonzero")
    digits = (
        F.when(zero, F.lit("0"))
        .when(swapped, F.translate(F.translate(F.col("text"), "." + gaps, ""), ",", "."))
        .otherwise(F.translate(F.col("text"), "," + gaps, ""))
    )
    scale = F.coalesce(int_or_null(F.col("scale")), F.lit(0))
    sign = F.when(F.col("sign") == "-", F.lit("-")).otherwise(F.lit(""))
    number = float_or_null(digits)
    size = F.when(scale == 0, digits).otherwise((number * F.pow(F.lit(10.0), scale)).cast("string"))
    scaled = F.when(number.isNotNull(), F.concat(sign, size))
    numeric = F.col("tag").endswith("nonfraction")
    local = F.substring_index("name", ":", -1)
    is_instant = F.col("instant").isNotNull()
    return {
        "concept_name": local,
        "prefix": F.when(F.col("name").contains(":"), F.substring_index("name", ":", 1)),
        "schema_url": F.col("schema_url"),
        "fact_type": F.when(numeric, F.lit(NUMERIC)).otherwise(F.lit(TEXT)),
        "value": F.when(numeric, scaled).otherwise(F.col("text")),
        "unit": F.col("unit"),
        "decimals": F.col("decimals"),
        "precision": F.col("precision"),
        "context_ref": F.col("context_ref"),
        "context_id": F.when(F.col("context_ref") != "", F.col("context_ref")),
        "context_entity": F.col("entity"),
        "context_scenario": F.col("scenario"),
        "period_instant": F.col("instant").try_cast("date"),
        "period_start": F.when(~is_instant, F.col("start").try_cast("date")),
        "period_end": F.when(~is_instant, F.col("end").try_cast("date")),
    }


def inline_facts(parts: DataFrame) -> DataFrame:
    """Instance facts from the fact tags of a document, without any shuffle.

    Columns carried along by the reader, such as ticker and dates, are kept.
    """
    carried = [c for c in parts.columns if c not in ("filing_id", *PART_COLUMNS)]
    values = [value.alias(name) for name, value in _fact_values().items()]
    return parts.filter(_is_named_fact()).select("filing_id", *carried, "fact_id", "pos", *values)


def own_facts(parts: DataFrame) -> DataFrame:
    """Parts matched with the facts of their own document, from one reading of it.

    The same rows as matching with :func:`inline_facts` of the parts: of equal ids the last fact
    stands. The parts of a filing stay together for the walk over the document.
    """
    known = _is_named_fact() & present(F.col("fact_id"))
    values = _fact_values()
    fact = F.when(known, F.struct(*[values[name].alias(name) for name in FACT_COLUMNS]))
    same_id = (
        Window.partitionBy("filing_id", "fact_id")
        .orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return (
        parts.select(*PART_KEYS, fact.alias("fact"))
        .repartition("filing_id")
        .withColumn("fact", F.last("fact", ignorenulls=True).over(same_id))
        .select(*PART_KEYS, "fact.*", F.col("fact").isNotNull().alias("matched"))
    )


def last_fact_per_id(facts: DataFrame) -> DataFrame:
    """One fact per id and filing; of equal ids the last one stands."""
    known = facts.filter(present(F.col("fact_id")))
    return first_per_key(known, ["filing_id", "fact_id"], F.col("pos").desc())


def match_facts(parts: DataFrame, facts: DataFrame) -> DataFrame:
    """Parts with the columns of the fact of the same id, and a ``matched`` flag.

    Headings and texts have no id; they meet nothing and pass through. ``parts`` may have a part of
    the columns only, such as fact tags that were read alone.
    """
    have = [c for c in FACT_COLUMNS if c in facts.columns]
    right = last_fact_per_id(facts).select("filing_id", "fact_id", *have, F.lit(True).alias("hit"))
    left = parts.select(*[c for c in PART_KEYS if c in parts.columns])
    return left.join(right, ["filing_id", "fact_id"], "left").withColumn(
        "matched", F.coalesce("hit", F.lit(False))
    ).drop("hit")


def _section_title(last: Column, first_text: Column, first: Column) -> Column:
    """Title of a section by the last heading before it and the first one of the document."""
    blank_carried = F.concat(F.lit(BLANK_HEADING_TITLE + " ("), last["tag"], F.lit(")"))
    return (
        F.when(last["text"] != "", last["text"])
        .when(last.isNotNull(), blank_carried)
        .when(first_text != "", first_text)
        .when(first.isNotNull(), F.lit(BLANK_HEADING_TITLE))
        .otherwise(F.lit(NO_HEADING_TITLE))
    )


def document_sections(matched: DataFrame) -> DataFrame:
    """The walk over a document: texts and matched facts, each under its section.

    A matched fact swallows everything inside it, an unmatched one is opened.
    A part belongs to the last heading before it; before any heading the title
    is that of the first one. Sections without parts vanish. All windows share
    one partitioning by filing, and a filing is a single parsed document.
    """
    by_filing = Window.partitionBy("filing_id").orderBy("pos")
    before = by_filing.rowsBetween(Window.unboundedPreceding, -1)
    so_far = by_filing.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everywhere = by_filing.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    is_heading = F.col("kind") == "heading"
    is_fact = F.col("matched") & F.col("reached")
    walked = (
        matched.withColumns(
            {
                "covered_to": F.max(F.when(is_fact, F.col("end_pos"))).over(before),
                "first_title": F.first(
                    F.when(is_heading, F.struct("text")), ignorenulls=True
                ).over(everywhere),
            }
        )
        .filter(
            F.col("reached")
            & (F.col("covered_to").isNull() | (F.col("covered_to") < F.col("pos")))
            & (is_heading | (F.col("kind") == "text") | F.col("matched"))
        )
        .withColumns(
            {
                "opens": F.coalesce(
                    F.lag("kind").over(by_filing) == "heading", F.lit(True)
                ),
                "last_title": F.last(
                    F.when(is_heading, F.struct("text", "tag")), ignorenulls=True
                ).over(so_far),
            }
        )
        .filter(~is_heading)
        .withColumn("section_idx", F.sum(F.col("opens").cast("int")).over(so_far))
    )
    title = _section_title(F.col("last_title"), F.col("first_title.text"), F.col("first_title"))
    return walked.withColumn("section_title", title).drop(
        "covered_to", "first_title", "opens", "last_title", "reached", "end_pos", "tag", "matched"
    )


def _met_in_filing(parts: DataFrame, facts: DataFrame) -> DataFrame:
    """The rows of :func:`match_facts`, dealt by filing alone.

    Parts and facts of a filing are stacked and sorted together, so that the texts are shuffled
    once and the walk over the document finds them in place.
    """
    have = [c for c in FACT_COLUMNS if c in facts.columns]
    known = facts.filter(present(F.col("fact_id"))).select(
        "filing_id",
        "fact_id",
        F.col("pos").alias("fact_pos"),
        F.struct(*have).alias("fact"),
        F.lit(False).alias("is_part"),
    )
    both = parts.select(*PART_KEYS, F.lit(True).alias("is_part")).unionByName(
        known, allowMissingColumns=True
    )
    same_id = (
        Window.partitionBy("filing_id", "fact_id")
        .orderBy("fact_pos")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return (
        both.repartition("filing_id")
        .withColumn("fact", F.last("fact", ignorenulls=True).over(same_id))
        .filter("is_part")
        .select(*PART_KEYS, "fact.*", F.col("fact").isNotNull().alias("matched"))
    )


def parse_documents(parts: DataFrame, facts: DataFrame) -> DataFrame:
    return document_sections(_met_in_filing(parts, facts))


def _walked(parts: Column, part_type: str) -> Column:
    """The walk of :func:`document_sections` over an array of parts: ``section_idx, title, part``."""
    none = F.lit(None)
    begin = F.struct(
        none.cast("int").alias("covered_to"),
        F.lit(True).alias("opens"),
        none.cast("struct<text:string,tag:string>").alias("title"),
        F.lit(0).cast("bigint").alias("idx"),
    )

    def step(state: Column, part: Column) -> Column:
        own, reached, matched = state["own"], part["reached"], part["met"].isNotNull()
        is_heading = part["kind"] == "heading"
        free = own["covered_to"].isNull() | (own["covered_to"] < part["pos"])
        met = reached & free & (is_heading | (part["kind"] == "text") | matched)
        title = F.struct(part["text"].alias("text"), part["tag"].alias("tag"))
        idx = own["idx"] + F.when(own["opens"], 1).otherwise(0)
        covered = F.greatest(own["covered_to"], F.when(matched & reached, part["end_pos"]))

        def moved(opens: Column, title: Column, idx: Column, out: Column) -> Column:
            here = F.struct(
                covered.alias("covered_to"), opens.alias("opens"), title.alias("title"), idx.alias("idx")
            )
            return F.struct(here.alias("own"), out.alias("out"))

        entry = F.struct(idx.alias("section_idx"), own["title"].alias("title"), part.alias("part"))
        return (
            F.when(~met, moved(own["opens"], own["title"], own["idx"], state["out"]))
            .when(is_heading, moved(F.lit(True), title, own["idx"], state["out"]))
            .otherwise(moved(F.lit(False), own["title"], idx, F.array_append(state["out"], entry)))
        )

    out = f"struct<section_idx:bigint,title:struct<text:string,tag:string>,part:{part_type}>"
    return folded(parts, begin, out, step)


def _known_of_filing(facts: DataFrame) -> DataFrame:
    """``filing_id, known``: the facts with an id of each filing, by position."""
    have = [c for c in FACT_COLUMNS if c in facts.columns]
    return facts.filter(present(F.col("fact_id"))).groupBy("filing_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "fact_id", *have))).alias("known")
    )


def match_tags(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """:func:`match_facts` of the fact tags of ``pages``, which hold ``filing_id, html``.

    The facts of a filing meet its page before that is read, so tags are never shuffled.
    """
    have = [c for c in FACT_COLUMNS if c in facts.columns]
    tags = known_tags(pages, _known_of_filing(facts))
    rows = tags.select("filing_id", "known", F.inline("tags"))
    return rows.select(
        "filing_id",
        "fact_id",
        F.lit("fact").alias("kind"),
        "name",
        *[F.get("known", F.col("met"))[c].alias(c) for c in have],
        F.col("met").isNotNull().alias("matched"),
    )


def filing_sections(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """``filing_id, parts``: :func:`parse_documents` of the pages, as one array for each filing.

    ``pages`` holds ``filing_id, html``, one page for each filing. The facts of a filing meet its page
    before that is read, so the many texts of a page are never shuffled: a filing is matched and
    walked in its row.
    """
    fact = [c for c in FACT_COLUMNS if c in facts.columns]
    read = known_parts(pages, _known_of_filing(facts))
    part_type = dict(read.dtypes)["parts"].removeprefix("array<").removesuffix(">")
    headings = F.filter("parts", lambda p: p["kind"] == "heading")

    def titled(first: Column) -> Column:
        def row(entry: Column) -> Column:
            part = entry["part"]
            return F.struct(
                entry["section_idx"].alias("section_idx"),
                _section_title(entry["title"], first["text"], first).alias("section_title"),
                *[part[c].alias(c) for c in ("pos", "kind", "text", "name", "fact_id")],
                *[F.get("known", part["met"])[c].alias(c) for c in fact],
            )

        return F.transform(_walked(F.col("parts"), part_type), row)

    return read.select("filing_id", let(F.get(headings, F.lit(0)), titled).alias("parts"))


def section_parts(filings: DataFrame) -> DataFrame:
    """The parts of :func:`filing_sections` as rows."""
    # Outer, as a filter for empty arrays would be inferred and walk the document again.
    return filings.select("filing_id", F.inline_outer("parts")).filter("section_idx is not null")


def match_report(matched: DataFrame) -> DataFrame:
    """Per filing: fact tags found, matched, with an unknown id, without an id."""
    has_id = present(F.col("fact_id"))
    return (
        matched.filter(F.col("kind") == "fact")
        .groupBy("filing_id")
        .agg(
            F.count(F.lit(1)).alias("tags_found"),
            F.count_if(F.col("matched")).alias("matched"),
            F.count_if(has_id & ~F.col("matched")).alias("unmatched"),
            F.count_if(F.coalesce(~has_id, F.lit(True))).alias("without_id"),
        )
    )


def unmatched_tags(parts: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Fact tags whose id no fact carries; without ``facts`` the parts are matched already."""
    tags = parts.filter((F.col("kind") == "fact") & present(F.col("fact_id")))
    if facts is None:
        return tags.filter(~F.col("matched")).select("filing_id", "fact_id", "name")
    known = facts.select("filing_id", "fact_id").filter(present(F.col("fact_id")))
    return tags.join(known, ["filing_id", "fact_id"], "left_anti").select(
        "filing_id", "fact_id", "name"
    )


def name_mismatches(matched: DataFrame) -> DataFrame:
    """Tags that met a fact of the same id but another local name."""
    local = F.expr("substring(name, locate(':', name) + 1)")
    return matched.filter(
        F.col("matched") & F.col("name").contains(":") & (local != F.col("concept_name"))
    ).select("filing_id", "fact_id", "name", "concept_name")
