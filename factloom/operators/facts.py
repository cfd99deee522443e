"""Fact tables: typed projections, context lookup, sectioned and direct variants.

An instance fact is a row of ``filing_id, fact_id, pos, concept_name, prefix,
schema_url, fact_type, value, unit, decimals, precision, context_ref`` with
text values; a context row is ``filing_id, context_id, entity, scenario,
kind, instant, start, end``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import float_or_null, int_or_null, parse_date, present, url_segment
from factloom.operators.align import align
from factloom.schemas import (
    NUMERIC_FACTS,
    SECTION_FACTS,
    SECTION_NUMERIC_FACTS,
    SECTION_TEXT_FACTS,
    TEXT_FACTS,
)

NUMERIC, TEXT = "NumericFact", "TextFact"


def us_gaap_facts(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("schema_url").contains("us-gaap"))


def numeric_only(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("fact_type") == NUMERIC)


def text_only(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("fact_type") == TEXT)


def non_numeric(facts: DataFrame) -> DataFrame:
    """Everything that is not numeric counts as text in a sectioned document."""
    return facts.filter(~F.col("fact_type").eqNullSafe(NUMERIC))


def concepts(facts: DataFrame, names: list[str]) -> DataFrame:
    return facts.filter(F.col("concept_name").isin(names))


def of_report_year(facts: DataFrame, year: int) -> DataFrame:
    """Facts reported for ``year``; left alone unless ``report_date`` is a date."""
    if dict(facts.dtypes).get("report_date") != "date":
        return facts
    return facts.filter(F.year("report_date") == year)


def of_ticker(df: DataFrame, ticker: str) -> DataFrame:
    return df.filter(F.col("ticker") == ticker)


def with_contexts(facts: DataFrame, contexts: DataFrame) -> DataFrame:
    """Give each fact the period and entity of its context.

    A context is an instant, a time frame, or anything else, which leaves all three dates null.
    Facts and contexts are stacked and meet in a window on filing and context, which leaves them
    where they are if both are dealt by filing already; a join would deal both anew. A fact that
    has several contexts is repeated for each.
    """
    instant, frame = F.col("kind") == "instant", F.col("kind") == "duration"
    looked_up = F.struct(
        F.col("context_id").alias("context_id"),
        F.col("entity").alias("context_entity"),
        F.col("scenario").alias("context_scenario"),
        F.when(instant, F.col("instant")).alias("period_instant"),
        F.when(frame, F.col("start")).alias("period_start"),
        F.when(frame, F.col("end")).alias("period_end"),
    )
    known = contexts.filter("filing_id is not null and context_id is not null").select(
        "filing_id", F.col("context_id").alias("context_ref"), looked_up.alias("__context")
    )
    keys = ["filing_id", "context_ref"]
    fact = F.struct(*[F.col(c) for c in facts.columns if c not in keys]).alias("__fact")
    both = facts.select(*keys, fact).unionByName(known, allowMissingColumns=True)
    met = both.withColumn("__met", F.collect_list("__context").over(Window.partitionBy(*keys)))
    found = met.filter("__fact is not null").select(
        *keys, "__fact.*", F.explode_outer("__met").alias("__context")
    )
    return found.select(*keys, *[c for c in facts.columns if c not in keys], "__context.*")


def _as_date(facts: DataFrame, name: str) -> Column:
    return F.col(name) if dict(facts.dtypes)[name] == "date" else parse_date(F.col(name))


def _common(facts: DataFrame) -> DataFrame:
    return facts.withColumns(
        {
            "concept_namespace": F.when(
                present(F.col("schema_url")), url_segment(F.col("schema_url"), -2)
            ),
            **{
                name: _as_date(facts, name)
                for name in ("period_instant", "period_start", "period_end")
            },
        }
    )


def _numeric(facts: DataFrame) -> DataFrame:
    return facts.withColumns(
        {
            "fact_value": float_or_null(F.col("value")),
            "unit": F.when(present(F.col("unit")), F.col("unit")),
            "metadata": F.struct(
                int_or_null(F.col("decimals")).alias("decimals"),
                int_or_null(F.col("precision")).alias("precision"),
            ),
        }
    )


def numeric_facts(facts: DataFrame, filing_key: T.StructField | None = None) -> DataFrame:
    """Direct numeric facts from instance facts that already carry period and filing columns.

    With ``filing_key`` the filing's id stands in a last column of that name and type.
    """
    rows, schema = _numeric(_common(numeric_only(facts))), NUMERIC_FACTS
    if filing_key is not None:
        rows = rows.withColumn(filing_key.name, F.col("filing_id").cast(filing_key.dataType))
        schema = T.StructType([*NUMERIC_FACTS.fields, filing_key])
    return align(rows, schema)


def text_facts(facts: DataFrame) -> DataFrame:
    return align(_common(text_only(facts)).withColumn("fact_value", F.col("value")), TEXT_FACTS)


def _titled(parts: DataFrame) -> DataFrame:
    return parts.filter(F.col("kind") == "fact").withColumn("section_name", F.col("section_title"))


def section_facts(parts: DataFrame) -> DataFrame:
    """All facts of a document with the section they stand in; text values give null."""
    return align(_numeric(_common(_titled(parts))), SECTION_FACTS)


def section_numeric_facts(parts: DataFrame) -> DataFrame:
    return align(_numeric(_common(numeric_only(_titled(parts)))), SECTION_NUMERIC_FACTS)


def section_text_facts(parts: DataFrame) -> DataFrame:
    rows = _common(non_numeric(_titled(parts))).withColumn("fact_value", F.col("value"))
    return align(rows, SECTION_TEXT_FACTS)


def filing_dates(filings: DataFrame) -> DataFrame:
    """What facts inherit from their filing: ticker and both dates."""
    return filings.select(
        "filing_id",
        "ticker",
        F.col("filing_date_dt").alias("filing_date"),
        F.col("report_date_dt").alias("report_date"),
    )


def with_filing(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """Facts inherit ticker and both dates of their filing.

    ``filings`` has one row per ``filing_id``. Filings without an instance
    address or ticker must be removed before (``usable_filings``); filings that
    failed to parse have no facts and drop out. Filings are hashed and facts stream past them,
    as a sort would hold all facts of a task, many times the rows of its filings.
    """
    return facts.join(filing_dates(filings).hint("shuffle_hash"), "filing_id")


def string_fact_rows(parts: DataFrame) -> DataFrame:
    """Facts of a document with every column as text, ready to append to a string table."""
    rows = _common(_titled(parts))
    as_text = [
        "concept_name",
        "concept_namespace",
        "value",
        "fact_type",
        "section_name",
        "unit",
        "period_instant",
        "period_start",
        "period_end",
        "context_id",
        "decimals",
        "precision",
    ]
    return rows.select(
        *[
            F.col(c).cast("string").alias("fact_value" if c == "value" else c)
            for c in as_text
        ]
    )
