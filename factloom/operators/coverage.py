"""Concept counts, concept coverage and tag coverage over a facts table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.constants import CANONICAL_TAGS
from factloom.sources.tables import replace_table, scan_table, table_exists

#: Registers of a sketch, as a power of two.
SKETCH = 14


def tag_table(spark, tags: Mapping[str, str] = CANONICAL_TAGS) -> DataFrame:
    """The concept to canonical tag list as a small frame."""
    return spark.createDataFrame(list(tags.items()), "concept_name string, tag string")


def concept_counts(facts: DataFrame, pattern: str | None = None) -> DataFrame:
    """Facts per concept, most frequent first; ``pattern`` keeps matching names."""
    if pattern is not None:
        facts = facts.filter(F.col("concept_name").rlike(pattern))
    return (
        facts.groupBy("concept_name")
        .agg(F.count(F.lit(1)).alias("n_facts"))
        .orderBy(F.desc("n_facts"), "concept_name")
    )


def distinct_filings(facts: DataFrame) -> DataFrame:
    return facts.select("filing_date", "ticker").distinct()


def concept_coverage(facts: DataFrame) -> DataFrame:
    """Distinct filings per concept.

    A filing is a date with a ticker; all rows of a concept that lack one of
    them count as one more filing. The distinct step shuffles on concept, date
    and ticker together, so one dominant concept is spread over all tasks.
    """
    return _coverage(_appearances(facts))


def _appearances(facts: DataFrame) -> DataFrame:
    return facts.select("concept_name", "filing_date", "ticker").distinct()


def _coverage(appearances: DataFrame) -> DataFrame:
    known = F.col("filing_date").isNotNull() & F.col("ticker").isNotNull()
    return appearances.groupBy("concept_name").agg(
        (F.count_if(known) + F.max((~known).cast("bigint"))).alias("num_filings")
    )


def coverage_sketches(facts: DataFrame, log_size: int = SKETCH) -> DataFrame:
    """``concept_name, filings, unnamed``: a mergeable count of distinct filings per concept.

    ``filings`` is a sketch of 2 to the power of ``log_size`` registers, ``unnamed`` says whether
    rows lack a date or ticker. A sketch is as large for one filing as for all, and is filled before
    the shuffle, so one dominant concept sends one row per task.
    """
    known = F.col("filing_date").isNotNull() & F.col("ticker").isNotNull()
    filing = F.when(known, F.concat_ws("\x1f", F.col("filing_date").cast("string"), "ticker"))
    return facts.groupBy("concept_name").agg(
        F.hll_sketch_agg(filing, log_size).alias("filings"), F.max(~known).alias("unnamed")
    )


def merged_sketches(*sketches: DataFrame) -> DataFrame:
    """Sketches of several batches of facts as those of all of them; batches may overlap."""
    whole = sketches[0]
    for more in sketches[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("concept_name").agg(
        F.hll_union_agg("filings").alias("filings"), F.max("unnamed").alias("unnamed")
    )


def estimated_coverage(sketches: DataFrame) -> DataFrame:
    """Distinct filings per concept as ``concept_coverage`` counts them, estimated.

    With the default size the relative standard error is 0.65 %.
    """
    number = F.hll_sketch_estimate("filings") + F.col("unnamed").cast("bigint")
    return sketches.select("concept_name", number.alias("num_filings"))


def refresh_sketches(facts: DataFrame, path: str) -> DataFrame:
    """The stored sketches after those of new facts were merged into them."""
    fresh = coverage_sketches(facts)
    if table_exists(facts.sparkSession, path):
        fresh = merged_sketches(scan_table(facts.sparkSession, path, fresh.schema, "parquet"), fresh)
    return replace_table(fresh, path, "parquet")


def filing_count(facts: DataFrame) -> DataFrame:
    return distinct_filings(facts).agg(F.count(F.lit(1)).alias("total_filings"))


def concepts_with_share(facts: DataFrame, share: float) -> DataFrame:
    """Concepts found in at least ``share`` of all filings.

    Both counts come from the same distinct rows, so the facts are shuffled once.
    """
    appearances = _appearances(facts)
    total = filing_count(appearances).scalar()
    return _coverage(appearances).filter(F.col("num_filings") >= total * F.lit(share))


def concepts_in_all_filings(facts: DataFrame) -> DataFrame:
    appearances = _appearances(facts)
    total = filing_count(appearances).scalar()
    return _coverage(appearances).filter(F.col("num_filings") == total)


def top_coverage(facts: DataFrame, share: float = 0.9, n: int = 10) -> DataFrame:
    return (
        concepts_with_share(facts, share).orderBy(F.desc("num_filings"), "concept_name").limit(n)
    )


def distinct_concepts(facts: DataFrame) -> DataFrame:
    return facts.select("concept_name").distinct()


def first_row_per_concept(facts: DataFrame, *order: str) -> DataFrame:
    """One row per concept; ``order`` makes the choice repeatable.

    An aggregate over a struct sorts all its rows, so the least value of the first order column is
    found by hash first, and only rows that have it are compared whole. Concepts come from
    taxonomies, so the list of least values is small enough to broadcast.
    """
    lead = F.col(order[0])
    # Nulls come first in an ascending order.
    least = F.when(~F.max(lead.isNull()), F.min(lead))
    lows = facts.groupBy("concept_name").agg(least.alias("__least"))
    lows = lows.withColumnRenamed("concept_name", "__concept")
    met = F.col("concept_name").eqNullSafe(F.col("__concept")) & lead.eqNullSafe(F.col("__least"))
    first = facts.join(F.broadcast(lows), met, "left_semi")
    row, place = F.struct(*facts.columns), F.struct(*order)
    return first.groupBy("concept_name").agg(F.min_by(row, place).alias("row")).select("row.*")


def with_canonical_tag(facts: DataFrame, tags: Mapping[str, str] = CANONICAL_TAGS) -> DataFrame:
    """Add the canonical tag of each concept; unknown concepts get null.

    The list holds a fixed handful of names, so it is always small enough to
    broadcast.
    """
    return facts.join(F.broadcast(tag_table(facts.sparkSession, tags)), "concept_name", "left")


def tag_matches(facts: DataFrame, tags: Mapping[str, str] = CANONICAL_TAGS) -> DataFrame:
    """Each wanted concept with a flag: is it found among the facts?"""
    found = (
        facts.filter(F.col("concept_name").isin(list(tags)))
        .select("concept_name")
        .distinct()
        .withColumn("found", F.lit(True))
    )
    wanted = tag_table(facts.sparkSession, tags)
    # `found` holds at most one row per wanted concept.
    return wanted.join(F.broadcast(found), "concept_name", "left").select(
        "concept_name", "tag", F.coalesce("found", F.lit(False)).alias("found")
    )


def tag_coverage(facts: DataFrame, tags: Mapping[str, str] = CANONICAL_TAGS) -> DataFrame:
    """Number of wanted concepts, number found and the share in percent."""
    return tag_matches(facts, tags).agg(
        F.count(F.lit(1)).alias("wanted"),
        F.count_if("found").alias("found"),
        (F.avg(F.col("found").cast("int")) * 100).alias("coverage_pct"),
    )


def missing_tags(facts: DataFrame, tags: Mapping[str, str] = CANONICAL_TAGS) -> DataFrame:
    return tag_matches(facts, tags).filter(~F.col("found")).select("concept_name").orderBy(
        "concept_name"
    )


def found_tags(facts: DataFrame, tags: Mapping[str, str] = CANONICAL_TAGS) -> DataFrame:
    """Wanted concepts that occur, as a set intersection."""
    wanted = tag_table(facts.sparkSession, tags).select("concept_name")
    return wanted.intersect(distinct_concepts(facts))
