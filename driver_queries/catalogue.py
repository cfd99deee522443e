"""One entry per operator: name -> callable from (spark, sf_dir) to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driver_queries import adapters as A
from factloom.functions import text as X
from factloom.operators import coverage, facts, filings, metrics, universe
from factloom.operators.align import align, stack_columns
from factloom.schemas import FILINGS
from factloom.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def text_of(*names: str):
    """Columns as text, for types that drivers print differently."""
    return [F.col(n).cast("string").alias(n) for n in names]


YEARS = universe.YearRange(A.FIRST_YEAR, A.LAST_YEAR, this_year=A.LAST_YEAR)
STAMP = datetime(2024, 1, 1)

# --- coverage ----------------------------------------------------------------


@query
def concept_coverage(spark, sf):
    return coverage.concept_coverage(A.numeric_facts(spark, sf))


@query
def concept_coverage_sketched(spark, sf):
    """Sketches of one half of the orders, then of the other merged into them, next to exact counts."""
    facts, path = A.numeric_facts(spark, sf), scratch_path(spark, "sketches")
    coverage.refresh_sketches(facts.filter("l_orderkey % 2 = 0"), path)
    stored = coverage.refresh_sketches(facts.filter("l_orderkey % 2 = 1"), path)
    estimated = coverage.estimated_coverage(stored).withColumnRenamed("num_filings", "estimate")
    both = coverage.concept_coverage(facts).join(estimated, "concept_name")
    near = F.abs(F.col("estimate") - F.col("num_filings")) <= F.col("num_filings") * 0.03
    return both.select("concept_name", "num_filings", near.alias("estimate_near"))


@query
def distinct_filings(spark, sf):
    return coverage.distinct_filings(A.numeric_facts(spark, sf)).select(
        *text_of("filing_date"), "ticker"
    )


@query
def filing_count(spark, sf):
    return coverage.filing_count(A.numeric_facts(spark, sf))


@query
def concepts_in_all_filings(spark, sf):
    return coverage.concepts_in_all_filings(A.numeric_facts(spark, sf))


@query
def high_coverage_top10(spark, sf):
    return coverage.top_coverage(A.numeric_facts(spark, sf), 0.9, 10)


@query
def concept_counts(spark, sf):
    return coverage.concept_counts(A.numeric_facts(spark, sf))


@query
def concept_counts_asset(spark, sf):
    return coverage.concept_counts(A.numeric_facts(spark, sf), "Asset")


@query
def distinct_concepts(spark, sf):
    return coverage.distinct_concepts(A.numeric_facts(spark, sf))


@query
def first_row_per_concept(spark, sf):
    order = ["filing_date", "ticker", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return coverage.first_row_per_concept(A.numeric_facts(spark, sf), *order).select(
        "concept_name", *text_of("filing_date"), "ticker", "fact_value", "unit"
    )


@query
def canonical_tags(spark, sf):
    tagged = coverage.with_canonical_tag(A.numeric_facts(spark, sf))
    return tagged.groupBy("tag").agg(
        F.count(F.lit(1)).alias("n_facts"), F.max("fact_value").alias("max_value")
    )


@query
def tag_coverage(spark, sf):
    return coverage.tag_coverage(A.numeric_facts(spark, sf)).withColumn(
        "coverage_pct", F.round("coverage_pct", 6)
    )


@query
def missing_tags(spark, sf):
    return coverage.missing_tags(A.numeric_facts(spark, sf))


@query
def found_tags(spark, sf):
    return coverage.found_tags(A.numeric_facts(spark, sf))


# --- universe ----------------------------------------------------------------


def _securities(spark, sf):
    return universe.clean_securities(A.securities(spark, sf))


@query
def securities_last_wins(spark, sf):
    return _securities(spark, sf).select(
        "ticker", "name", "exchange", "sector", "industry", "currency", "country"
    )


@query
def securities_added(spark, sf):
    """Suppliers join the universe of customers; equal tickers are replaced."""
    added = A.table(spark, sf, "supplier").select(
        A.ticker_of(F.col("s_suppkey")).alias("ticker"),
        F.col("s_name").alias("name"),
        F.lit("SUPPLY").alias("exchange"),
    )
    both = universe.add_securities(_securities(spark, sf), universe.clean_securities(added))
    return both.select("ticker", "name", "exchange", "currency", "country")


@query
def security_removed(spark, sf):
    return universe.remove_security(_securities(spark, sf), "T000001").select("ticker", "name")


@query
def security_by_ticker(spark, sf):
    return universe.get_security(_securities(spark, sf), "T000001").select("ticker", "name")


@query
def expected_pairs(spark, sf):
    return universe.expected_pairs(_securities(spark, sf), YEARS)


def _stored_filings(spark, sf):
    """Filings collected before: the finished orders."""
    return filings.derive_filings(
        A.raw_filings(spark, sf).filter("o_orderstatus = 'F'"), STAMP
    )


@query
def missing_pairs(spark, sf):
    expected = universe.expected_pairs(_securities(spark, sf), YEARS)
    return universe.missing_pairs(expected, _stored_filings(spark, sf))


def _mapping(spark, sf):
    return universe.parse_ticker_lines(A.ticker_lines(spark, sf))


@query
def ticker_file(spark, sf):
    return _mapping(spark, sf)


@query
def cik_lookup(spark, sf):
    return universe.lookup_cik(_securities(spark, sf).select("ticker"), _mapping(spark, sf))


@query
def cik_unmatched(spark, sf):
    return universe.tickers_without_cik(
        _securities(spark, sf).select("ticker"), _mapping(spark, sf)
    )


@query
def same_ticker_sets(spark, sf):
    return universe.same_tickers(A.numeric_facts(spark, sf), _securities(spark, sf))


# --- filings -----------------------------------------------------------------

FILING_TEXT = [f.name for f in FILINGS if f.name != "processed_datetime"]


def _show_filings(df):
    return df.select(
        *[c for c in FILING_TEXT if not c.endswith("_dt")],
        *text_of("filing_date_dt", "report_date_dt"),
    )


@query
def filings_derive(spark, sf):
    return _show_filings(filings.derive_filings(A.raw_filings(spark, sf), STAMP))


@query
def filings_for_pairs(spark, sf):
    wanted = universe.expected_pairs(_securities(spark, sf), YEARS)
    return _show_filings(
        filings.requested_filings(wanted, _mapping(spark, sf), A.raw_filings(spark, sf), STAMP)
    )


@query
def filings_dedup(spark, sf):
    """Stored rows win over newly derived ones of the same number."""
    stored = _stored_filings(spark, sf).withColumn("primaryDocDescription", F.lit("Stored"))
    derived = filings.derive_filings(A.raw_filings(spark, sf), STAMP)
    return filings.dedup_filings(stored, derived).select(
        "ticker", "filing_year", "accessionNumber", "primaryDocDescription"
    )


@query
def collect_filings(spark, sf):
    from factloom.plans.collect import merged_filings

    merged = merged_filings(
        _securities(spark, sf),
        YEARS,
        _mapping(spark, sf),
        A.raw_filings(spark, sf),
        _stored_filings(spark, sf),
        STAMP,
    )
    return _show_filings(merged)


@query
def filings_of_year(spark, sf):
    derived = filings.derive_filings(A.raw_filings(spark, sf), STAMP)
    return _show_filings(filings.filings_of_year(derived, 1998))


@query
def usable_filings(spark, sf):
    derived = filings.derive_filings(A.raw_filings(spark, sf), STAMP)
    return filings.usable_filings(derived).select("ticker", "accessionNumber", "xbrl_instance_url")


@query
def valid_filings(spark, sf):
    return filings.valid_filings(A.raw_filings(spark, sf), 1996, 1999).select(
        "accessionNumber", "filingDate"
    )


@query
def filings_per_ticker(spark, sf):
    grouped = filings.filings_per_ticker(filings.derive_filings(A.raw_filings(spark, sf), STAMP))
    return grouped.select(
        "ticker",
        "filing_year",
        F.size("filings").cast("bigint").alias("n_filings"),
        F.array_join(F.transform("filings", lambda f: f["accessionNumber"]), ",").alias("numbers"),
    )


def _columnar(spark, sf):
    """Index documents: per company parallel arrays, the description array one short."""
    raw = A.raw_filings(spark, sf)
    fields = ["accessionNumber", "filingDate", "reportDate", "form"]
    lists = [
        F.expr(
            f"'[' || listagg(to_json(named_struct('v', {f})), ',')"
            " within group (order by o_orderkey) || ']'"
        ).alias(f)
        for f in fields
    ]
    names = F.expr(
        "listagg(coalesce(primaryDocument, '-'), '|') within group (order by o_orderkey)"
    ).alias("documents")
    grouped = raw.groupBy("cik").agg(*lists, names)
    values = {
        f: F.transform(
            F.from_json(f, "array<struct<v:string>>"), lambda s: s["v"]
        )
        for f in fields
    }
    documents = F.split("documents", "\\|")
    short = F.slice(documents, F.lit(1), F.size(documents) - 1)
    recent = F.struct(
        *[v.alias(f) for f, v in values.items()],
        short.alias("primaryDocument"),
        F.lit("x").alias("fileNumber"),
    )
    return grouped.select(
        X.zero_fill(F.col("cik")).alias("cik"),
        F.lit(0).alias("source_rank"),
        F.concat(F.lit("CIK"), X.zero_fill(F.col("cik"))).alias("file_name"),
        F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("value"),
    )


@query
def columnar_json_rows(spark, sf):
    from factloom.sources.submissions import filings_from_json

    rows = filings_from_json(_columnar(spark, sf), ["fileNumber"])
    return rows.select(
        "cik", "position", "accessionNumber", "filingDate", "form", "primaryDocument", "fileNumber"
    )


@query
def columnar_json_others(spark, sf):
    """A field that nobody named, in documents that keep their arrays under ``filings.recent``."""
    from factloom.sources.submissions import filings_from_json

    renamed = F.replace("value", F.lit('"reportDate":'), F.lit('"itemDates":'))
    rows = filings_from_json(_columnar(spark, sf).withColumn("value", renamed), others="others")
    named = F.array_join(F.array_sort(F.map_keys("others")), ",")
    return rows.select(
        "cik", "position", "accessionNumber", "reportDate", named.alias("names"),
        F.col("others")["itemDates"].alias("item_date"),
    )


@query
def filings_union(spark, sf):
    """Diagonal concat of index rows and a frame with other columns."""
    raw = A.raw_filings(spark, sf)
    recent = raw.select("accessionNumber", "form", "filingDate")
    archive = raw.filter("form = '10-K/A'").select(
        "accessionNumber", F.lit("archive").alias("origin")
    )
    both = stack_columns(recent, archive)
    return both.groupBy("form", "origin").agg(
        F.count(F.lit(1)).alias("n"), F.max("accessionNumber").alias("last_number")
    )


@query
def schema_align(spark, sf):
    """Text that is no date or number turns to null, absent columns too."""
    loose = A.raw_filings(spark, sf).select(
        F.lit(1).alias("ignored"),
        "accessionNumber",
        F.col("filingDate").alias("filing_date_dt"),
        F.col("primaryDocument").alias("filing_year"),
        F.col("cik"),
    )
    return align(loose, FILINGS).select(
        "accessionNumber",
        "cik",
        "form",
        F.coalesce("filing_year", F.lit(-1)).alias("filing_year"),
        *text_of("filing_date_dt"),
    )


@query
def two_format_year(spark, sf):
    mixed = (
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "MM/dd/yyyy"))
        .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    )
    return A.table(spark, sf, "orders").select("o_orderkey", filings.year_label(mixed).alias("year"))


@query
def accession_from_url(spark, sf):
    derived = filings.derive_filings(A.raw_filings(spark, sf), STAMP)
    given = F.when(F.col("primaryDocument") == "", F.col("accessionNumber"))
    return derived.select(
        F.col("accessionNumber").alias("number"),
        filings.accession_number(given, F.col("documents_url")).alias("recovered"),
    )


@query
def instance_url_candidates(spark, sf):
    derived = filings.derive_filings(A.raw_filings(spark, sf), STAMP)
    index = F.concat(F.col("documents_url"), F.lit("/index.html"))
    urls = filings.instance_url_candidates(
        index, F.col("ticker"), F.substring("filingDate", 1, 4)
    )
    return derived.select("accessionNumber", F.explode(urls).alias("url"))


# --- facts and metrics -------------------------------------------------------


@query
def numeric_facts_direct(spark, sf):
    rows = facts.numeric_facts(A.instance_facts(spark, sf))
    return rows.select(
        "ticker",
        "concept_name",
        "concept_namespace",
        "fact_type",
        "fact_value",
        "unit",
        F.coalesce("metadata.decimals", F.lit(-1)).alias("decimals"),
        *text_of("period_instant", "period_start", "period_end", "filing_date", "report_date"),
    )


@query
def text_facts_direct(spark, sf):
    rows = facts.text_facts(A.instance_facts(spark, sf))
    return rows.select(
        "ticker",
        "concept_name",
        "concept_namespace",
        "fact_value",
        *text_of("period_start", "period_end", "filing_date"),
    )


@query
def us_gaap_facts(spark, sf):
    return facts.us_gaap_facts(A.instance_facts(spark, sf)).select(
        "filing_id", "fact_id", "concept_name", "value"
    )


@query
def facts_with_contexts(spark, sf):
    bare = A.instance_facts(spark, sf).select("filing_id", "fact_id", "context_ref")
    return facts.with_contexts(bare, A.contexts(spark, sf)).select(
        "filing_id",
        "fact_id",
        "context_id",
        "context_entity",
        "context_scenario",
        "period_instant",
        "period_start",
        "period_end",
    )


@query
def facts_with_filing(spark, sf):
    bare = A.instance_facts(spark, sf).select("filing_id", "fact_id", "value")
    described = A.raw_filings(spark, sf).select(
        F.col("o_orderkey").alias("filing_id"),
        "ticker",
        X.parse_date(F.col("filingDate")).alias("filing_date_dt"),
        X.parse_date(F.col("reportDate")).alias("report_date_dt"),
        F.col("primaryDocument").alias("xbrl_instance_url"),
    )
    rows = facts.with_filing(bare, filings.usable_filings(described))
    return rows.select("filing_id", "fact_id", "ticker", *text_of("filing_date", "report_date"))


@query
def facts_of_year_and_ticker(spark, sf):
    rows = facts.of_report_year(A.numeric_facts(spark, sf), 1998)
    return facts.concepts(facts.of_ticker(rows, "T000001"), ["Revenues", "Assets"]).select(
        "concept_name", "fact_value", *text_of("report_date")
    )


@query
def latest_fact_per_metric(spark, sf):
    return metrics.latest_metrics(A.instance_facts(spark, sf)).drop("metric_rank")


@query
def derived_metrics(spark, sf):
    rows = metrics.derived_metrics(metrics.latest_metrics(A.instance_facts(spark, sf)))
    return rows.withColumn("value", F.round("value", 6))


def _fact_filings(spark, sf):
    return A.raw_filings(spark, sf).select(
        F.col("o_orderkey").alias("filing_id"),
        "ticker",
        "reportDate",
        F.when(F.col("primaryDocument") != "", F.col("primaryDocument")).alias("xbrl_instance_url"),
    )


@query
def revenue_series(spark, sf):
    rows = metrics.revenue_series(_fact_filings(spark, sf), A.instance_facts(spark, sf))
    return rows.select("ticker", "year", "revenue", "unit", *text_of("report_date"))
