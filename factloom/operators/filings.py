"""Filing metadata: derived columns, requested filings, deduplication."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.constants import ARCHIVE_MARK, ARCHIVE_URL, SITE_URL
from factloom.functions.text import (
    parse_date,
    parse_two_formats,
    present,
    url_segment,
    without_dashes,
    zero_fill,
)
from factloom.operators.align import align, first_per_key, stack_aligned
from factloom.operators.universe import lookup_cik
from factloom.schemas import FILINGS, RAW_FILING
from factloom.sources.html import index_rows


def rows_from_columnar(df: DataFrame, arrays: str, keep: list[str]) -> DataFrame:
    """Rows from a struct of parallel arrays.

    The length of ``accessionNumber`` sets the row count, shorter arrays give
    null, fields that are no arrays give null. ``position`` is the array index.
    """
    fields = df.schema[arrays].dataType.fields
    indexed = df.select(
        *keep,
        F.col(arrays),
        F.posexplode(F.col(f"{arrays}.accessionNumber")).alias("position", "__number"),
    )
    values = [
        (
            F.get(F.col(arrays)[f.name], F.col("position"))
            if isinstance(f.dataType, T.ArrayType)
            else F.lit(None).cast("string")
        ).alias(f.name)
        for f in fields
    ]
    return indexed.select(*keep, F.col("position").cast("bigint").alias("position"), *values)


def align_raw(df: DataFrame, keep: list[str]) -> DataFrame:
    """The six fixed text columns first, then whatever else arrived."""
    fixed = RAW_FILING.fieldNames()
    extra = [c for c in df.columns if c not in fixed and c not in keep]
    return df.select(
        *keep,
        *[
            (F.col(c).try_cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c)
            for c in fixed
        ],
        *extra,
    )


def _archive_folder(cik: Column, accession: Column) -> Column:
    return F.concat(
        F.lit(ARCHIVE_URL + "edgar/data/"),
        cik.try_cast("bigint").cast("string"),
        F.lit("/"),
        without_dashes(accession),
        F.lit("/"),
    )


def derive_filings(raw: DataFrame, processed_at: datetime | None = None) -> DataFrame:
    """The filings schema from raw rows that carry ``ticker`` and ``cik``.

    Only plain 10-K forms with a readable filing date stay.
    """
    padded = zero_fill(F.col("cik").cast("string"))
    folder = _archive_folder(F.col("cik"), F.col("accessionNumber"))
    dated = (
        raw.filter(F.col("form") == "10-K")
        .withColumns(
            {
                "cik": padded,
                "filing_date_dt": parse_date(F.col("filingDate")),
                "report_date_dt": parse_date(F.col("reportDate")),
            }
        )
        .filter(F.col("filing_date_dt").isNotNull())
        .withColumns(
            {
                "filing_year": F.year("filing_date_dt").cast("bigint"),
                "documents_url": F.concat(folder, F.col("accessionNumber"), F.lit("-index.html")),
                "xbrl_instance_url": F.when(
                    present(F.col("primaryDocument")), F.concat(folder, F.col("primaryDocument"))
                ),
                "processed_datetime": (
                    F.lit(processed_at) if processed_at else F.current_timestamp()
                ).cast("timestamp_ntz"),
            }
        )
    )
    return align(dated, FILINGS)


def filings_of_year(filings: DataFrame, year: int) -> DataFrame:
    return filings.filter(F.col("filing_year") == year)


def requested_filings(
    pairs: DataFrame,
    mapping: DataFrame,
    raw: DataFrame,
    processed_at: datetime | None = None,
) -> DataFrame:
    """All 10-K filings of the requested (ticker, year) pairs, by company number and year.

    Form and date are tested on the raw side before the join, so only 10-K rows
    are shuffled. Several filings per pair are all kept.
    """
    wanted = lookup_cik(pairs, mapping).select("ticker", "cik", "filing_year")
    annual = (
        raw.filter(F.col("form") == "10-K")
        .drop("ticker")
        .withColumns(
            {
                "cik": zero_fill(F.col("cik").cast("string")),
                "filing_year": F.year(parse_date(F.col("filingDate"))).cast("bigint"),
            }
        )
        .filter(F.col("filing_year").isNotNull())
    )
    return derive_filings(annual.join(wanted, ["cik", "filing_year"]), processed_at)


def dedup_filings(*frames: DataFrame, order: str | None = None) -> DataFrame:
    """Frames stacked in order; the first row per ticker, year and accession number wins."""
    ranked = [f.withColumn("__source", F.lit(i)) for i, f in enumerate(frames)]
    schema = T.StructType(FILINGS.fields + [T.StructField("__source", T.IntegerType())])
    if order:
        schema = schema.add(order, dict(frames[0].dtypes)[order])
    stacked = stack_aligned(schema, *ranked)
    keys = ["ticker", "filing_year", "accessionNumber"]
    rest = [F.col(order)] if order else [F.col("filingDate"), F.col("primaryDocument")]
    return align(first_per_key(stacked, keys, F.col("__source"), *rest), FILINGS)


def usable_filings(filings: DataFrame) -> DataFrame:
    """Filings that carry both an instance address and a ticker."""
    return filings.filter(present(F.col("xbrl_instance_url")) & present(F.col("ticker")))


def valid_filings(filings: DataFrame, start_year: int, end_year: int) -> DataFrame:
    """Filings with a YYYY-MM-DD shaped date in the year range and an accession number."""
    spelled = [c for c in ("accessionNumber", "accession_number") if c in filings.columns]
    number = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in spelled])
    date = F.col("filingDate").cast("string")
    return filings.filter(
        date.rlike(r"^.{4}-.{2}-.{2}\z")
        & F.substring(date, 1, 4).try_cast("int").between(start_year, end_year)
        & number.isNotNull()
    )


def year_label(date: Column) -> Column:
    """Year of a date in either of two formats, else ``unknown_year``."""
    return F.coalesce(F.year(parse_two_formats(date)).cast("string"), F.lit("unknown_year"))


def accession_number(number: Column, documents_url: Column) -> Column:
    """The number itself, else the second-to-last segment of an archive address."""
    return F.when(present(number), number).when(
        documents_url.contains(ARCHIVE_MARK), url_segment(documents_url, -2)
    )


def has_embedded_xbrl(raw: Column) -> Column:
    lowered = F.lower(raw)
    return lowered.contains("<xbrl") | lowered.contains("xmlns:xbrl")


def instance_url_candidates(documents_url: Column, ticker: Column, year: Column) -> Column:
    """Four likely instance addresses next to an index page; the first is the one to use."""
    base = F.substring_index(documents_url, "/index.html", 1)
    stem = F.concat(base, F.lit("/"), F.lower(ticker))
    return F.array(
        F.concat(stem, F.lit("-"), year, F.lit("0101.xml")),
        F.concat(stem, F.lit("-"), year, F.lit("1231.xml")),
        F.concat(stem, F.lit(".xml")),
        F.concat(base, F.lit("/Financial_Report.xml")),
    )


def absolute_url(href: Column) -> Column:
    return F.when(href.startswith("/"), F.concat(F.lit(SITE_URL), href)).otherwise(href)


def xbrl_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Links of an index page whose row speaks of XML or XBRL, in page order."""
    keep = [c for c in pages.columns if c != html]
    rows = pages.select(*keep, F.posexplode(index_rows(F.col(html))).alias("place", "row"))
    label, href = F.col("row.label"), F.col("row.href")
    return rows.filter((label.contains("xml") | label.contains("xbrl")) & present(href)).select(
        *keep, "place", absolute_url(href).alias("url")
    )


def filings_per_ticker(filings: DataFrame) -> DataFrame:
    """The filings of each ticker and filing year as a list of records in date order.

    A list per year keeps the date order over the lists of a ticker, and no list grows with the
    number of years.
    """
    record = F.struct("filingDate", "accessionNumber", "cik", "documents_url")
    return filings.groupBy("ticker", "filing_year").agg(
        F.sort_array(F.collect_list(record)).alias("filings")
    )
