"""Securities, year ranges, expected and missing pairs, company number lookup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.constants import DEFAULT_YEARS_BACK, EARLIEST_YEAR
from factloom.functions.text import zero_fill
from factloom.operators.align import align, last_per_key
from factloom.schemas import SECURITY


@dataclass(frozen=True)
class YearRange:
    """Bounds given as a year, ``earliest``, ``latest`` or None, seen from ``this_year``."""

    start: int | str | None
    end: int | str | None
    this_year: int

    def __post_init__(self):
        if isinstance(self.start, str) and self.start != "earliest":
            raise ValueError(f"start must be a year, 'earliest' or None, not {self.start!r}")
        if isinstance(self.end, str) and self.end != "latest":
            raise ValueError(f"end must be a year, 'latest' or None, not {self.end!r}")

    @property
    def bounds(self) -> tuple[int, int]:
        back = self.this_year - DEFAULT_YEARS_BACK
        low = {None: back, "earliest": EARLIEST_YEAR}.get(self.start, self.start)
        high = {None: self.this_year, "latest": self.this_year}.get(self.end, self.end)
        # Two plain years in the wrong order mean the first one alone.
        if low > high and self.start != "earliest" and self.end != "latest":
            high = low
        return low, high

    @property
    def years(self) -> list[int]:
        low, high = self.bounds
        return list(range(low, high + 1))

    def __str__(self) -> str:
        low, high = self.bounds
        return f"[{self.start if self.start == 'earliest' else low}-" + (
            f"{self.end if self.end == 'latest' else high}]"
        )


def securities_frame(spark: SparkSession, rows) -> DataFrame:
    """Securities from dictionaries in list order; see :func:`clean_securities`."""
    names = SECURITY.fieldNames()
    listed = [(i, *[row.get(n) for n in names]) for i, row in enumerate(rows)]
    schema = "position bigint, " + ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in SECURITY
    )
    return clean_securities(spark.createDataFrame(listed, schema))


def clean_securities(df: DataFrame, position: str = "position") -> DataFrame:
    """Drop entries without ticker, name or exchange, keep the last per ticker, fill defaults."""
    valid = df.filter(
        F.col("ticker").isNotNull() & F.col("name").isNotNull() & F.col("exchange").isNotNull()
    )
    if position in df.columns:
        valid = last_per_key(valid, ["ticker"], position)
    return align(valid, SECURITY).withColumns(
        {
            "currency": F.coalesce("currency", F.lit("USD")),
            "country": F.coalesce("country", F.lit("US")),
        }
    )


def add_securities(securities: DataFrame, added: DataFrame) -> DataFrame:
    """Union in which an added security replaces one of the same ticker."""
    kept = securities.join(added.select("ticker"), "ticker", "left_anti")
    return align(kept, SECURITY).unionByName(align(added, SECURITY))


def remove_security(securities: DataFrame, ticker: str) -> DataFrame:
    return securities.filter(F.col("ticker") != ticker)


def get_security(securities: DataFrame, ticker: str) -> DataFrame:
    return securities.filter(F.col("ticker") == ticker)


def tickers(securities: DataFrame) -> DataFrame:
    return securities.select("ticker").distinct()


def expected_pairs(securities: DataFrame, years: YearRange) -> DataFrame:
    """Every ticker with every year of the range, generated row by row without a join."""
    low, high = years.bounds
    pairs = securities.select(
        "ticker",
        F.explode(F.sequence(F.lit(low).cast("bigint"), F.lit(max(low, high)).cast("bigint"))).alias(
            "filing_year"
        ),
    )
    return pairs if low <= high else pairs.filter(F.lit(False))


def missing_pairs(expected: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Expected pairs without a filing, in order; a table without both columns covers nothing.

    The existing side is reduced to its distinct pairs before it is shuffled.
    """
    keys = ["ticker", "filing_year"]
    if existing is None or not set(keys) <= set(existing.columns):
        return expected.select(*keys).orderBy(*keys)
    have = (
        existing.select("ticker", F.col("filing_year").try_cast("bigint").alias("filing_year"))
        .filter(F.col("ticker").isNotNull() & F.col("filing_year").isNotNull())
        .distinct()
    )
    return expected.join(have, keys, "left_anti").select(*keys).orderBy(*keys)


def parse_ticker_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Ticker and company number from tab-split lines; only lines with two fields count.

    A ``position`` column, where given, lets the later of two equal tickers win.
    """
    parts = F.split(F.btrim(F.col(column)), "\t")
    keep = ["position"] if "position" in lines.columns else []
    parsed = (
        lines.withColumn("parts", parts)
        .filter(F.size("parts") == 2)
        .select(
            F.upper(F.col("parts")[0]).alias("ticker"),
            zero_fill(F.col("parts")[1]).alias("cik"),
            *keep,
        )
    )
    if not keep:
        return parsed
    return last_per_key(parsed, ["ticker"], "position").drop("position")


def lookup_cik(tickers_df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Company number per ticker by upper-cased key; the ticker keeps its spelling."""
    known = mapping.select(F.col("ticker").alias("key"), "cik")
    return tickers_df.join(known, F.upper(tickers_df["ticker"]) == F.col("key")).drop("key")


def tickers_without_cik(tickers_df: DataFrame, mapping: DataFrame) -> DataFrame:
    known = mapping.select(F.col("ticker").alias("key"))
    return tickers_df.join(known, F.upper(tickers_df["ticker"]) == F.col("key"), "left_anti")


def same_tickers(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """One row, one flag: do both sides hold exactly the same tickers?"""
    left, right = tickers(stored), tickers(expected)
    extra = left.join(right, "ticker", "left_anti").unionByName(
        right.join(left, "ticker", "left_anti")
    )
    return extra.agg((F.count(F.lit(1)) == 0).alias("same_tickers"))
