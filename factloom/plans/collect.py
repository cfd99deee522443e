"""Collect filings: find missing pairs, derive their rows, merge, store."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from factloom.operators.filings import dedup_filings, requested_filings
from factloom.operators.universe import YearRange, expected_pairs, missing_pairs
from factloom.schemas import FILINGS
from factloom.session import cut_lineage
from factloom.sources.tables import (
    append_rows,
    format_of,
    replace_table,
    scan_table,
    table_exists,
)


def merged_filings(
    securities: DataFrame,
    years: YearRange,
    mapping: DataFrame,
    raw: DataFrame,
    existing: DataFrame | None = None,
    processed_at: datetime | None = None,
) -> DataFrame:
    """Stored filings plus those of missing pairs, one lazy plan."""
    missing = missing_pairs(expected_pairs(securities, years), existing)
    added = requested_filings(missing, mapping, raw, processed_at)
    return dedup_filings(*([existing] if existing is not None else []), added)


def collect_filings(
    securities: DataFrame,
    years: YearRange,
    mapping: DataFrame,
    raw: DataFrame,
    path: str,
    fmt: str | None = None,
    force_check: bool = False,
    processed_at: datetime | None = None,
) -> DataFrame:
    """The stored table, completed when it is absent or a check is forced.

    What is added belongs to pairs without any stored filing, so it is appended and no stored row is
    written again.
    """
    spark = securities.sparkSession
    fmt = fmt or format_of(path)
    existing = scan_table(spark, path, FILINGS, fmt) if table_exists(spark, path) else None
    if existing is not None:
        if not force_check:
            return existing
        missing = missing_pairs(expected_pairs(securities, years), existing)
        if missing.isEmpty():
            return existing
        added = cut_lineage(
            dedup_filings(requested_filings(missing, mapping, raw, processed_at)), "added"
        )
        if not added.isEmpty():
            append_rows(added, path, fmt)
        return scan_table(spark, path, FILINGS, fmt)
    return replace_table(
        merged_filings(securities, years, mapping, raw, None, processed_at), path, fmt
    )
