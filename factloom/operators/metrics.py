"""Latest value per metric, derived ratios and the revenue series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.constants import (
    DETAILED_METRICS,
    NAMESPACE_PRIORITY,
    PRIMARY_METRICS,
    REVENUE_TAG_PRIORITY,
)
from factloom.functions.text import float_or_null, parse_date
from factloom.operators.align import align, first_per_key
from factloom.schemas import REVENUE_SERIES


def wanted_metrics(primary: bool = True, detailed: bool = False) -> list[str]:
    return (PRIMARY_METRICS if primary else []) + (DETAILED_METRICS if detailed else [])


def _place(c: Column, names: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), c)


def namespace_rank(prefix: Column, uri: Column) -> Column:
    """Place of the first listed namespace named in the prefix or the address; null if none."""
    rank = F.lit(None).cast("int")
    for place, name in reversed(list(enumerate(NAMESPACE_PRIORITY))):
        hit = F.coalesce(prefix.contains(name), F.lit(False)) | F.coalesce(
            uri.contains(name), F.lit(False)
        )
        rank = F.when(hit, F.lit(place)).otherwise(rank)
    return rank


def _ranked(facts: DataFrame, names: list[str], plain_only: bool) -> DataFrame:
    chosen = facts.filter(F.col("concept_name").isin(names))
    if plain_only:
        chosen = chosen.filter(F.col("context_scenario").isNull())
    return chosen.withColumns(
        {
            "metric_rank": _place(F.col("concept_name"), names),
            "ns_rank": namespace_rank(F.col("prefix"), F.col("schema_url")),
            "latest": F.coalesce("period_end", "period_instant"),
        }
    ).filter(F.col("ns_rank").isNotNull())


def latest_metrics(
    facts: DataFrame,
    names: list[str] | None = None,
    plain_only: bool = False,
) -> DataFrame:
    """One fact per filing and metric.

    The first namespace with any fact wins, then the latest period end, then
    document order. ``plain_only`` leaves out facts of a segment or scenario.
    """
    rows = _ranked(facts, names or wanted_metrics(), plain_only)
    best = first_per_key(
        rows,
        ["filing_id", "concept_name"],
        F.col("ns_rank"),
        F.col("latest").desc_nulls_last(),
        F.col("pos"),
    )
    return best.select(
        "filing_id",
        "metric_rank",
        F.col("concept_name").alias("metric"),
        "value",
        F.coalesce("unit", F.lit("unknown")).alias("unit"),
        F.coalesce(F.col("latest").cast("string"), F.lit("unknown")).alias("period_end"),
        F.coalesce(F.col("period_start").cast("string"), F.lit("unknown")).alias("period_start"),
    )


DERIVED_INPUTS = ["Assets", "Liabilities", "NetIncomeLoss", "Revenue"]


def derived_inputs() -> list[Column]:
    """Aggregates that bring the inputs of one filing side by side.

    They read the output of :func:`latest_metrics`, which has at most one row
    per filing and metric.
    """

    def pick(name: str) -> Column:
        number = float_or_null(F.col("value")).alias("number")
        fields = F.struct(number, "unit", "period_start", "period_end")
        return F.max(F.when(F.col("metric") == name, fields)).alias(name)

    return [pick(name) for name in DERIVED_INPUTS]


def derived_equity() -> Column:
    return F.col("Assets.number") - F.col("Liabilities.number")


def derived_margin() -> Column:
    """Net income in percent of revenue; 0 when revenue is 0."""
    income, revenue = F.col("NetIncomeLoss.number"), F.col("Revenue.number")
    share = F.when(revenue == 0, F.lit(0.0)).otherwise(F.try_divide(income, revenue) * 100)
    return F.when(income.isNotNull(), share)


def derived_metrics(latest: DataFrame) -> DataFrame:
    """Equity and net margin per filing, where both inputs exist and are numbers."""
    wide = (
        latest.filter(F.col("metric").isin(DERIVED_INPUTS))
        .groupBy("filing_id")
        .agg(*derived_inputs())
    )

    def row(name: str, value: Column, unit: Column, source: str):
        return F.struct(
            F.lit(name).alias("metric"),
            value.alias("value"),
            unit.alias("unit"),
            F.col(f"{source}.period_start").alias("period_start"),
            F.col(f"{source}.period_end").alias("period_end"),
        )

    both = F.array(
        row("DerivedEquity", derived_equity(), F.col("Assets.unit"), "Assets"),
        row("DerivedNetMargin", derived_margin(), F.lit("%"), "Revenue"),
    )
    return wide.select("filing_id", F.inline(both)).filter(F.col("value").isNotNull())


def revenue_series(filings: DataFrame, facts: DataFrame, plain_only: bool = False) -> DataFrame:
    """Revenue per filing by tag priority, with ticker and report year.

    ``filings`` needs ``filing_id, ticker, reportDate, xbrl_instance_url``. A
    filing whose chosen value is no number is skipped.
    """
    report_date = parse_date(F.col("reportDate"))
    dated = filings.filter(
        F.col("xbrl_instance_url").isNotNull() & F.col("reportDate").isNotNull()
    ).select("filing_id", "ticker", report_date.alias("report_date"))
    # One pass picks tag, namespace, period and position in that order.
    best = first_per_key(
        _ranked(facts, REVENUE_TAG_PRIORITY, plain_only),
        ["filing_id"],
        F.col("metric_rank"),
        F.col("ns_rank"),
        F.col("latest").desc_nulls_last(),
        F.col("pos"),
    ).select(
        "filing_id",
        float_or_null(F.col("value")).alias("revenue"),
        F.coalesce("unit", F.lit("unknown")).alias("unit"),
    )
    joined = dated.filter(F.col("report_date").isNotNull()).join(
        best.filter(F.col("revenue").isNotNull()), "filing_id"
    )
    return align(joined.withColumn("year", F.year("report_date")), REVENUE_SERIES).orderBy(
        "ticker", "year", "report_date", "revenue"
    )
