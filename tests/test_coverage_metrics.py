import datetime

from pyspark.sql import functions as F

from factloom.operators import coverage, facts, metrics

D = datetime.date


def numeric(spark):
    return spark.createDataFrame(
        [
            ("Assets", D(2024, 1, 1), "A", 1.0),
            ("Assets", D(2024, 1, 1), "A", 2.0),
            ("Assets", D(2024, 1, 1), "B", 2.0),
            ("Assets", None, "B", 2.0),
            ("Assets", D(2024, 1, 1), None, 2.0),
            ("Goodwill", D(2024, 1, 1), "A", 3.0),
            ("Odd", D(2024, 2, 1), "A", 3.0),
        ],
        "concept_name string, filing_date date, ticker string, fact_value double",
    )


def test_coverage_counts_null_keys_once(spark, rows):
    got = dict(rows(coverage.concept_coverage(numeric(spark))))
    assert got == {"Assets": 3, "Goodwill": 1, "Odd": 1}
    assert coverage.filing_count(numeric(spark)).first()[0] == 5


def test_coverage_shares(spark, rows):
    clean = numeric(spark).filter("filing_date is not null and ticker is not null")
    assert coverage.filing_count(clean).first()[0] == 3
    assert rows(coverage.top_coverage(clean, 0.5, 10)) == [("Assets", 2)]
    assert rows(coverage.concepts_in_all_filings(clean)) == []
    assert rows(coverage.concepts_in_all_filings(clean.filter("ticker = 'B'"))) == [("Assets", 1)]


def test_tags(spark, rows):
    got = coverage.tag_coverage(numeric(spark)).first()
    assert (got["wanted"], got["found"]) == (65, 2)
    assert round(got["coverage_pct"], 4) == round(200 / 65, 4)
    assert coverage.missing_tags(numeric(spark)).count() == 63
    assert sorted(rows(coverage.found_tags(numeric(spark)))) == [("Assets",), ("Goodwill",)]
    tagged = coverage.with_canonical_tag(numeric(spark)).select("concept_name", "tag").distinct()
    assert dict(rows(tagged)) == {"Assets": "assets_total", "Goodwill": "goodwill", "Odd": None}
    assert len(set(coverage.CANONICAL_TAGS.values())) == 52


FACT = (
    "filing_id long, pos int, concept_name string, prefix string, schema_url string, value string, "
    "unit string, period_instant date, period_start date, period_end date, context_scenario string"
)


def fact(fid, pos, name, value, prefix="us-gaap", end=D(2023, 12, 31), instant=None, scenario=None):
    url = f"http://x.org/{prefix}/2023"
    start = D(2023, 1, 1) if end else None
    return (fid, pos, name, prefix, url, value, "USD", instant, start, end, scenario)


def instance(spark, *rows):
    return spark.createDataFrame(list(rows), FACT)


def test_latest_metric_order(spark, rows):
    df = instance(
        spark,
        fact(1, 0, "Assets", "5", prefix="dei", end=None, instant=D(2025, 1, 1)),
        fact(1, 1, "Assets", "6", prefix="ifrs-full", end=D(2030, 1, 1)),
        fact(1, 2, "Assets", "7", end=None, instant=D(2022, 1, 1)),
        fact(1, 3, "Assets", "8", end=None, instant=D(2023, 1, 1)),
        fact(1, 4, "Assets", "9", end=None, instant=D(2023, 1, 1)),
        fact(1, 5, "Assets", "10", end=None, instant=None),
        fact(1, 6, "Revenue", "1", prefix="acme"),
        fact(2, 0, "Revenue", "11", prefix="dei"),
    )
    got = metrics.latest_metrics(df)
    assert sorted(rows(got, "filing_id", "metric", "value")) == [
        (1, "Assets", "8"), (2, "Revenue", "11"),
    ]


def test_segment_values_can_be_left_out(spark):
    df = instance(
        spark,
        fact(1, 0, "Revenue", "1", scenario="segment=a", end=D(2024, 1, 1)),
        fact(1, 1, "Revenue", "2"),
    )
    assert metrics.latest_metrics(df).first()["value"] == "1"
    assert metrics.latest_metrics(df, plain_only=True).first()["value"] == "2"


def test_derived(spark, rows):
    df = instance(
        spark,
        fact(1, 0, "Assets", "10.5"),
        fact(1, 1, "Liabilities", "4"),
        fact(1, 2, "NetIncomeLoss", "-1"),
        fact(1, 3, "Revenue", "8"),
        fact(2, 0, "NetIncomeLoss", "1"),
        fact(2, 1, "Revenue", "0"),
        fact(3, 0, "Assets", "n/a"),
        fact(3, 1, "Liabilities", "1"),
        fact(3, 2, "Revenue", "0"),
    )
    got = metrics.derived_metrics(metrics.latest_metrics(df))
    assert sorted(rows(got, "filing_id", "metric", "value", "unit")) == [
        (1, "DerivedEquity", 6.5, "USD"),
        (1, "DerivedNetMargin", -12.5, "%"),
        (2, "DerivedNetMargin", 0.0, "%"),
    ]


def test_revenue_series(spark, rows):
    best = "RevenueFromContractWithCustomerExcludingAssessedTax"
    df = instance(
        spark,
        fact(1, 0, "Revenue", "1"),
        fact(1, 1, "Revenues", "2"),
        fact(2, 0, "Revenues", "3"),
        fact(2, 1, best, "many"),
        fact(3, 0, "Revenues", "4"),
        fact(4, 0, "Revenues", "5"),
    )
    filings = spark.createDataFrame(
        [
            (1, "B", "2023-06-30", "u"),
            (2, "A", "2023-06-30", "u"),
            (3, "A", "bad", "u"),
            (4, "A", "2022-06-30", None),
        ],
        "filing_id long, ticker string, reportDate string, xbrl_instance_url string",
    )
    got = rows(metrics.revenue_series(filings, df), "ticker", "year", "revenue")
    assert got == [("B", 2023, 2.0)]


def test_projection_and_filters(spark):
    df = instance(
        spark,
        fact(1, 0, "Revenue", "1"),
        fact(1, 1, "Revenue", "2", prefix="ifrs"),
        fact(1, 2, "Custom", "3", prefix="custom"),
    )
    assert [r["pos"] for r in facts.us_gaap_facts(df).collect()] == [0]
    wide = df.withColumns(
        {
            "fact_type": F.lit("NumericFact"),
            "decimals": F.lit("INF"),
            "precision": F.lit("4"),
            "ticker": F.lit("A"),
            "filing_date": F.lit(D(2024, 1, 1)),
            "report_date": F.lit(D(2023, 12, 31)),
        }
    )
    row = facts.numeric_facts(wide).filter("concept_name = 'Custom'").first()
    assert row["concept_namespace"] == "custom" and row["fact_value"] == 3.0
    assert tuple(row["metadata"]) == (None, 4)
    assert facts.of_report_year(wide, 2023).count() == 3
    assert facts.of_report_year(wide.withColumn("report_date", F.lit("x")), 1900).count() == 3


def test_merged_sketches_are_those_of_all_facts(spark, tmp_path, rows):
    listed = [(f"c{k % 3}", None if k % 50 == 0 else f"d{k % 40}", f"t{k % 7}") for k in range(600)]
    facts = spark.createDataFrame(listed, "concept_name string, filing_date string, ticker string")
    path = str(tmp_path / "sketches")
    for part in range(3):
        # Batches overlap: every row of the second is in the third too.
        chosen = facts if part == 2 else facts.filter(f"ticker < 't{3 + part}'")
        stored = coverage.refresh_sketches(chosen, path)
    exact = dict(rows(coverage.concept_coverage(facts), "concept_name", "num_filings"))
    found = dict(rows(coverage.estimated_coverage(stored), "concept_name", "num_filings"))
    assert set(found) == set(exact)
    assert all(abs(found[c] - exact[c]) <= 0.02 * exact[c] + 1 for c in exact)
    whole = coverage.estimated_coverage(coverage.coverage_sketches(facts))
    assert dict(rows(whole, "concept_name", "num_filings")) == found
    assert coverage.estimated_coverage(coverage.coverage_sketches(facts.limit(0))).count() == 0


def test_first_row_per_concept_sorts_no_whole_table(spark):
    rows = [
        (c, d, n)
        for c in ("A", "B", None)
        for d in (3, 1, 2, None if c == "B" else 4)
        for n in ("y", "x")
    ]
    facts = spark.createDataFrame(rows, "concept_name string, day int, name string")
    first = coverage.first_row_per_concept(facts, "day", "name")
    assert sorted(map(tuple, first.collect()), key=str) == sorted(
        [("A", 1, "x"), ("B", None, "x"), (None, 1, "x")], key=str
    )
    plan = first._jdf.queryExecution().toString().partition("== Physical Plan ==")[2]
    assert "BroadcastHashJoin" in plan and " HashAggregate(keys=[concept_name" in plan.replace("- ", " ")
