from factloom.operators import facts


def test_facts_stream_past_their_filings(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "filing_id int, fact_id string")
    filings = spark.createDataFrame(
        [(1, "T", "2024-02-01", "2023-12-31")],
        "filing_id int, ticker string, filing_date_dt string, report_date_dt string",
    )
    joined = facts.with_filing(rows, filings)
    assert sorted(r["fact_id"] for r in joined.collect()) == ["a", "b"]
    plan = joined._jdf.queryExecution().toString().partition("== Physical Plan ==")[2]
    assert "ShuffledHashJoin" in plan and "Sort " not in plan
