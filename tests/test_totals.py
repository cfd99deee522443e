from driver_queries.catalogue_stores import _string_totals


def test_string_totals_sort_no_stored_rows(spark):
    rows = [("A", v, d) for v in ("T2", "T10") for d in ("1998-03-02", "1997-12-31")] + [
        ("B", None, None),
        ("B", "T1", "1996-02-29"),
    ]
    stored = spark.createDataFrame(rows, "concept_name string, value string, date string")
    totals = _string_totals(stored)
    assert sorted(map(tuple, totals.collect())) == [
        ("A", 4, "T2", "1997-12-31"),
        ("B", 2, "T1", "1996-02-29"),
    ]
    plan = totals._jdf.queryExecution().toString().partition("== Physical Plan ==")[2]
    assert " HashAggregate(keys=[concept_name" in plan.replace("- ", " ")
