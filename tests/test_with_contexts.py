"""Facts and contexts that are dealt by filing meet without another shuffle."""

from factloom.operators.facts import with_contexts

FACTS = [(1, "a", "x"), (1, "b", "x"), (1, "c", "y"), (2, "d", "x"), (2, "e", None), (None, "f", "x"), (3, "g", "z")]
CONTEXTS = [
    (1, "x", "e1", "s", "instant", "2024-01-01", None, None),
    (1, "y", "e2", None, "duration", "no", "2024-01-01", "2024-02-01"),
    (2, "x", "e3", None, "other", "no", "no", "no"),
    (2, "x", "e4", None, "instant", "2024-03-01", None, None),
    (2, None, "e5", None, "instant", "2024-03-01", None, None),
    (None, "x", "e6", None, "instant", "2024-03-01", None, None),
    (9, "x", "e7", None, "instant", "2024-03-01", None, None),
]
CONTEXT = "filing_id long, context_id string, entity string, scenario string, kind string, instant string, start string, end string"


def test_rows_of_a_left_join(spark):
    facts = spark.createDataFrame(FACTS, "filing_id long, fact_id string, context_ref string")
    found = with_contexts(facts, spark.createDataFrame(CONTEXTS, CONTEXT))
    assert found.columns == [
        "filing_id", "context_ref", "fact_id", "context_id", "context_entity", "context_scenario",
        "period_instant", "period_start", "period_end",
    ]
    none = (None,) * 6
    want = [
        (1, "x", "a", "x", "e1", "s", "2024-01-01", None, None),
        (1, "x", "b", "x", "e1", "s", "2024-01-01", None, None),
        (1, "y", "c", "y", "e2", None, None, "2024-01-01", "2024-02-01"),
        (2, "x", "d", "x", "e3", None, None, None, None),
        (2, "x", "d", "x", "e4", None, "2024-03-01", None, None),
        (2, None, "e", *none), (None, "x", "f", *none), (3, "z", "g", *none),
    ]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def test_no_shuffle_where_both_are_dealt_by_filing(spark):
    facts = spark.createDataFrame(FACTS, "filing_id long, fact_id string, context_ref string")
    contexts = spark.createDataFrame(CONTEXTS, CONTEXT)
    found = with_contexts(facts.repartition(4, "filing_id"), contexts.repartition(4, "filing_id"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2
