"""Tags are matched in the row of their page, with the same rows as a join."""

from test_fact_tags import PAGES

from factloom.operators.ixbrl import match_facts, match_tags, unmatched_tags
from factloom.sources.html import fact_tags

FACTS = [
    (1, "1", "B", 0), (1, "1", "C", 2), (1, "1", "A", 1), (1, "3", "G", 1), (1, "", "E", 3),
    (1, None, "N", 4), (3, "b", "bare", 0), (9, "1", "other", 0), (None, "1", "lost", 0),
]


def _inputs(spark):
    facts = spark.createDataFrame(
        FACTS, "filing_id int, fact_id string, concept_name string, pos int"
    )
    return spark.createDataFrame(PAGES, "filing_id int, html string"), facts


def test_the_same_rows_as_a_join(spark):
    pages, facts = _inputs(spark)
    want = match_facts(fact_tags(pages), facts).select(
        "filing_id", "fact_id", "kind", "name", "concept_name", "matched"
    )
    got = match_tags(pages, facts)
    assert got.columns == want.columns and want.count() == 7
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    unknown = unmatched_tags(fact_tags(pages), facts).collect()
    assert sorted(map(str, unmatched_tags(got).collect())) == sorted(map(str, unknown))


def test_tags_are_not_shuffled(spark):
    pages, facts = _inputs(spark)
    plan = match_tags(pages, facts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]
