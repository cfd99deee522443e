"""Filings matched, walked and rendered in their row, next to the same by joins and windows."""

import datetime

from factloom.operators import ixbrl, render
from factloom.sources.html import document_parts

FACT = '<ix:nonNumeric name="a:Note" contextRef="c" id="{}">{}</ix:nonNumeric>'
PAGES = [
    # Text before any heading, an unknown fact, facts in facts, two headings in a row.
    (1, "<html><body>first" + FACT.format("x", "open <b>in</b>") + "<h1>One</h1>"
        + FACT.format("k", "a" + FACT.format("m", "b") + "c") + "tail<h2>Two</h2><h3></h3>end"
        + FACT.format("m", "again") + "<h2>last</h2></body></html>"),
    # A known fact inside a heading is not reached; no text stands before the next heading.
    (2, "<html><body><h1>Head" + FACT.format("k", "v") + "</h1>" + FACT.format("n", "w") + "</body></html>"),
    # Nothing but an unknown fact; a filing without fact ids has no parts; an empty page.
    (3, "<html><body>" + FACT.format("k", "alone") + "</body></html>"),
    (4, "<html><body><h1>T</h1>no facts</body></html>"),
    (5, None),
    (6, "<html><body>" + "".join(f"<h2>S{i}</h2>t{i}" + FACT.format(f"i{i}", "v") for i in range(700)) + "</body></html>"),
]
DAY = datetime.date(2024, 1, 31)
FACTS = [
    (1, "k", "1", "Old", "TextFact", "old", None, None),
    (1, "k", "2", "New", "TextFact", " A &amp; <b>B</b><script>x</script> ", None, DAY),
    (1, "m", "3", "Price", "NumericFact", "1.5", "usd", DAY),
    (1, "", "4", "NoId", "NumericFact", "2", None, None),
    (2, "k", "1", "Inside", "TextFact", "plain", None, None),
    (2, "n", "1", None, "TextFact", "no name", None, None),
    (4, "k", "1", "Unused", "TextFact", "x", None, None),
    *[(6, f"i{i}", "1", f"C{i}", "NumericFact", str(i), "usd", None) for i in range(0, 700, 3)],
]
FACT_TYPE = (
    "filing_id long, fact_id string, pos string, concept_name string, fact_type string,"
    " value string, unit string, period_instant date"
)
REST = ["prefix", "schema_url", "decimals", "precision", "context_id", "context_entity"]


def _inputs(spark):
    pages = spark.createDataFrame(PAGES, "filing_id long, html string")
    none = [f"cast(null as string) as {c}" for c in [*REST, "context_scenario"]]
    dates = ["cast(null as date) as period_start", "cast(null as date) as period_end"]
    return pages, spark.createDataFrame(FACTS, FACT_TYPE).selectExpr("*", *none, *dates)


def test_rows_are_those_of_joins_and_windows(spark):
    pages, facts = _inputs(spark)
    want = ixbrl.parse_documents(document_parts(pages), facts)
    have = ixbrl.section_parts(ixbrl.filing_sections(pages, facts)).select(*want.columns)
    assert sorted(map(repr, have.collect())) == sorted(map(repr, want.collect()))
    assert [t for _, t in have.dtypes] == [t for _, t in want.dtypes]


def test_documents_are_those_put_together_by_groups(spark):
    pages, facts = _inputs(spark)
    parts = ixbrl.parse_documents(document_parts(pages), facts)
    for form in (render.MarkdownFormat(), render.MarkdownFormat(1), render.PlainFormat(level=1)):
        want = dict(render.render_documents(parts, form).collect())
        assert dict(render.render_pages(pages, facts, form).collect()) == want
        assert set(want) == {1, 2, 6}


def test_parts_are_not_shuffled(spark):
    """Only facts and pages are dealt by filing, before pages are read."""
    pages, facts = _inputs(spark)
    for df in (
        ixbrl.section_parts(ixbrl.filing_sections(pages, facts)),
        render.render_pages(pages, facts, render.PlainFormat()),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("MapInArrow")]
