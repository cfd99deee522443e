"""Fact tags read alone are those that a whole reading finds."""

from factloom.operators.ixbrl import match_facts, match_report
from factloom.sources.html import document_parts, fact_tags

PAGES = [
    (1, '<h1>x</h1><ix:nonFraction name="a:B" id="1">5</ix:nonFraction><p>t</p>'
        "<IX:NonNumeric ID='2' NAME=c:D>w<b><ix:nonfraction name=\"e:F\" id='3'>6</ix:nonfraction></b>"),
    (2, '<!-- <ix:nonfraction id="1"> --><script>"<ix:nonfraction id=2>"</script>'
        '<p title="<ix:nonfraction id=3>">x</p><ix:nonfraction id="" name="n">1</ix:nonfraction>'
        '<ix:nonnumeric id="a&amp;b" id="c"/><template><ix:nonnumeric id="in">x'),
    (3, '<ix:nonfraction name="n">no id</ix:nonfraction><nonnumeric name="bare" id="b">x</nonnumeric>'),
    (4, "<p>none</p>"),
    (5, '<ix:nonfractionx id="1">x</ix:nonfractionx><ix:nonfraction'),
    (6, None),
]


def test_the_same_tags_as_a_whole_reading(spark):
    pages = spark.createDataFrame(PAGES, "filing_id int, html string")
    columns = ["filing_id", "kind", "name", "fact_id"]
    want = document_parts(pages).filter("kind = 'fact'").select(*columns).collect()
    got = fact_tags(pages).select(*columns).collect()
    assert len(want) == 7 and sorted(map(str, got)) == sorted(map(str, want))


def test_a_report_needs_no_other_columns(spark, rows):
    pages = spark.createDataFrame(PAGES, "filing_id int, html string")
    facts = spark.createDataFrame(
        [(1, "1", "B", 0), (1, "3", "G", 1), (3, "b", "bare", 0)],
        "filing_id int, fact_id string, concept_name string, pos int",
    )
    report = match_report(match_facts(fact_tags(pages), facts))
    assert sorted(rows(report)) == [(1, 3, 2, 1, 0), (2, 3, 0, 2, 1), (3, 1, 1, 0, 0)]
