"""Facts read alone are those of a whole reading, and a reading without contexts has the same parts."""

import random

from test_documents import PAGE
from test_fact_tags import PAGES

from factloom.sources.html import PART_COLUMNS, WALKED, document_parts, read_parts

BITS = [
    '<ix:nonFraction name="a:B" id="1" contextRef="c" unitRef="u">', "</ix:nonfraction>", "<h1>", "</H1>",
    "<IX:NonNumeric ID=2 NAME=c:D contextref=c>", "</ix:nonnumeric>", "<p>", "text ", "&amp; t", "  ", "<br/>",
    "<template>", "</template>", "<head>", "</head>", "<body>", '<html xmlns:a="u&amp;1" XMLNS:c=v>', "<h2/>",
    '<xbrli:context id="c">', "</xbrli:context>", "<startDate>2020-01-01</startDate>", '<xbrli:unit id="u">',
    "<measure>USD</measure>", "</xbrli:unit>", '<explicitMember dimension="d">m</explicitMember>', "<div/>",
]


def _told(rows, columns):
    return [tuple(row.get(c) for c in columns) for row in rows]


def test_parts_by_each_way_of_reading():
    rng = random.Random(5)
    pages = [html or "" for _, html in PAGES] + [PAGE]
    pages += ["".join(rng.choices(BITS, k=rng.randint(1, 40))) for _ in range(3000)]
    some = 0
    for html in pages:
        whole = read_parts(html)
        facts = [row for row in whole if row["kind"] == "fact"]
        some += len(facts) < len(whole)
        assert _told(read_parts(html, facts_only=True), PART_COLUMNS) == _told(facts, PART_COLUMNS)
        assert _told(read_parts(html, resolve=False), WALKED) == _told(whole, WALKED)
    assert some > 1000


def test_rows_of_facts(spark):
    pages = spark.createDataFrame(PAGES, "filing_id int, html string")
    want = document_parts(pages).filter("kind = 'fact'").collect()
    got = document_parts(pages, facts_only=True).collect()
    assert len(want) == 7 and sorted(map(str, got)) == sorted(map(str, want))
