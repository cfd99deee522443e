import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import content, facts, ixbrl, render, sections
from factloom.operators.filings import xbrl_links
from factloom.plans import knowledge_base
from factloom.sources.html import document_parts, page_text, visible_strings, visible_text

# A harbour's yearly report: a lead without heading, a list, a table, and a fact nobody knows.
PAGE = """
<html xmlns:us-gaap="http://fasb.org/us-gaap/2023"><body>
<p>Port of Nowhere, year in brief.</p>
<h3>Traffic</h3>
<ul><li>Ferries called daily.</li><li>Cargo came in spring.</li></ul>
<ix:nonFraction id="dues" name="us-gaap:PortDues" contextRef="season" unitRef="eur" decimals="2">875.25</ix:nonFraction>
<ix:nonNumeric id="pilots" name="us-gaap:PilotRules">Board at <b>buoy</b> seven.</ix:nonNumeric>
<h1>Ice and repairs</h1>
<table><tr><td>North pier</td><td>closed
<ix:nonFraction id="floes" name="us-gaap:Floes" contextRef="winter">3</ix:nonFraction></td></tr></table>
<ix:nonFraction id="repairs" name="us-gaap:RepairBalance" contextRef="season" unitRef="eur" decimals="2">-64</ix:nonFraction>
<p>Works go on.</p>
</body></html>
"""
URL = "http://fasb.org/us-gaap/2023"
FACT = (
    "filing_id int, fact_id string, pos int, concept_name string, prefix string, schema_url string, "
    "fact_type string, value string, unit string, decimals string, precision string, "
    "context_id string, context_entity string, context_scenario string, period_instant string, "
    "period_start string, period_end string"
)


def known(spark):
    season = ("season", "Port of Nowhere", None, None, "2021-04-01", "2021-10-31")
    none = (None,) * 6
    listed = [
        ("dues", "PortDues", "NumericFact", "875.25", "iso4217:EUR", "2", season),
        ("pilots", "PilotRules", "TextFact", "Board at buoy seven.", None, None, none),
        ("repairs", "RepairBalance", "NumericFact", "-64", "iso4217:EUR", "2", season),
    ]
    return spark.createDataFrame(
        [
            (1, key, k, name, "us-gaap", URL, kind, value, unit, decimals, None, *context)
            for k, (key, name, kind, value, unit, decimals, context) in enumerate(listed, 1)
        ],
        FACT,
    )


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html, 1)), "filing_id int, html string")


def walk(spark, html, facts_df=None):
    parts = document_parts(pages(spark, html))
    df = ixbrl.parse_documents(parts, facts_df if facts_df is not None else known(spark))
    return [
        (r["section_idx"], r["section_title"], r["text"] if r["kind"] == "text" else r["fact_id"])
        for r in df.orderBy("pos").collect()
    ]


def test_walk_over_the_sample_page(spark):
    assert walk(spark, PAGE) == [
        (1, "Traffic", "Port of Nowhere, year in brief."),
        (2, "Traffic", "Ferries called daily."),
        (2, "Traffic", "Cargo came in spring."),
        (2, "Traffic", "dues"),
        (2, "Traffic", "pilots"),
        (3, "Ice and repairs", "North pier"),
        (3, "Ice and repairs", "closed"),
        (3, "Ice and repairs", "repairs"),
        (3, "Ice and repairs", "Works go on."),
    ]


def test_frames_of_the_sample_page(spark, rows):
    doc = ixbrl.parse_documents(document_parts(pages(spark, PAGE)), known(spark))
    numeric = facts.section_numeric_facts(doc)
    assert sorted(rows(numeric, "concept_name", "fact_value", "section_name", "unit")) == [
        ("PortDues", 875.25, "Traffic", "iso4217:EUR"),
        ("RepairBalance", -64.0, "Ice and repairs", "iso4217:EUR"),
    ]
    row = numeric.first()
    assert str(row["period_end"]) == "2021-10-31" and tuple(row["metadata"]) == (2, None)
    assert row["concept_namespace"] == "us-gaap" and row["context_entity"] == "Port of Nowhere"
    text = facts.section_text_facts(doc)
    assert rows(text, "concept_name", "fact_value", "section_name") == [
        ("PilotRules", "Board at buoy seven.", "Traffic")
    ]
    assert facts.section_facts(doc).count() == 3


def test_match_report(spark):
    html = PAGE.replace("</body>", '<ix:nonfraction name="a:b">1</ix:nonfraction></body>')
    matched = ixbrl.match_facts(document_parts(pages(spark, html)), known(spark))
    row = ixbrl.match_report(matched).first()
    assert tuple(row) == (1, 5, 3, 1, 1)
    other = known(spark).withColumn("concept_name", F.lit("Other"))
    matched = ixbrl.match_facts(document_parts(pages(spark, PAGE)), other)
    assert ixbrl.name_mismatches(matched).count() == 3


def test_own_facts_are_those_of_the_document(spark, rows):
    again = '<ix:nonFraction id="dues" name="us-gaap:PortDues" unitRef="eur">7</ix:nonFraction>'
    nameless = '<ix:nonNumeric id="pilots">no name</ix:nonNumeric><ix:nonNumeric name="a:b">x</ix:nonNumeric>'
    html = PAGE.replace("<p>Works", again + nameless + "<p>Works")
    parts = document_parts(pages(spark, html, PAGE, "<p>none</p>"))
    want = ixbrl.match_facts(parts, ixbrl.inline_facts(parts))
    got = ixbrl.own_facts(parts)
    assert set(got.columns) == set(want.columns)
    order = sorted(want.columns)
    assert sorted(map(str, rows(got, *order))) == sorted(map(str, rows(want, *order)))
    plan = knowledge_base.rendered_filings(pages(spark, html), 2)._jdf.queryExecution().toString()
    assert plan.split("Physical Plan")[1].count("MapInArrow") == 1


@pytest.mark.parametrize(("size", "overlap", "cut"), [(40, 7, 4096), (25, 20, 6), (1000, 100, 4096), (3, 0, 1)])
def test_windows_are_those_of_the_whole_text(spark, monkeypatch, size, overlap, cut):
    monkeypatch.setattr(render, "CUT", cut)
    long = PAGE.replace("Works go on.", "Würks \U0001f600 go on. " * 40)
    matched = ixbrl.own_facts(document_parts(pages(spark, PAGE, long)))
    parts = ixbrl.document_sections(matched)
    for form in (render.MarkdownFormat(2), render.PlainFormat(1)):
        whole = render.render_documents(parts, form)
        want = sections.window_chunks(whole, "document", size, overlap)
        windows = render.document_windows(parts, form, size, overlap)
        shown = lambda df: sorted(tuple(r) for r in df.select("filing_id", "chunk_no", "chunk").collect())
        assert shown(windows) == shown(want)
        plan = windows._jdf.queryExecution().toString().split("Physical Plan")[1]
        assert plan.count("MapInArrow") == 1


def test_the_last_fact_of_an_id_stands(spark, rows):
    twice = known(spark).unionByName(
        known(spark).filter("fact_id = 'dues'").withColumns(
            {"pos": F.lit(9), "value": F.lit("7")}
        )
    )
    doc = ixbrl.parse_documents(document_parts(pages(spark, PAGE)), twice)
    got = rows(doc.filter("fact_id = 'dues'"), "value")
    assert got == [("7",)]


def test_headings(spark):
    tag = '<ix:nonfraction id="dues" name="us-gaap:PortDues">1</ix:nonfraction>'
    assert walk(spark, f"<body>{tag}</body>") == [(1, "Document Start", "dues")]
    assert walk(spark, f"<body>a{tag}<h2>Later <b>on</b></h2></body>") == [
        (1, "Lateron", "a"), (1, "Lateron", "dues"),
    ]
    assert walk(spark, f"<body>a<h2> </h2>b<h3></h3><h4>T</h4>{tag}</body>") == [
        (1, "Untitled Section", "a"), (2, "Untitled Section (h2)", "b"), (3, "T", "dues"),
    ]
    # Facts and texts inside a heading belong to its title only.
    assert walk(spark, f"<body><h1>In {tag}</h1>out{tag}</body>") == [
        (1, "In1", "out"), (1, "In1", "dues"),
    ]


def test_nesting(spark):
    inner = '<ix:nonfraction id="dues" name="us-gaap:PortDues">1</ix:nonfraction>'
    wrap = '<ix:nonnumeric id="{}" name="us-gaap:N">x<p>in {}</p><h2>H</h2></ix:nonnumeric>'
    swallowed = walk(spark, "<body>" + wrap.format("pilots", inner) + "<p>after</p></body>")
    # The title comes from the first heading of the page, even one inside a fact.
    assert swallowed == [(1, "H", "pilots"), (1, "H", "after")]
    opened = walk(spark, "<body>" + wrap.format("unknown", inner) + "<p>after</p></body>")
    assert opened == [(1, "H", "in"), (1, "H", "dues"), (2, "H", "after")]


def test_pages_without_facts_and_bare_tags(spark):
    assert walk(spark, "<body><h1>T</h1><p>text</p></body>") == []
    assert walk(spark, "<body><ix:nonfraction>1</ix:nonfraction></body>") == []
    bare = '<body>a<nonfraction id="dues">1</nonfraction><nonfraction id="no">2</nonfraction></body>'
    assert [w[2] for w in walk(spark, bare)] == ["a", "dues", "2"]
    mixed = bare.replace("</body>", '<ix:nonnumeric id="pilots">x</ix:nonnumeric></body>')
    assert [w[2] for w in walk(spark, mixed)] == ["a", "1", "2", "pilots"]


def test_hidden_text(spark):
    tag = '<ix:nonfraction id="dues">1</ix:nonfraction>'
    html = f"<body><script>'<h1>no</h1>'</script><style>b</style><!-- c -->x<br/>y{tag}</body>"
    assert [w[1:] for w in walk(spark, html)] == [
        ("Document Start", "x"), ("Document Start", "y"), ("Document Start", "dues"),
    ]


def test_inline_facts(spark):
    html = """<html xmlns:us-gaap="http://fasb.org/us-gaap/2023"><body>
      <xbrli:context id="d"><xbrli:entity><xbrli:identifier scheme="x">0001</xbrli:identifier>
      <xbrli:segment><xbrldi:explicitMember dimension="us-gaap:Axis">a:M</xbrldi:explicitMember>
      </xbrli:segment></xbrli:entity><xbrli:period><xbrli:startDate>2023-01-01</xbrli:startDate>
      <xbrli:endDate>2023-12-31</xbrli:endDate></xbrli:period></xbrli:context>
      <xbrli:context id="i"><xbrli:period><xbrli:instant>2023-12-31</xbrli:instant></xbrli:period>
      </xbrli:context>
      <xbrli:unit id="u"><xbrli:divide><xbrli:measure>iso4217:USD</xbrli:measure>
      <xbrli:measure>shares</xbrli:measure></xbrli:divide></xbrli:unit>
      <ix:nonFraction name="us-gaap:A" contextRef="d" unitRef="u" scale="6" sign="-" id="1">1,234.5</ix:nonFraction>
      <ix:nonFraction name="us-gaap:B" contextRef="i" decimals="INF" id="2" format="ixt:zerodash">—</ix:nonFraction>
      <ix:nonFraction name="us-gaap:C" contextRef="gone" id="3" format="ixt:num-comma-decimal">1.234,5</ix:nonFraction>
      <ix:nonNumeric name="dei:D" id="4">a <b>b</b></ix:nonNumeric>
    </body></html>"""
    got = {r["fact_id"]: r for r in ixbrl.inline_facts(document_parts(pages(spark, html))).collect()}
    assert float(got["1"]["value"]) == -1234500000.0 and got["1"]["unit"] == "iso4217:USD/shares"
    assert got["1"]["context_entity"] == "0001"
    assert got["1"]["context_scenario"] == "us-gaap:Axis=a:M"
    assert str(got["1"]["period_end"]) == "2023-12-31" and got["1"]["period_instant"] is None
    assert got["2"]["value"] == "0" and str(got["2"]["period_instant"]) == "2023-12-31"
    assert got["3"]["value"] == "1234.5" and got["3"]["period_start"] is None
    assert got["4"]["value"] == "a b" and got["4"]["fact_type"] == "TextFact"
    assert got["1"]["schema_url"] == "http://fasb.org/us-gaap/2023"
    assert got["4"]["prefix"] == "dei" and got["4"]["schema_url"] is None


def test_rendering(spark):
    doc = ixbrl.parse_documents(document_parts(pages(spark, PAGE)), known(spark))
    markdown = render.render_documents(doc, render.MarkdownFormat(2)).first()["document"]
    assert (
        "*   Text Fact:\n    *   **Concept:** `PilotRules`\n    *   **Value:**\n        ```\n"
        "Board at buoy seven.\n        ```\n\n"
    ) in markdown
    assert (
        "*   Fact:\n    *   **Concept:** `PortDues`\n    *   **Value:** `875.25`\n"
        "    *   **Unit:** `iso4217:EUR`\n    *   **Period:** `2021-04-01` to `2021-10-31`\n"
        "    *   **Context:** `season`\n\n"
    ) in markdown
    assert "## Ice and repairs\n\nNorth pier\n\nclosed\n\n" in markdown
    plain = render.render_documents(doc, render.PlainFormat(1)).first()["document"]
    assert plain.startswith("--- DOCUMENT START ---\n\nTRAFFIC\n=======\n\n")
    assert "[TEXT_FACT: Concept=PilotRules Value(truncated)='Board at buoy seven.']\n" in plain
    assert (
        "[FACT: RepairBalance=-64 Unit: iso4217:EUR Period: 2021-04-01 to 2021-10-31"
        " Context: season]\n"
    ) in plain
    assert plain.endswith("\n\n\n--- DOCUMENT END ---")


def test_long_text_facts_are_cut_only_at_the_first_level(spark):
    long = known(spark).withColumn(
        "value", F.when(F.col("fact_id") == "pilots", F.repeat(F.lit("<i>ab</i>"), 150)).otherwise(
            F.col("value")
        )
    )
    doc = ixbrl.parse_documents(document_parts(pages(spark, PAGE)), long)
    short = render.render_documents(doc, render.MarkdownFormat(1)).first()["document"]
    cut = "\n".join(["ab"] * 150)[:200]
    assert f"    *   **Value (truncated):** {cut}...\n\n" in short
    whole = render.render_documents(doc, render.PlainFormat()).first()["document"]
    assert "\nValue:\n" + "ab" * 150 + "\n[END_TEXT_FACT]\n" in whole


def test_visible_text(spark, rows):
    html = "<title>t</title><p> a  b<br>c\n d </p><script>x</script><template>y</template>&amp;&nbsp;e"
    seen = lambda *pages: [
        r[0] for r in spark.createDataFrame([(p,) for p in pages], "h string").select(visible_strings(F.col("h"))).collect()
    ]
    assert seen(html) == [["t", "a  b", "c\n d", "&\xa0e"]]
    df = spark.createDataFrame([(html,), (None,)], "html string")
    got = df.select(visible_text(F.col("html")), page_text(F.col("html"))).collect()
    assert tuple(got[0]) == ("t\na  b\nc\n d\n&\xa0e", "t\na\nb\nc\nd\n&\xa0e")
    assert tuple(got[1]) == (None, None)
    broken = ("", "<", "a < b", "x <p", "</", "<!-- open", "<a href='x>y")
    assert all(isinstance(found, list) for found in seen(*broken))
    assert seen("a < b<p title='x > y'>c") == [["a < b", "c"]]
    nested = "a<template>b<template>c</template>d</template>e</template>f<script>g</script>h"
    assert seen(nested) == [["a", "e", "f", "h"]]
    many = "".join(f"<p>x{k}</p>" + ("<template>y</template>" if k % 3 else "") for k in range(5000))
    assert seen(many) == [[f"x{k}" for k in range(5000)]]


def test_index_links(spark, rows):
    html = """<table summary="Document Format Files"><tr><td>1 XML</td><td>x</td>
      <td><a href="/Archives/a.xml">a</a></td></tr><tr><td>xbrl</td><td>x</td><td>none</td></tr>
      <tr><td>jpg</td><td>x</td><td><a href="/b.jpg">b</a></td></tr></table>"""
    df = spark.createDataFrame([(html,)], "html string")
    assert rows(xbrl_links(df), "url") == [("https://www.sec.gov/Archives/a.xml",)]


def test_submission_body(spark):
    body = "<DOCUMENT><TYPE>10-K<TEXT><p>one</p> two</TEXT></DOCUMENT>"
    cases = {
        "<DOCUMENT><TYPE>EX<TEXT>no</TEXT>" + body: "one\ntwo",
        "<DOCUMENT><TYPE>10-K</TEXT><TEXT>" + body: "one\ntwo",
        "<DOCUMENT><TYPE>8-K<TEXT>x</TEXT>": "No 10-K text content found in the filing.",
        "": "No text content provided.",
        None: "No text content provided.",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = df.select("i", sections.submission_body(F.col("t")).alias("b")).orderBy("i").collect()
    assert [r["b"] for r in got] == list(cases.values())


REPORT = (
    "Item\xa01. Business\n\nWe sell.\n\nItem 1A. Risk Factors\n\nMany.\n\nITEM 1B x "
    "Item 7. Management's Discussion text Item 7A Item 8. Financial Statements\n"
    "Notes to Financial Statements Note 1. Basis. First text Note 2: Sums. Second Note 1. Basis. "
    "Third Signatures Segment Data here 45 Table of Contents"
)


def test_sections(spark, rows):
    df = spark.createDataFrame([(1, REPORT), (2, "nothing"), (3, None)], "id int, text string")
    got = rows(sections.extract_sections(df, footnotes=True, segments=True), "section", "content")
    assert got == [
        ("business_description", "Item\xa01. Business\n\nWe sell.\n\nItem 1A"),
        ("risk_factors", "Item 1A. Risk Factors\n\nMany.\n\nITEM 1B"),
        ("mda", "Item 7. Management's Discussion text Item 7A"),
        (
            "footnotes",
            "Notes to Financial Statements Note 1. Basis. First text Note 2: Sums. Second "
            "Note 1. Basis. Third Signatures",
        ),
        ("segment_info", "Segment Data here 45 Table of Contents"),
    ]
    notes = rows(sections.extract_notes(df), "note_id", "title", "content")
    assert notes == [
        ("note_1_basis", "Note 1. Basis.", "Third Signatures"),
        ("note_2_sums", "Note 2: Sums.", "Second"),
    ]


def pack(text, limit=1500):
    out, current = [], ""
    for p in [p for p in text.split("\n\n") if p.strip()]:
        if current and len(current) + len(p) > limit:
            out.append(current.strip())
            current = ""
        current += p + "\n\n"
    return out + ([current.strip()] if current else [])


def test_paragraph_packing_against_brute_force(spark):
    rnd = random.Random(5)
    texts = ["", "\n\n", "one", "a\n\n\nb"]
    for _ in range(60):
        lengths = [rnd.choice([0, 1, 3, 10, 19, 20, 21, 45]) for _ in range(rnd.randint(1, 12))]
        texts.append("\n\n".join("é" * n + rnd.choice(["", " ", "\xa0"]) for n in lengths))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", sections.pack_paragraphs(F.col("t"), 40).alias("c")).orderBy("i")
    assert [r["c"] for r in got.collect()] == [pack(t, 40) for t in texts]


def test_chunk_names(spark, rows):
    df = spark.createDataFrame(
        [("s", "Name", "a" * 30 + "\n\n" + "b" * 30), ("t", "Other", "short")],
        "section string, section_name string, content string",
    )
    got = rows(sections.chunk_sections(df, max_size=40), "section", "section_name")
    assert sorted(got) == [
        ("s_part_1", "Name (Part 1)"), ("s_part_2", "Name (Part 2)"), ("t", "Other"),
    ]


@pytest.mark.parametrize(("size", "overlap"), [(1000, 100), (10, 3), (10, 0), (10, 7)])
def test_windows_against_brute_force(spark, size, overlap):
    texts = ["", "x", "é😀" * 7, "ab\nc" * 5, "y" * (size - overlap), "z" * (2 * size + 1), "w" * 950]
    step = size - overlap
    expected = [[t[i : i + size] for i in range(0, len(t), step)] for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", sections.windows_of(F.col("t"), size, overlap).alias("w")).orderBy("i")
    assert [r["w"] for r in got.collect()] == expected
    with pytest.raises(ValueError):
        sections.windows_of(F.col("t"), 10, 10)


def test_content_levels(spark, rows):
    filings = spark.createDataFrame(
        [(1, "A", "10-K", "2024-01-01")], "filing_id int, ticker string, form string, filing_date string"
    )
    texts = spark.createDataFrame(
        [(1, REPORT, "<XBRL>", False)], "filing_id int, text string, raw string, failed boolean"
    )
    metrics = spark.createDataFrame(
        [
            (1, "r", 2, "Revenue", "us-gaap", URL, "NumericFact", "640", "iso4217:EUR", "0", None,
             "y", None, None, None, "2023-01-01", "2023-12-31"),
            (1, "n", 3, "NetIncomeLoss", "us-gaap", URL, "NumericFact", "-16", "iso4217:EUR", "0",
             None, "y", None, None, None, "2023-01-01", "2023-12-31"),
        ],
        FACT,
    ).withColumns(
        {"pos": F.col("pos"), "period_end": F.to_date("period_end"),
         "period_start": F.to_date("period_start"), "period_instant": F.to_date("period_instant")}
    )

    def of(level, texts=texts):
        df = content.dispatch_filings(filings, texts, metrics, level)
        return rows(df.orderBy("kind_rank", "pos"), "section", "text")

    assert of(1) == [
        ("basic_info", "Filing: A 10-K dated 2024-01-01"),
        (
            "financial_metrics",
            "Key Financial Metrics for A as of 2024-01-01:\n\n"
            "• Revenue: 640 iso4217:EUR (Period: 2023-01-01 to 2023-12-31)\n"
            "• NetIncomeLoss: -16 iso4217:EUR (Period: 2023-01-01 to 2023-12-31)\n",
        ),
    ]
    assert [s for s, _ in of(2)] == [
        "basic_info", "financial_metrics", "derived_metrics", "business_description",
        "risk_factors", "mda",
    ]
    assert of(2)[2][1] == "Derived Financial Metrics for A:\n\n• Net Profit Margin: -2.50%\n"
    assert [s for s, _ in of(3)][6:] == [
        "footnotes", "segment_info", "note_note_1_basis", "note_note_2_sums",
    ]
    assert [s for s, _ in of(1, texts.filter("false"))] == ["overview", "financial_metrics"]
    assert [s for s, _ in of(3, texts.withColumn("failed", F.lit(True)))] == ["error"]
    plain = of(1, texts.withColumn("raw", F.lit("no facts")))
    assert [s for s, _ in plain] == ["basic_info"]


def test_packing_is_linear_and_as_by_hand(spark):
    """Blocks of paragraphs carry the open chunk; two hundred thousand paragraphs in one section."""
    rnd = random.Random(4)
    texts = ["", " \n\n ", "one", "\n\na\n\nb"]
    for _ in range(20):
        count = rnd.choice([3, 40, 700, 1600])
        texts.append("\n\n".join("x" * rnd.choice([1, 5, 30, 60]) for _ in range(count)))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: r["c"] for r in df.select("k", sections.pack_paragraphs(F.col("t"), 50).alias("c")).collect()}
    for k, text in enumerate(texts):
        chunks, part, size = [], [], 0
        for p in (p for p in text.split("\n\n") if p.strip()):
            if size + len(p) > 50 and size > 0:
                chunks.append("\n\n".join(part).strip())
                part, size = [], 0
            part.append(p)
            size += len(p) + 2
        if part:
            chunks.append("\n\n".join(part).strip())
        assert got[k] == chunks
    long = spark.range(1).select(F.repeat(F.lit("some words\n\n"), 200_000).alias("t"))
    for limit in (5, 4000):
        packed = long.select(F.size(sections.pack_paragraphs(F.col("t"), limit)).alias("n")).first()
        assert packed["n"] == (200_000 if limit == 5 else -(-200_000 // 333))


def plan_of(df):
    return df._jdf.queryExecution().toString().partition("== Physical Plan ==")[2]


def test_parts_and_facts_meet_in_one_shuffle(spark):
    doc = ixbrl.parse_documents(document_parts(pages(spark, PAGE)), known(spark))
    assert plan_of(doc).count("Exchange ") == 1
