import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import filings, universe
from factloom.operators.universe import YearRange
from factloom.sources import definitions

SECURITIES = [
    {"ticker": "AAA", "name": "Alpha", "exchange": "NYSE", "sector": "Tech", "theme": ["x", "y"]},
    {"ticker": "BBB", "name": "Beta", "exchange": "NASDAQ", "country": "IE"},
    {"ticker": "CCC", "exchange": "NYSE"},
    {"ticker": "AAA", "name": "Alpha Two", "exchange": "NYSE"},
]


@pytest.mark.parametrize(
    ("start", "end", "years"),
    [
        (None, None, list(range(2014, 2025))),
        (2020, 2022, [2020, 2021, 2022]),
        ("earliest", 1996, [1995, 1996]),
        (2023, "latest", [2023, 2024]),
        (2022, 2020, [2022]),
        (2030, "latest", []),
        ("earliest", 1990, []),
        (2030, None, [2030]),
    ],
)
def test_year_range(start, end, years):
    assert YearRange(start, end, this_year=2024).years == years


def test_year_range_rejects_other_words():
    with pytest.raises(ValueError):
        YearRange("first", None, this_year=2024)
    with pytest.raises(ValueError):
        YearRange(None, "last", this_year=2024)


def test_year_range_text():
    assert str(YearRange("earliest", "latest", 2024)) == "[earliest-latest]"
    assert str(YearRange(2022, 2020, 2024)) == "[2022-2022]"


def test_last_security_wins_and_defaults(spark, rows):
    df = universe.securities_frame(spark, SECURITIES)
    assert sorted(rows(df, "ticker", "name", "currency", "country")) == [
        ("AAA", "Alpha Two", "USD", "US"),
        ("BBB", "Beta", "USD", "IE"),
    ]


def test_add_and_remove(spark, rows):
    df = universe.securities_frame(spark, SECURITIES)
    new = universe.securities_frame(
        spark, [{"ticker": "BBB", "name": "New", "exchange": "X"}]
    )
    both = universe.add_securities(df, new)
    assert sorted(rows(both, "ticker", "name")) == [("AAA", "Alpha Two"), ("BBB", "New")]
    assert rows(universe.remove_security(both, "BBB"), "ticker") == [("AAA",)]
    assert universe.get_security(both, "ZZZ").count() == 0


@pytest.mark.parametrize("suffix", [".yaml", ".json"])
def test_definition_round_trip(spark, tmp_path, suffix, rows):
    df = universe.securities_frame(spark, SECURITIES)
    path = tmp_path / "sub" / f"mine{suffix}"
    definitions.save_universe("my universe", df, str(path))
    name, again = definitions.load_universe(spark, "sub/mine", str(tmp_path))
    assert name == "my universe"
    assert sorted(rows(again)) == sorted(rows(df))


def test_definition_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        definitions.find_definition("absent", str(tmp_path))
    (tmp_path / "list.json").write_text("[1]")
    (tmp_path / "odd.json").write_text(json.dumps({"securities": {"a": 1}}))
    (tmp_path / "broken.json").write_text("{")
    for name in ("list", "odd", "broken"):
        with pytest.raises(ValueError):
            definitions.load_universe(spark, name, str(tmp_path))
    (tmp_path / "both.json").write_text("{}")
    (tmp_path / "both.yaml").write_text("name: y\nsecurities: [{ticker: A}, 3]\n")
    name, df = definitions.load_universe(spark, "both", str(tmp_path))
    assert (name, df.count()) == ("y", 0)
    with pytest.raises(ValueError):
        definitions.save_universe("x", df, str(tmp_path / "x.txt"))


def test_ticker_file(spark, tmp_path, rows):
    path = tmp_path / "ticker.txt"
    path.write_text("aapl\t320193\nbad line\nx\t1\t2\nAAPL\t7\nmsft\t789019\n")
    mapping = definitions.read_ticker_file(spark, str(path))
    assert sorted(rows(mapping)) == [("AAPL", "0000000007"), ("MSFT", "0000789019")]
    asked = spark.createDataFrame([("aapl",), ("MSFT",), ("gone",)], "ticker string")
    assert sorted(rows(universe.lookup_cik(asked, mapping))) == [
        ("MSFT", "0000789019"), ("aapl", "0000000007"),
    ]
    assert rows(universe.tickers_without_cik(asked, mapping)) == [("gone",)]


def test_missing_pairs(spark, rows):
    df = universe.securities_frame(spark, SECURITIES)
    expected = universe.expected_pairs(df, YearRange(2020, 2021, 2024))
    have = spark.createDataFrame(
        [("AAA", "2020"), ("BBB", "odd"), (None, "2021")], "ticker string, filing_year string"
    )
    assert sorted(rows(universe.missing_pairs(expected, have))) == [
        ("AAA", 2021), ("BBB", 2020), ("BBB", 2021),
    ]
    assert universe.missing_pairs(expected, have.drop("ticker")).count() == 4
    assert universe.missing_pairs(expected, None).count() == 4
    assert universe.expected_pairs(df, YearRange(2030, "latest", 2024)).count() == 0


def test_same_tickers(spark):
    df = universe.securities_frame(spark, SECURITIES)
    assert universe.same_tickers(df, df).first()[0]
    assert not universe.same_tickers(df.filter("ticker = 'AAA'"), df).first()[0]


RAW = "cik string, ticker string, accessionNumber string, form string, filingDate string, " \
      "reportDate string, primaryDocument string"  # fmt: skip


def raw(spark):
    return spark.createDataFrame(
        [
            ("51143", "IBM", "0000051143-24-000012", "10-K", "2024-02-20", "2023-12-31", "a.htm"),
            ("51143", "IBM", "0000051143-24-000013", "10-K/A", "2024-02-21", "2023-12-31", "b.htm"),
            ("51143", "IBM", "0000051143-23-000001", "10-K", "2023-02-20", "bad", ""),
            ("51143", "IBM", "0000051143-23-000002", "10-K", "2023-02-22", None, None),
            ("51143", "IBM", "0000051143-22-000001", "10-K", "not a date", None, "c.htm"),
        ],
        RAW,
    )


def test_derive_filings(spark):
    got = {r["accessionNumber"]: r for r in filings.derive_filings(raw(spark)).collect()}
    assert set(got) == {"0000051143-24-000012", "0000051143-23-000001", "0000051143-23-000002"}
    first = got["0000051143-24-000012"]
    folder = "https://www.sec.gov/Archives/edgar/data/51143/000005114324000012/"
    assert first["cik"] == "0000051143" and first["filing_year"] == 2024
    assert first["documents_url"] == folder + "0000051143-24-000012-index.html"
    assert first["xbrl_instance_url"] == folder + "a.htm"
    assert got["0000051143-23-000001"]["xbrl_instance_url"] is None
    assert got["0000051143-23-000001"]["report_date_dt"] is None


def test_requested_filings_keep_all_of_a_pair(spark):
    pairs = spark.createDataFrame([("ibm", 2023), ("ibm", 2022)], "ticker string, filing_year long")
    mapping = spark.createDataFrame([("IBM", "0000051143")], "ticker string, cik string")
    got = filings.requested_filings(pairs, mapping, raw(spark))
    assert {(r["ticker"], r["filing_year"]) for r in got.collect()} == {("ibm", 2023)}
    assert got.count() == 2


def test_dedup_keeps_the_first_frame(spark, rows):
    derived = filings.derive_filings(raw(spark))
    stored = derived.withColumn("form", F.lit("stored")).filter("filing_year = 2024")
    merged = filings.dedup_filings(stored, derived)
    assert sorted(rows(merged, "filing_year", "form")) == [
        (2023, "10-K"), (2023, "10-K"), (2024, "stored"),
    ]


def test_per_ticker_lists_keep_date_order(spark):
    year = 2000 + F.col("id") % 20
    many = spark.range(500).select(
        F.when(F.col("id") < 400, "HOT").otherwise(F.concat(F.lit("T"), "id")).alias("ticker"),
        year.alias("filing_year"),
        F.concat(year.cast("string"), F.lit("-0"), (1 + F.col("id") % 9).cast("string")).alias("filingDate"),
        F.col("id").cast("string").alias("accessionNumber"),
        F.lit("1").alias("cik"),
        F.lit("u").alias("documents_url"),
    )
    lists = filings.filings_per_ticker(many)
    hot = lists.filter("ticker = 'HOT'").orderBy("filing_year").collect()
    dates = [f["filingDate"] for r in hot for f in r["filings"]]
    assert len(hot) == 20 and len(dates) == 400 and dates == sorted(dates)
    assert lists.filter("ticker != 'HOT'").count() == 100
