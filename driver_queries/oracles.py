"""The same results in SQL, stated from the tables alone."""

from __future__ import annotations

from factloom.constants import CANONICAL_TAGS

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


_TAG_VALUES = ", ".join(f"('{c}', '{t}')" for c, t in CANONICAL_TAGS.items())
_NAME_LIST = "[" + ", ".join(f"'{c}'" for c in CANONICAL_TAGS) + "]"

TAGS = f"tags(concept_name, tag) AS (VALUES {_TAG_VALUES})"

LINES = """lines AS (
  SELECT l.*, CAST(o.o_orderdate AS DATE) AS filing_date,
         CAST(o.o_orderdate AS DATE) - 60 AS report_date,
         CAST(l.l_shipdate AS DATE) AS ship_date,
         'T' || lpad(CAST(o.o_custkey AS VARCHAR), 6, '0') AS ticker,
         lpad(CAST(l.l_linenumber AS VARCHAR), 2, '0') || '-'
           || lpad(CAST(l.l_partkey AS VARCHAR), 12, '0') || '-'
           || lpad(CAST(l.l_suppkey AS VARCHAR), 12, '0') || '-'
           || lpad(CAST(CAST(l.l_extendedprice AS DECIMAL(18, 2)) AS VARCHAR), 12, '0') AS lid
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

FACTS = f"""{LINES}, facts AS (
  SELECT 'Revenues' AS concept_name, l_extendedprice AS fact_value, 'iso4217:USD' AS unit, lines.*
  FROM lines
  UNION ALL
  SELECT 'Assets', l_tax, 'pure', lines.* FROM lines WHERE l_tax > 0
  UNION ALL
  SELECT {_NAME_LIST}[l_linenumber + 8], l_quantity, 'shares', lines.* FROM lines
  UNION ALL
  SELECT {_NAME_LIST}[CAST(round(l_discount * 100) AS INTEGER) + 20], l_discount, 'pure', lines.*
  FROM lines)"""

COVERAGE = f"""{FACTS}, coverage AS (
  SELECT concept_name, count(DISTINCT CAST(filing_date AS VARCHAR) || '_' || ticker) AS num_filings
  FROM facts GROUP BY concept_name),
total AS (SELECT count(*) AS n FROM (SELECT DISTINCT filing_date, ticker FROM facts))"""

oracle("concept_coverage", f"WITH {COVERAGE} SELECT * FROM coverage")
oracle(
    "concept_coverage_sketched",
    f"WITH {COVERAGE} SELECT concept_name, num_filings, true AS estimate_near FROM coverage",
)
oracle(
    "distinct_filings",
    f"WITH {FACTS} SELECT DISTINCT CAST(filing_date AS VARCHAR) AS filing_date, ticker FROM facts",
)
oracle("filing_count", f"WITH {COVERAGE} SELECT n AS total_filings FROM total")
oracle(
    "concepts_in_all_filings",
    f"WITH {COVERAGE} SELECT coverage.* FROM coverage, total WHERE num_filings = n",
)
oracle(
    "high_coverage_top10",
    f"""WITH {COVERAGE} SELECT coverage.* FROM coverage, total
    WHERE num_filings >= n * CAST(0.9 AS DOUBLE)
    ORDER BY num_filings DESC, concept_name LIMIT 10""",
)
oracle(
    "concept_counts",
    f"WITH {FACTS} SELECT concept_name, count(*) AS n_facts FROM facts GROUP BY concept_name",
)
oracle(
    "concept_counts_asset",
    f"""WITH {FACTS} SELECT concept_name, count(*) AS n_facts FROM facts
    WHERE contains(concept_name, 'Asset') GROUP BY concept_name""",
)
oracle("distinct_concepts", f"WITH {FACTS} SELECT DISTINCT concept_name FROM facts")
oracle(
    "first_row_per_concept",
    f"""WITH {FACTS} SELECT concept_name, CAST(filing_date AS VARCHAR) AS filing_date, ticker,
      fact_value, unit FROM facts
    QUALIFY row_number() OVER (PARTITION BY concept_name
      ORDER BY facts.filing_date, ticker, l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1""",
)
oracle(
    "canonical_tags",
    f"""WITH {FACTS}, {TAGS} SELECT tag, count(*) AS n_facts, max(fact_value) AS max_value
    FROM facts LEFT JOIN tags USING (concept_name) GROUP BY tag""",
)
_FOUND = f"""{FACTS}, {TAGS}, found AS (
  SELECT concept_name, concept_name IN (SELECT concept_name FROM facts) AS found FROM tags)"""
oracle(
    "tag_coverage",
    f"""WITH {_FOUND} SELECT count(*) AS wanted, count(*) FILTER (found) AS found,
      round(100.0 * count(*) FILTER (found) / count(*), 6) AS coverage_pct FROM found""",
)
oracle("missing_tags", f"WITH {_FOUND} SELECT concept_name FROM found WHERE NOT found")
oracle("found_tags", f"WITH {_FOUND} SELECT concept_name FROM found WHERE found")

# --- universe ----------------------------------------------------------------

SECURITIES = """sec AS (
  SELECT 'T' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS ticker,
         CASE WHEN c_acctbal < 0 THEN c_name || ' Renamed' ELSE c_name END AS name,
         c_mktsegment AS exchange, c_mktsegment AS sector,
         nullif(c_mktsegment, 'MACHINERY') AS industry,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'EUR' ELSE 'USD' END AS currency,
         n_name AS country, c_custkey, c_acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
MAPPING = """mapping AS (
  SELECT 'T' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS ticker,
         lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik
  FROM customer WHERE c_acctbal >= 0)"""
RAW = """raw AS (
  SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CAST(o_custkey AS VARCHAR) AS bare_cik,
         'T' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS ticker,
         lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '-' || strftime(o_orderdate, '%y') || '-'
           || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS accessionNumber,
         CASE WHEN o_totalprice > 450000 THEN strftime(o_orderdate, '%Y/%m/%d')
              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS filingDate,
         CAST(CAST(o_orderdate AS DATE) - 60 AS VARCHAR) AS reportDate,
         CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '10-K/A'
              ELSE '10-Q' END AS form,
         CASE o_orderstatus WHEN 'F' THEN 'doc' || CAST(o_orderkey AS VARCHAR) || '.htm'
              WHEN 'O' THEN '' END AS primaryDocument,
         'Annual report' AS primaryDocDescription, o_orderkey, o_orderstatus, o_totalprice
  FROM orders)"""
_FOLDER = """'https://www.sec.gov/Archives/edgar/data/' || bare_cik || '/'
           || replace(accessionNumber, '-', '') || '/'"""
DERIVED = f"""{RAW}, derived AS (
  SELECT raw.*, filingDate AS filing_date_dt, reportDate AS report_date_dt,
         CAST(substr(filingDate, 1, 4) AS BIGINT) AS filing_year,
         {_FOLDER} || accessionNumber || '-index.html' AS documents_url,
         CASE WHEN primaryDocument <> '' THEN {_FOLDER} || primaryDocument END AS xbrl_instance_url
  FROM raw WHERE form = '10-K' AND o_totalprice <= 450000)"""
FILING_COLUMNS = """ticker, cik, form, accessionNumber, filingDate, filing_year, reportDate,
  primaryDocument, primaryDocDescription, documents_url, xbrl_instance_url, filing_date_dt,
  report_date_dt"""
EXPECTED = f"""{SECURITIES}, expected AS (
  SELECT ticker, CAST(y AS BIGINT) AS filing_year FROM sec, range(1995, 2002) r(y))"""

oracle(
    "securities_last_wins",
    f"""WITH {SECURITIES}
    SELECT ticker, name, exchange, sector, industry, currency, country FROM sec""",
)
oracle(
    "securities_added",
    f"""WITH {SECURITIES}, added AS (
      SELECT 'T' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS ticker, s_name AS name,
             'SUPPLY' AS exchange, 'USD' AS currency, 'US' AS country FROM supplier)
    SELECT * FROM added UNION ALL
    SELECT ticker, name, exchange, currency, country FROM sec
    WHERE ticker NOT IN (SELECT ticker FROM added)""",
)
oracle(
    "security_removed",
    f"WITH {SECURITIES} SELECT ticker, name FROM sec WHERE c_custkey <> 1",
)
oracle("security_by_ticker", f"WITH {SECURITIES} SELECT ticker, name FROM sec WHERE c_custkey = 1")
oracle("expected_pairs", f"WITH {EXPECTED} SELECT * FROM expected")
oracle(
    "missing_pairs",
    f"""WITH {EXPECTED}, {DERIVED}
    SELECT * FROM expected EXCEPT
    SELECT ticker, filing_year FROM derived WHERE o_orderstatus = 'F'""",
)
oracle("ticker_file", f"WITH {MAPPING} SELECT * FROM mapping")
oracle("cik_lookup", f"WITH {MAPPING} SELECT * FROM mapping")
oracle(
    "cik_unmatched",
    f"WITH {SECURITIES} SELECT ticker FROM sec WHERE c_acctbal < 0",
)
oracle(
    "same_ticker_sets",
    f"""WITH {LINES}, {SECURITIES}
    SELECT (SELECT count(*) FROM (SELECT ticker FROM lines EXCEPT SELECT ticker FROM sec)) = 0
       AND (SELECT count(*) FROM (SELECT ticker FROM sec EXCEPT SELECT ticker FROM lines)) = 0
       AS same_tickers""",
)

# --- filings -----------------------------------------------------------------

oracle("filings_derive", f"WITH {DERIVED} SELECT {FILING_COLUMNS} FROM derived")
oracle(
    "filings_for_pairs",
    f"""WITH {DERIVED}, {MAPPING} SELECT {FILING_COLUMNS} FROM derived
    WHERE ticker IN (SELECT ticker FROM mapping) AND filing_year BETWEEN 1995 AND 2001""",
)
oracle(
    "filings_dedup",
    f"""WITH {DERIVED} SELECT ticker, filing_year, accessionNumber,
      CASE o_orderstatus WHEN 'F' THEN 'Stored' ELSE 'Annual report' END AS primaryDocDescription
    FROM derived""",
)
oracle(
    "collect_filings",
    f"""WITH {DERIVED}, {MAPPING}, stored AS (SELECT * FROM derived WHERE o_orderstatus = 'F')
    SELECT {FILING_COLUMNS} FROM stored UNION ALL
    SELECT {FILING_COLUMNS} FROM derived
    WHERE o_orderstatus <> 'F' AND ticker IN (SELECT ticker FROM mapping)
      AND (ticker, filing_year) NOT IN (SELECT (ticker, filing_year) FROM stored)""",
)
oracle(
    "filings_of_year",
    f"WITH {DERIVED} SELECT {FILING_COLUMNS} FROM derived WHERE filing_year = 1998",
)
oracle(
    "usable_filings",
    f"""WITH {DERIVED} SELECT ticker, accessionNumber, xbrl_instance_url FROM derived
    WHERE xbrl_instance_url IS NOT NULL""",
)
oracle(
    "valid_filings",
    f"""WITH {RAW} SELECT accessionNumber, filingDate FROM raw
    WHERE o_totalprice <= 450000 AND CAST(substr(filingDate, 1, 4) AS INTEGER)
      BETWEEN 1996 AND 1999""",
)
oracle(
    "filings_per_ticker",
    f"""WITH {DERIVED} SELECT ticker, filing_year, count(*) AS n_filings,
      string_agg(accessionNumber, ',' ORDER BY filingDate, accessionNumber) AS numbers
    FROM derived GROUP BY ticker, filing_year""",
)
oracle(
    "columnar_json_rows",
    f"""WITH {RAW}, placed AS (
      SELECT *, row_number() OVER (PARTITION BY cik ORDER BY o_orderkey) - 1 AS position,
             count(*) OVER (PARTITION BY cik) AS n FROM raw)
    SELECT cik, position, accessionNumber, filingDate, form,
      CASE WHEN position < n - 1 THEN coalesce(primaryDocument, '-') END AS primaryDocument,
      CAST(NULL AS VARCHAR) AS fileNumber FROM placed""",
)
oracle(
    "columnar_json_others",
    f"""WITH {RAW} SELECT cik, row_number() OVER (PARTITION BY cik ORDER BY o_orderkey) - 1 AS position,
      accessionNumber, CAST(NULL AS VARCHAR) AS reportDate, 'itemDates' AS names,
      reportDate AS item_date FROM raw""",
)
oracle(
    "filings_union",
    f"""WITH {RAW}, both_kinds AS (
      SELECT accessionNumber, form, NULL AS origin FROM raw UNION ALL
      SELECT accessionNumber, NULL, 'archive' FROM raw WHERE form = '10-K/A')
    SELECT form, origin, count(*) AS n, max(accessionNumber) AS last_number
    FROM both_kinds GROUP BY form, origin""",
)
oracle(
    "schema_align",
    f"""WITH {RAW} SELECT accessionNumber, bare_cik AS cik, CAST(NULL AS VARCHAR) AS form,
      CAST(-1 AS BIGINT) AS filing_year,
      CASE WHEN o_totalprice <= 450000 THEN filingDate END AS filing_date_dt FROM raw""",
)
oracle(
    "two_format_year",
    """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN strftime(o_orderdate, '%Y')
      ELSE 'unknown_year' END AS year FROM orders""",
)
oracle(
    "accession_from_url",
    f"""WITH {DERIVED} SELECT accessionNumber AS number,
      CASE WHEN primaryDocument = '' THEN accessionNumber
           ELSE replace(accessionNumber, '-', '') END AS recovered FROM derived""",
)
oracle(
    "instance_url_candidates",
    f"""WITH {DERIVED}, stems AS (
      SELECT *, documents_url || '/' || lower(ticker) AS stem FROM derived)
    SELECT accessionNumber, unnest([
      stem || '-' || filing_year || '0101.xml', stem || '-' || filing_year || '1231.xml',
      stem || '.xml', documents_url || '/Financial_Report.xml']) AS url FROM stems""",
)

# --- facts and metrics -------------------------------------------------------

_MONEY = "CAST(CAST({} AS DECIMAL(18, 2)) AS VARCHAR)"
_PRICE = _MONEY.format("l_extendedprice")
INSTANCE = f"""{LINES}, named AS (
  SELECT *, CASE WHEN l_returnflag = 'A' THEN 'us-gaap' WHEN l_returnflag = 'N' THEN 'ifrs-full'
                 WHEN l_linestatus = 'O' THEN 'dei' ELSE 'acme' END AS prefix,
    CASE WHEN l_returnflag = 'A' THEN 'us-gaap' WHEN l_returnflag = 'N' THEN '2023-03-23'
         WHEN l_linestatus = 'O' THEN 'dei' ELSE 'custom' END AS ns,
    CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1
         WHEN l_linestatus = 'O' THEN 2 END AS ns_rank
  FROM lines),
inst AS (
  SELECT l_orderkey AS filing_id, lid || '-' || no AS fact_id, concept_name, prefix, ns, ns_rank,
         fact_type, value, nullif(unit, '') AS unit, is_instant, ship_date, filing_date,
         report_date, ticker, lid, l_suppkey, l_linestatus
  FROM named, LATERAL (VALUES
    ('1', CASE l_returnflag WHEN 'A' THEN 'Revenue' WHEN 'N' THEN 'Revenues'
          ELSE 'RevenueFromContractWithCustomerExcludingAssessedTax' END,
     {_PRICE}, 'iso4217:USD', 'NumericFact', false),
    ('2', 'NetIncomeLoss', CASE l_returnflag WHEN 'R' THEN '-' ELSE '' END
          || {_MONEY.format("l_quantity")}, 'iso4217:USD', 'NumericFact', false),
    ('3', 'Assets', CASE WHEN l_tax > 0 THEN {_PRICE} ELSE 'n/a' END, 'iso4217:USD',
     'NumericFact', true),
    ('4', 'Liabilities', {_MONEY.format("l_discount")}, 'iso4217:USD', 'NumericFact', true),
    ('5', 'DocumentType', '10-K', '', 'TextFact', false)
  ) v(no, concept_name, value, unit, fact_type, is_instant))"""
_PERIODS = """CASE WHEN is_instant THEN CAST(ship_date AS VARCHAR) END AS period_instant,
  CASE WHEN NOT is_instant THEN CAST(filing_date AS VARCHAR) END AS period_start,
  CASE WHEN NOT is_instant THEN CAST(ship_date AS VARCHAR) END AS period_end"""

oracle(
    "numeric_facts_direct",
    f"""WITH {INSTANCE} SELECT ticker, concept_name, ns AS concept_namespace, fact_type,
      TRY_CAST(value AS DOUBLE) AS fact_value, unit,
      CAST(CASE WHEN is_instant THEN -1 ELSE 2 END AS BIGINT) AS decimals, {_PERIODS},
      CAST(filing_date AS VARCHAR) AS filing_date, CAST(report_date AS VARCHAR) AS report_date
    FROM inst WHERE fact_type = 'NumericFact'""",
)
oracle(
    "text_facts_direct",
    f"""WITH {INSTANCE} SELECT ticker, concept_name, ns AS concept_namespace, value AS fact_value,
      CAST(filing_date AS VARCHAR) AS period_start, CAST(ship_date AS VARCHAR) AS period_end,
      CAST(filing_date AS VARCHAR) AS filing_date
    FROM inst WHERE fact_type = 'TextFact'""",
)
oracle(
    "us_gaap_facts",
    f"""WITH {INSTANCE} SELECT filing_id, fact_id, concept_name, value FROM inst
    WHERE prefix = 'us-gaap'""",
)
oracle(
    "facts_with_contexts",
    f"""WITH {INSTANCE} SELECT filing_id, fact_id,
      lid || CASE WHEN is_instant THEN 'i' ELSE 'd' END AS context_id, ticker AS context_entity,
      CASE WHEN l_linestatus = 'O' THEN 'supplier=' || l_suppkey END AS context_scenario,
      {_PERIODS} FROM inst""",
)
oracle(
    "facts_with_filing",
    f"""WITH {INSTANCE} SELECT filing_id, fact_id, ticker,
      CASE WHEN o_totalprice <= 450000 THEN CAST(filing_date AS VARCHAR) END AS filing_date,
      CAST(report_date AS VARCHAR) AS report_date
    FROM inst JOIN orders ON filing_id = o_orderkey WHERE o_orderstatus = 'F'""",
)
oracle(
    "facts_of_year_and_ticker",
    f"""WITH {FACTS} SELECT concept_name, fact_value, CAST(report_date AS VARCHAR) AS report_date
    FROM facts WHERE ticker = 'T000001' AND year(facts.report_date) = 1998
      AND concept_name IN ('Revenues', 'Assets')""",
)
LATEST = f"""{INSTANCE}, latest AS (
  SELECT filing_id, concept_name AS metric, value, unit,
    CASE WHEN is_instant THEN 'unknown' ELSE CAST(filing_date AS VARCHAR) END AS period_start,
    CAST(ship_date AS VARCHAR) AS period_end
  FROM inst
  WHERE ns_rank IS NOT NULL AND concept_name IN
    ('Revenue', 'NetIncomeLoss', 'Assets', 'Liabilities', 'StockholdersEquity')
  QUALIFY row_number() OVER (PARTITION BY filing_id, concept_name
    ORDER BY ns_rank, ship_date DESC, fact_id) = 1)"""
oracle("latest_fact_per_metric", f"WITH {LATEST} SELECT * FROM latest")
DERIVED_METRICS = f"""{LATEST}, numbers AS (
  SELECT *, TRY_CAST(value AS DOUBLE) AS x FROM latest),
derived_rows AS (
  SELECT a.filing_id, 'DerivedEquity' AS metric, a.x - l.x AS value, a.unit, a.period_start,
    a.period_end
  FROM numbers a JOIN numbers l ON a.filing_id = l.filing_id
  WHERE a.metric = 'Assets' AND l.metric = 'Liabilities' AND a.x IS NOT NULL
  UNION ALL
  SELECT r.filing_id, 'DerivedNetMargin',
    CASE WHEN r.x = 0 THEN 0 ELSE n.x / r.x * 100 END, '%', r.period_start, r.period_end
  FROM numbers n JOIN numbers r ON n.filing_id = r.filing_id
  WHERE n.metric = 'NetIncomeLoss' AND r.metric = 'Revenue')"""
oracle(
    "derived_metrics",
    f"""WITH {DERIVED_METRICS} SELECT filing_id, metric, round(value, 6) AS value, unit,
      period_start, period_end FROM derived_rows""",
)
oracle(
    "revenue_series",
    f"""WITH {INSTANCE}, best AS (
      SELECT filing_id, value, unit FROM inst
      WHERE ns_rank IS NOT NULL AND concept_name LIKE 'Revenue%'
      QUALIFY row_number() OVER (PARTITION BY filing_id ORDER BY
        CASE concept_name WHEN 'Revenues' THEN 2 WHEN 'Revenue' THEN 3 ELSE 1 END,
        ns_rank, ship_date DESC, fact_id) = 1)
    SELECT 'T' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS ticker,
      CAST(year(CAST(o_orderdate AS DATE) - 60) AS BIGINT) AS year,
      CAST(value AS DOUBLE) AS revenue, unit,
      CAST(CAST(o_orderdate AS DATE) - 60 AS VARCHAR) AS report_date
    FROM best JOIN orders ON filing_id = o_orderkey WHERE o_orderstatus = 'F'""",
)
