"""SQL for the annotation workflow, vector search, sinks and refreshes."""

from __future__ import annotations

from driver_queries.oracles import FACTS, LINES, ORACLES, RAW, SECURITIES, TAGS, oracle

# --- annotation workflow -----------------------------------------------------

RECORDS = """turns AS (SELECT *, CASE WHEN role = 'user' THEN 'words' END AS units
  FROM conversations),
lines AS (
  SELECT conv_id, 'C' || conv_id AS ticker, bool_or(role = 'system') AS cut,
    sum(length(to_json(role)) + length(to_json(text)) + 17
      + CASE WHEN units IS NULL THEN 0 ELSE 16 END
      + CASE WHEN conv_id % 5 = 1 THEN 26 ELSE 0 END) + count(*) - 1
      + length('{"ticker":"C' || conv_id || '","fy":2024,"values":[')
      + CASE WHEN conv_id % 5 = 3 THEN 22 ELSE 0 END AS n_open
  FROM turns GROUP BY conv_id),
recs AS (
  SELECT conv_id, ticker, cut OR conv_id % 5 = 2 AS broken,
    n_open + CASE WHEN cut THEN 0 WHEN conv_id % 5 = 2 THEN 11 ELSE 2 END AS n_chars FROM lines)"""
oracle(
    "jsonl_line_numbers",
    "SELECT count(DISTINCT conv_id) AS n_lines, true AS contiguous FROM conversations",
)
oracle(
    "jsonl_records",
    f"""WITH {RECORDS} SELECT ticker, CAST(2024 AS BIGINT) AS fy, CAST(n_chars AS BIGINT)
      AS n_chars FROM recs WHERE NOT broken""",
)
oracle(
    "jsonl_value_items",
    f"""WITH {RECORDS} SELECT ticker, turn AS item_index, role AS original_tag,
      text AS original_value, units AS original_units
    FROM turns JOIN recs USING (conv_id) WHERE NOT broken""",
)
oracle(
    "jsonl_rejects",
    f"""WITH {RECORDS} SELECT ticker, CAST(n_chars AS BIGINT) AS n_chars FROM recs WHERE broken""",
)
oracle(
    "annotation_ingest_again",
    f"""WITH {RECORDS}, all_items AS (
      SELECT conv_id, ticker, turn AS item_index, role,
        CASE WHEN conv_id % 3 = 0 THEN 'later ' ELSE '' END || text AS original_value
      FROM turns JOIN recs USING (conv_id) WHERE NOT broken)
    SELECT ticker, item_index, role AS original_tag, original_value,
      CASE WHEN item_index = 0 AND conv_id % 3 <> 0 THEN 'verified' ELSE 'pending' END AS status
    FROM all_items""",
)
oracle(
    "insert_or_ignore",
    """SELECT user_id, event_type, event_id FROM events WHERE event_type <> 'purchase'
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""",
)
oracle(
    "pending_shells",
    """SELECT CAST(doc_id AS VARCHAR) AS item_id, 'pending' AS status FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
_EVENT = """CAST(user_id AS VARCHAR) AS item_id,
  CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) AS annotated_value,
  event_type AS annotation_comment,
  CASE event_type WHEN 'purchase' THEN 'verified' WHEN 'click' THEN 'annotated' ELSE 'pending' END
    AS status"""
for _name in ("annotation_state", "annotation_stream", "annotation_state_stream"):
    oracle(
        _name,
        f"""SELECT {_EVENT} FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    )
oracle(
    "annotation_upsert",
    f"""SELECT {_EVENT} FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id
      ORDER BY event_type IN ('view', 'signup'), ts DESC) = 1""",
)
oracle(
    "annotation_worklist",
    """SELECT CAST(d.doc_id AS VARCHAR) AS item_id, source AS original_tag,
      CASE WHEN quality = 1 THEN 'good' ELSE lang END AS shown_value,
      CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END AS shown_comment,
      CASE WHEN quality = 1 THEN 'verified' WHEN quality = 0 THEN 'annotated' ELSE 'pending' END
        AS shown_status
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
oracle(
    "items_of_record",
    """SELECT 'c#1#' || turn AS item_id, turn AS item_index, role AS original_tag,
      CAST(NULL AS VARCHAR) AS status FROM conversations WHERE conv_id = 1""",
)
oracle(
    "item_fact_match",
    f"""WITH {FACTS}, {TAGS}, items AS (
      SELECT CAST(c_custkey AS VARCHAR) AS item_id,
        'T' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS ticker,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'revenue_total' WHEN 'AUTOMOBILE' THEN 'assets_total'
          WHEN 'MACHINERY' THEN 'net_income' WHEN 'HOUSEHOLD' THEN 'eps_basic_total'
          ELSE 'no_such_tag' END AS tag FROM customer),
    tagged AS (
      SELECT tag, ticker, fact_value FROM facts JOIN tags USING (concept_name)
      WHERE year(facts.report_date) = 1998)
    SELECT item_id, items.tag, CASE WHEN count(fact_value) > 0 THEN 'matched'
        WHEN items.tag = 'no_such_tag' THEN 'unmapped' ELSE 'no_match' END AS outcome,
      count(fact_value) AS n_facts, max(fact_value) AS max_value
    FROM items LEFT JOIN tagged ON items.tag = tagged.tag AND items.ticker = tagged.ticker
    GROUP BY item_id, items.tag""",
)
_PLACED = """recs AS (SELECT o_orderpriority AS file_name, o_orderkey AS record_index,
  o_orderpriority || '#' || o_orderkey AS record_id FROM orders)"""
oracle(
    "record_neighbours",
    f"""WITH {_PLACED} SELECT file_name, record_id, record_index,
      lag(record_id) OVER w AS previous_id, lead(record_id) OVER w AS next_id
    FROM recs WINDOW w AS (PARTITION BY file_name ORDER BY record_index)""",
)
oracle(
    "records_of_file",
    f"WITH {_PLACED} SELECT record_id, record_index FROM recs WHERE file_name = '1-URGENT'",
)
oracle(
    "record_by_id",
    f"WITH {_PLACED} SELECT record_index FROM recs WHERE record_id = '4-NOT SPECIFIED#1'",
)
oracle("uploaded_files", f"WITH {_PLACED} SELECT DISTINCT file_name FROM recs")

# --- vectors -----------------------------------------------------------------

VECTORS = """vecs AS (
  SELECT vec_id AS id, label, 'L' || label AS ticker, CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings),
spread AS (SELECT label, i, v[i] AS x FROM vecs, range(1, 65) r(i)),
centre AS (SELECT list(m ORDER BY i) AS q FROM (SELECT i, avg(x) AS m FROM spread GROUP BY i)),
label_centres AS (
  SELECT label AS query_id, list(m ORDER BY i) AS q
  FROM (SELECT label, i, avg(x) AS m FROM spread GROUP BY label, i) GROUP BY label)"""
_DOT = "list_dot_product(v, q)"
_L2 = "list_dot_product(list_transform(range(1, 65), lambda i: v[i] - q[i]), list_transform(range(1, 65), lambda i: v[i] - q[i]))"
_COSINE = f"(1 - {_DOT} / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))))"


def _top(distance: str, where: str, limit: int, score: str, tail: str = "") -> str:
    return f"""WITH {VECTORS}, best AS (
      SELECT id, ticker, {distance} AS d FROM vecs, centre {where} ORDER BY d, id LIMIT {limit})
    SELECT id, ticker, round(d, 6) AS distance, round({score}, 6) AS score FROM best {tail}"""


oracle("knn_l2", _top(_L2, "", 10, "1 / (1 + d)"))
oracle("knn_cosine", _top(_COSINE, "", 50, "1 - d", "WHERE 1 - d >= 0.1"))
oracle("knn_dot", _top(f"(1 - {_DOT})", "WHERE ticker = 'L3'", 5, "d"))
def _batch(asked: str, distance: str, score: str) -> str:
    return f"""WITH {VECTORS}, asked AS ({asked}), ranked AS (
      SELECT query_id, id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank
      FROM (SELECT query_id, id, {distance} AS d FROM vecs, asked))
    SELECT CAST(query_id AS BIGINT) AS query_id, id, rank, round(d, 6) AS distance,
      round({score}, 6) AS score FROM ranked WHERE rank <= 10"""


oracle(
    "knn_batch",
    _batch("SELECT id AS query_id, v AS q FROM vecs WHERE id % 50 = 0", _L2, "1 / (1 + d)"),
)
oracle("knn_batch_cosine", _batch("SELECT * FROM label_centres", _COSINE, "1 - d"))
oracle(
    "ann_search",
    """SELECT vec_id AS query_id, CAST(10 AS BIGINT) AS n_found, true AS recall_reached,
      true AS distances_true FROM embeddings WHERE vec_id % 50 = 0""",
)
oracle("ann_search_all_cells", ORACLES["knn_batch"])
oracle(
    "vector_fit",
    f"""WITH {VECTORS} SELECT id, 48 AS cut_size, 80 AS padded_size,
      round(list_sum(v[1:48]), 6) AS cut_sum, round(list_sum(v), 6) AS padded_sum FROM vecs""",
)
oracle(
    "vector_prepare",
    f"""WITH {VECTORS} SELECT ticker, CAST(id AS VARCHAR) AS text, '2024-01-01' AS date,
      CASE WHEN label > 4 THEN '10-K_1' ELSE 'unknown' END AS source, 64 AS dim FROM vecs""",
)
oracle("vector_listing", f"WITH {VECTORS} SELECT id, ticker FROM vecs WHERE ticker = 'L3' ORDER BY id LIMIT 100")

# --- sinks and refreshes -----------------------------------------------------

for _name in ("filings_parquet_round_trip", "filings_csv_round_trip"):
    oracle(_name, ORACLES["filings_derive"])
oracle("collect_filings_twice", ORACLES["collect_filings"])


def _totals(ticker: str, revenues: str = "'Revenues'") -> str:
    return f"""WITH {LINES}, read_back AS (
      SELECT ticker, {revenues} AS concept_name, CAST(l_extendedprice AS DECIMAL(20, 2)) AS x,
        filing_date, report_date FROM lines
      UNION ALL SELECT ticker, 'Discount', -CAST(l_discount AS DECIMAL(20, 2)), filing_date,
        report_date FROM lines)
    SELECT {ticker} AS ticker, concept_name, count(*) AS n_facts,
      round(CAST(sum(x) AS DOUBLE), 2) AS total, CAST(max(filing_date) AS VARCHAR) AS filing_date,
      CAST(max(report_date) AS VARCHAR) AS report_date
    FROM read_back GROUP BY ALL"""


oracle("facts_refresh", _totals("ticker"))
oracle("facts_refresh_new_filings", _totals("ticker"))
oracle(
    "facts_refresh_late_pages",
    _totals("ticker", "CASE WHEN l_orderkey % 5 = 0 THEN 'Sales' ELSE 'Revenues' END"),
)
oracle("facts_refresh_numeric_tickers", _totals("substr(ticker, 2)"))
oracle(
    "facts_refresh_empty",
    f"""WITH {SECURITIES} SELECT CAST(0 AS BIGINT) AS n_facts, count(*) AS n_read FROM orders
    WHERE 'T' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') IN (SELECT ticker FROM sec)""",
)
oracle(
    "filing_texts_twice",
    """WITH described AS (
      SELECT source AS ticker, lang, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS accessionNumber,
        CASE WHEN doc_id % 7 = 0 THEN 'unknown_year' ELSE CAST(2010 + doc_id % 10 AS VARCHAR) END AS year,
        length('<DOCUMENT><TYPE>10-K<TEXT>' || text || '</TEXT>') AS n_chars FROM documents)
    SELECT ticker, year, accessionNumber, n_chars FROM described
    QUALIFY row_number() OVER (PARTITION BY ticker, year
      ORDER BY lang <> 'en', accessionNumber) = 1""",
)

# --- files, catalog tables and helpers ---------------------------------------

oracle(
    "submissions_read",
    f"""WITH {RAW} SELECT cik, row_number() OVER (PARTITION BY cik ORDER BY o_orderkey) - 1
      AS position, accessionNumber, filingDate, form FROM raw""",
)
oracle("revenue_csv", ORACLES["revenue_series"])
oracle(
    "vector_table",
    """SELECT 'L' || label AS ticker, CAST(vec_id AS VARCHAR) AS text,
      '2024-01-0' || (label % 2 + 1) AS date, 16 AS dim FROM embeddings""",
)
oracle("facts_of_one_ticker", f"SELECT * FROM ({_totals('ticker')}) WHERE ticker = 'T000002'")
oracle(
    "string_facts_appended",
    f"""WITH {FACTS} SELECT concept_name, count(*) AS n_facts, max(ticker) AS last,
      CAST(min(filing_date) AS VARCHAR) AS first_date FROM facts GROUP BY concept_name""",
)
oracle(
    "facts_with_metadata",
    f"""WITH {FACTS} SELECT form, concept_name, count(*) AS n_facts
    FROM facts, (VALUES ('10-K'), ('10-Q')) f(form) GROUP BY form, concept_name""",
)
oracle(
    "text_helpers",
    """SELECT doc_id, source || '_a_b_' || doc_id AS name,
      md5(CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END) AS digest
    FROM documents""",
)
