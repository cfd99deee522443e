"""Fixed target schemas."""

from pyspark.sql import types as T

STRING, LONG, DOUBLE, DATE = T.StringType(), T.LongType(), T.DoubleType(), T.DateType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


SECURITY = _schema(
    ("ticker", STRING),
    ("name", STRING),
    ("exchange", STRING),
    ("sector", STRING),
    ("industry", STRING),
    ("currency", STRING),
    ("country", STRING),
    ("custom_sector", STRING),
    ("custom_industry", STRING),
    ("subsector", STRING),
    ("theme", T.ArrayType(STRING)),
)

# Column names and types of the filings metadata table (fixed values).
FILINGS = _schema(
    ("ticker", STRING),
    ("cik", STRING),
    ("form", STRING),
    ("accessionNumber", STRING),
    ("filingDate", STRING),
    ("filing_date_dt", DATE),
    ("filing_year", LONG),
    ("reportDate", STRING),
    ("report_date_dt", DATE),
    ("primaryDocument", STRING),
    ("primaryDocDescription", STRING),
    ("documents_url", STRING),
    ("xbrl_instance_url", STRING),
    ("processed_datetime", T.TimestampNTZType()),
)

RAW_FILING = _schema(
    ("accessionNumber", STRING),
    ("filingDate", STRING),
    ("reportDate", STRING),
    ("form", STRING),
    ("primaryDocument", STRING),
    ("primaryDocDescription", STRING),
)

FACT_METADATA = _schema(("decimals", LONG), ("precision", LONG))

_FACT_COMMON = (
    ("concept_name", STRING),
    ("concept_namespace", STRING),
    ("fact_type", STRING),
    ("period_instant", DATE),
    ("period_start", DATE),
    ("period_end", DATE),
    ("context_id", STRING),
    ("context_entity", STRING),
    ("context_scenario", STRING),
    ("filing_date", DATE),
    ("report_date", DATE),
)
_NUMERIC_TAIL = (("fact_value", DOUBLE), ("unit", STRING), ("metadata", FACT_METADATA))

NUMERIC_FACTS = _schema(*_FACT_COMMON, *_NUMERIC_TAIL, ("ticker", STRING))
TEXT_FACTS = _schema(*_FACT_COMMON, ("fact_value", STRING), ("ticker", STRING))
SECTION_NUMERIC_FACTS = _schema(
    *_FACT_COMMON, ("section_name", STRING), *_NUMERIC_TAIL
)
SECTION_TEXT_FACTS = _schema(*_FACT_COMMON, ("section_name", STRING), ("fact_value", STRING))
SECTION_FACTS = _schema(
    *[f for f in _FACT_COMMON if f[0] not in ("filing_date", "report_date")],
    ("section_name", STRING),
    *_NUMERIC_TAIL,
)

REVENUE_SERIES = _schema(
    ("ticker", STRING), ("year", LONG), ("revenue", DOUBLE), ("unit", STRING), ("report_date", DATE)
)

VECTOR_RECORD = _schema(
    ("ticker", STRING),
    ("text", STRING),
    ("date", STRING),
    ("source", STRING),
    ("section", STRING),
    ("vector", T.ArrayType(T.FloatType())),
)

SOURCE_RECORDS = _schema(
    ("record_id", STRING),
    ("file_name", STRING),
    ("record_index", LONG),
    ("ticker", STRING),
    ("fy", LONG),
    ("record_json", STRING),
)
VALUE_ITEMS = _schema(
    ("item_id", STRING),
    ("record_id", STRING),
    ("item_index", LONG),
    ("original_tag", STRING),
    ("original_value", STRING),
    ("original_units", STRING),
    ("original_comments", STRING),
    ("item_json", STRING),
)
ANNOTATIONS = _schema(
    ("item_id", STRING),
    ("annotated_value", STRING),
    ("annotation_comment", STRING),
    ("status", STRING),
    ("updated_at", T.TimestampType()),
)
