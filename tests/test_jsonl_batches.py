"""Long batches of JSON lines are parsed in shares of bounded size."""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from factloom.sources import jsonl


def test_a_long_batch_is_handed_on_in_shares():
    lines = [
        json.dumps({"ticker": f"T{i}", "fy": 2024, "values": [{"tag": "a", "value": "x" * 9000}]})
        for i in range(500)
    ]
    lines[7], lines[300] = None, "broken"
    batch = pa.RecordBatch.from_pydict({"line_index": list(range(500)), "value": lines})
    parts = list(jsonl._parsed_batches(iter([batch])))
    assert max(sum(len(v or "") for v in p.column("value").to_pylist()) for p in parts) < (
        jsonl.PARSED_AT_ONCE + 10_000
    )
    whole = [row for p in parts for row in p.to_pylist()]
    assert len(parts) > 3 and [r["line_index"] for r in whole] == list(range(500))
    assert [r["value"] for r in whole] == lines
    assert [i for i, r in enumerate(whole) if not r["good"]] == [7, 300]
    assert all(r["ticker"] == f"T{i}" for i, r in enumerate(whole) if r["good"])
    assert all(len(r["items"]) == 1 for r in whole if r["good"])


def test_columns_and_types_stay(spark):
    line = '{"ticker":"A","fy":1,"values":[{"tag":"t","value":1}]}'
    given = spark.createDataFrame([("f", 3, line)], "file_name string, line_index long, value string")
    parsed = jsonl.parse_lines(given)
    assert parsed.dtypes[:3] == given.dtypes and parsed.filter("good").count() == 1
    assert parsed.select(F.col("items")[0]["value"]).first()[0] == "1"
