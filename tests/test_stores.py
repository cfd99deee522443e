import datetime
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import annotations, filings, universe, vectors
from factloom.operators.universe import YearRange
from factloom.plans import knowledge_base
from factloom.plans.annotate import AnnotationStore
from factloom.plans.collect import collect_filings
from factloom.plans import facts as facts_plan
from factloom.plans.facts import facts_of_ticker, filing_facts, refresh_facts
from factloom.schemas import FILINGS, NUMERIC_FACTS, VECTOR_RECORD
from factloom.session import cut_lineage
from factloom.sources import submissions, tables
from factloom.sources.jsonl import numbered_lines, read_records
from factloom.streaming.annotations import absorb_saves, current_states, track_saves

# --- line numbers and the annotation workflow --------------------------------


@pytest.mark.parametrize("split", [64, 1000, 10_000_000])
def test_line_numbers_for_any_split_size(spark, tmp_path, split):
    rnd = random.Random(split)
    expected = {}
    for name in ("a.jsonl", "b.jsonl", "c.jsonl"):
        lines = ["x" * rnd.choice([0, 1, 5, 80, 200]) + str(i) for i in range(rnd.randint(1, 90))]
        if name == "b.jsonl":
            lines = ["", *lines, "", "end"]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        expected.update({(name, i): line for i, line in enumerate(lines)})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r["file_name"], r["line_index"]): r["value"] for r in got} == expected
    assert len(got) == len(expected)


ITEMS = [
    {"tag": "assets_total", "value": 5, "units": "USD", "comments": "c"},
    {"tag": "net_income", "value": 1.50},
    {"tag": "goodwill", "value": None},
    {"tag": "x"},
    {"tag": "y", "value": True},
    {"tag": "z", "value": "text"},
]


def write_records(path):
    lines = [
        json.dumps({"ticker": "A", "fy": 2023, "values": ITEMS}),
        "{broken",
        "",
        "[1, 2]",
        json.dumps({"ticker": "B", "fy": "2022", "values": "none"}),
        json.dumps({"ticker": "C", "values": []}),
    ]
    path.write_text("\n".join(lines) + "\n")


def test_annotation_store(spark, tmp_path, rows):
    path = tmp_path / "in" / "set.jsonl"
    path.parent.mkdir()
    write_records(path)
    store = AnnotationStore(spark, str(tmp_path / "store"))
    rejected = store.ingest(str(path))
    assert sorted(rows(rejected, "line_index")) == [(1,), (2,), (3,)]
    assert sorted(rows(store.records(), "record_index", "ticker", "fy")) == [
        (0, "A", 2023), (4, "B", 2022), (5, "C", None),
    ]
    values = rows(store.items().orderBy("item_index"), "original_value")
    assert [v for (v,) in values] == ["5", "1.5", "None", "", "True", "text"]
    # A second upload of the same file changes nothing.
    store.ingest(str(path))
    assert (store.records().count(), store.items().count(), store.events().count()) == (3, 6, 6)

    item = "set.jsonl#0#1"
    for minute, status in ((1, "annotated"), (2, "verified")):
        store.save(
            spark.createDataFrame(
                [(item, f"v{minute}", "note", status, datetime.datetime(2030, 1, 1, 0, minute))],
                "item_id string, annotated_value string, annotation_comment string, status string,"
                " updated_at timestamp",
            )
        )
    shown = store.worklist().orderBy("item_index")
    assert rows(shown, "shown_value", "shown_comment", "shown_status")[:2] == [
        ("5", "", "pending"), ("v2", "note", "verified"),
    ]
    record = annotations.items_of_record(store.items(), store.annotations(), "set.jsonl#0")
    assert record.count() == 6
    assert rows(annotations.record_ids(store.records(), "set.jsonl"), "record_index") == [
        (0,), (4,), (5,),
    ]
    assert rows(annotations.file_names(store.records())) == [("set.jsonl",)]


def test_upsert(spark, rows):
    schema = "item_id string, annotated_value string, status string, updated_at timestamp"
    day = [datetime.datetime(2024, 1, d) for d in (1, 2, 3)]
    current = spark.createDataFrame([("a", "1", "pending", day[0]), ("b", "2", "x", day[0])], schema)
    saves = spark.createDataFrame([("b", "3", "y", day[2]), ("b", "4", "z", day[1]), ("c", "5", "w", day[1])], schema)
    got = annotations.upsert_annotations(current, saves)
    assert sorted(rows(got, "item_id", "annotated_value")) == [("a", "1"), ("b", "3"), ("c", "5")]


def test_saves_of_one_time_have_one_winner(spark, rows):
    schema = "item_id string, annotated_value string, status string, updated_at timestamp"
    day = datetime.datetime(2024, 1, 1)
    saves = [("a", str(k), "x", day) for k in range(9)]
    for order in (saves, saves[::-1]):
        frame = spark.createDataFrame(order, schema).repartition(3)
        got = annotations.upsert_annotations(frame.limit(0), frame)
        assert rows(got, "item_id", "annotated_value") == [("a", "8")]


def test_lines_with_repeated_keys_are_records(spark, rows):
    lines = [
        '{"ticker": "A", "fy": 1, "ticker": "B", "values": [1], "values": [{"tag": "x", "value": 2}]}',
        '{"a": 1} {"b": 2}', '{"a": 1}, {"b": 2}', '{"a":1}],garbage', "[{}]", "{", "7", None,
    ]
    df = spark.createDataFrame([("f", k, v) for k, v in enumerate(lines)], "file_name string, line_index long, value string")
    records, items, rejected = read_records(df)
    assert rows(records, "record_index", "ticker", "fy") == [(0, "B", 1)]
    assert rows(items, "original_tag", "original_value") == [("x", "2")]
    assert sorted(rows(rejected, "line_index")) == [(k,) for k in range(1, 8)]


def test_values_as_a_json_reader_takes_them(spark, rows):
    """Repeated keys inside items, numbers that JSON does not have, and items that stop the list."""
    values = (
        '[{"tag":"x","tag":"y","value":"6","value":"7"}, {"value":NaN,"units":1,"comments":true},'
        ' {"value":-Infinity}, {"value":{"a":[1,null]}}, {"value":1e400}, {"value":0.1, "units":2.0},'
        ' {"value":12345678901234567890123}, {"value":"\\ud83d\\ude00"}, 5, {"value":"after"}]'
    )
    lines = ['{"a":NaN,"fy":"2020","values":' + values + "}", '{"ticker":[1]}', '{"values":[{"tag":[1]},{}]}']
    df = spark.createDataFrame([("f", k, v) for k, v in enumerate(lines)], "file_name string, line_index long, value string")
    records, items, rejected = read_records(df)
    assert sorted(rows(records, "record_index", "fy")) == [(0, 2020), (2, None)]
    assert rows(rejected, "line_index") == [(1,)]
    got = sorted(rows(items, "item_index", "original_tag", "original_value", "original_units", "original_comments"))
    assert got == [
        (0, "y", "7", None, None), (1, None, "nan", "1", "1"), (2, None, "-inf", None, None),
        (3, None, "{'a': [1, None]}", None, None), (4, None, "inf", None, None),
        (5, None, "0.1", "2.0", None), (6, None, "12345678901234567890123", None, None),
        (7, None, "\U0001f600", None, None),
    ]


def test_changed_file_of_the_same_name(spark, tmp_path, rows):
    store = AnnotationStore(spark, str(tmp_path / "store"))
    for folder, text in (("one", "old"), ("two", "new")):
        for place in ("a", "b"):
            path = tmp_path / folder / place / "set.jsonl"
            path.parent.mkdir(parents=True)
            record = {"ticker": text + place, "values": [{"tag": "t", "value": text + place}] * 2}
            lines = [json.dumps(record)] * (2 if text == "old" else 3)
            path.write_text("\n".join(lines) + "\n")
        store.ingest(str(tmp_path / folder / "*" / "set.jsonl"))
        if text == "old":
            store.save(store.items().limit(1).select("item_id", F.lit("verified").alias("status")))
    assert sorted(rows(store.records(), "record_index", "ticker")) == [(0, "olda"), (1, "olda"), (2, "newa")]
    values = sorted(rows(store.items(), "item_id", "original_value"))
    assert [v for _, v in values] == ["olda"] * 4 + ["newa"] * 2
    assert sorted(rows(store.annotations(), "status")) == [("pending",)] * 5 + [("verified",)]


def test_insert_or_ignore(spark, rows):
    incoming = spark.createDataFrame([(1, 1, "x"), (1, 0, "y"), (2, 0, "z")], "k int, p int, v string")
    existing = spark.createDataFrame([(2,)], "k int")
    got = annotations.new_rows(incoming, existing, ["k"], F.col("p"))
    assert rows(got, "k", "v") == [(1, "y")]


def test_item_outcomes(spark, rows):
    items = spark.createDataFrame(
        [("1", "A", 2023, "revenue_total"), ("2", "A", 2023, "goodwill"), ("3", "A", 2023, "odd"),
         ("4", "A", 2023, None), ("5", "A", 2022, "revenue_total")],
        "item_id string, ticker string, fy long, original_tag string",
    )
    facts = spark.createDataFrame(
        [("Revenues", 1.0, "A", datetime.date(2023, 12, 31)),
         ("NetSales", 2.0, "A", datetime.date(2023, 6, 30)), ("Revenues", 3.0, "B", None)],
        "concept_name string, fact_value double, ticker string, report_date date",
    )
    got = annotations.match_items_to_facts(items, facts)
    assert sorted(rows(got, "item_id", "outcome", "fact_value"), key=str) == [
        ("1", "matched", 1.0), ("1", "matched", 2.0), ("2", "no_match", None),
        ("3", "unmapped", None), ("4", "unmapped", None), ("5", "no_match", None),
    ]


def test_tracked_states_by_hand(spark, tmp_path, rows):
    """Out-of-order and equal times, nulls, and a run without news."""
    rnd = random.Random(5)
    source, target, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    schema = "item_id string, annotated_value string, status string, updated_at timestamp"
    times = [None, *[datetime.datetime(2024, 1, 1, 0, 0, 0, 1 + k) for k in range(6)]]
    saves = [
        (rnd.choice("abcd"), rnd.choice([None, "1", "2", "3"]), rnd.choice(["x", "y"]), rnd.choice(times))
        for _ in range(60)
    ]
    for k in range(3):
        batch = spark.createDataFrame(saves[k * 20 : k * 20 + 20], schema)
        options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
        batch.write.mode("append").options(**options).json(source)
        track_saves(spark, source, target, log).awaitTermination()
    track_saves(spark, source, target, log).awaitTermination()
    got = current_states(spark, target)
    known = lambda v: (v is not None, v or 0)
    want = {}
    for item, value, status, time in saves:
        order = (known(time), (value is not None, value or ""), (True, status))
        if item not in want or order > want[item][0]:
            want[item] = (order, (item, value, status, time))
    assert sorted(rows(got, "item_id", "annotated_value", "status", "updated_at")) == sorted(
        w for _, w in want.values()
    )


def test_neighbours_across_ranges(spark, rows):
    index = [0, 3, 99_999, 100_000, 100_001, 300_000]
    df = spark.createDataFrame([("f", f"f#{i}", i) for i in index], "file_name string, record_id string, record_index long")
    got = rows(annotations.neighbours(df).orderBy("record_index"), "previous_id", "next_id")
    ids = [None, *[f"f#{i}" for i in index], None]
    assert got == [(ids[k], ids[k + 2]) for k in range(len(index))]


def test_stream_of_saves(spark, tmp_path, rows):
    source, target, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    schema = "item_id string, annotated_value string, updated_at timestamp"
    for day in (1, 2):
        spark.createDataFrame(
            [("a", str(day), datetime.datetime(2024, 1, day))], schema
        ).write.mode("append").json(source)
        absorb_saves(spark, source, target, log).awaitTermination()
    taken = spark.read.parquet(target)
    state = annotations.latest_state(taken, "item_id", F.col("updated_at").desc())
    assert taken.count() == 2 and rows(state, "annotated_value") == [("2",)]


# --- vectors -----------------------------------------------------------------


def vector_frame(spark, n=300, dim=8, seed=3):
    data = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    data[n // 2] = data[0]  # a tie
    listed = [(i, f"T{i % 3}", [float(x) for x in v]) for i, v in enumerate(data)]
    df = spark.createDataFrame(listed, "id long, ticker string, vector array<float>")
    return df.repartition(5), data.astype(np.float64)


def brute(data, query, metric, k, keep=None):
    if metric == "l2":
        d = ((data - query) ** 2).sum(axis=1)
    elif metric == "dot":
        d = 1 - data @ query
    else:
        d = 1 - data @ query / (np.linalg.norm(data, axis=1) * np.linalg.norm(query))
    order = sorted((round(x, 9), i) for i, x in enumerate(d) if keep is None or keep(i))
    return [i for _, i in order[:k]]


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_search_against_brute_force(spark, rows, metric):
    df, data = vector_frame(spark)
    query = data[0]
    got = vectors.search(df, list(query), limit=7, metric=metric, min_score=-5)
    assert "vector" not in got.columns
    assert [i for (i,) in rows(got, "id")] == brute(data, query, metric, 7)
    only = vectors.search(df, list(query), "T1", limit=7, metric=metric, min_score=-5)
    assert [i for (i,) in rows(only, "id")] == brute(data, query, metric, 7, lambda i: i % 3 == 1)


def test_score_bound_applies_after_the_limit(spark):
    df, data = vector_frame(spark)
    all_of = vectors.search(df, list(data[0]), limit=5)
    bound = sorted(r["score"] for r in all_of.collect())[2]
    assert vectors.search(df, list(data[0]), limit=5, min_score=bound).count() == 3


def test_null_and_zero_vectors_are_left_out(spark, rows):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, None), (4, [0.0, 0.0])], "id long, vector array<float>"
    )
    assert sorted(rows(vectors.search(df, [1.0, 0.0]), "id")) == [(1,), (4,)]
    assert rows(vectors.search(df, [1.0, 0.0], metric="cosine"), "id") == [(1,)]


def test_other_dimensions_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (3, [1.0])], "id long, vector array<float>")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query_vector array<double>")
    with pytest.raises(Exception, match="length"):
        vectors.search(df, [1.0, 0.0]).collect()
    with pytest.raises(Exception, match="length"):
        vectors.search_many(df, asked).collect()


def test_many_queries_in_blocks(spark, monkeypatch):
    df, data = vector_frame(spark)
    queries = spark.createDataFrame(
        [(i, [float(x) for x in data[i * 10]]) for i in range(9)],
        "query_id long, query_vector array<double>",
    )
    assert vectors.search_many(df, queries.limit(0)).collect() == []
    assert vectors.search_many(df.limit(0), queries).collect() == []
    monkeypatch.setattr(vectors, "QUERIES_PER_BLOCK", 4)
    monkeypatch.setattr(vectors, "RECORDS_PER_BLOCK", 30)
    got = vectors.search_many(df, queries, limit=4).orderBy("query_id", "rank").collect()
    for q in range(9):
        expected = brute(data, data[q * 10], "l2", 4)
        assert [r["id"] for r in got if r["query_id"] == q] == expected


def test_cells_find_most_neighbours(spark, tmp_path):
    rnd = np.random.default_rng(0)
    centres = rnd.normal(size=(12, 16)) * 6
    data = np.concatenate([c + rnd.normal(size=(60, 16)) for c in centres]).astype(np.float32)
    df = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, vector array<float>"
    )
    indexed, cell_centres = vectors.assign_cells(df, configured=16)
    assert len(cell_centres) <= 16
    indexed.write.partitionBy("cell").parquet(str(tmp_path / "cells"))
    queries = spark.createDataFrame(
        [(i, [float(x) for x in data[i * 60 + 1]]) for i in range(12)],
        "query_id long, query_vector array<double>",
    )
    stored = spark.read.parquet(str(tmp_path / "cells"))
    near = {(r["query_id"], r["id"]) for r in vectors.search_cells(
        stored, cell_centres, queries, probes=4).collect()}
    exact = {(r["query_id"], r["id"]) for r in vectors.search_many(df, queries).collect()}
    assert len(near & exact) / len(exact) > 0.9
    whole = vectors.search_cells(stored, cell_centres, queries, probes=16).collect()
    assert {(r["query_id"], r["id"]) for r in whole} == exact


def test_cells_with_measured_reach_and_later_rows(spark, tmp_path, monkeypatch):
    """Rows come after the centres were fitted, a third of all are equal, blocks are small."""
    monkeypatch.setattr(vectors, "RECORDS_PER_BLOCK", 40)
    monkeypatch.setattr(vectors, "QUERIES_PER_BLOCK", 3)
    rnd = np.random.default_rng(3)
    data = rnd.normal(size=(600, 8)).astype(np.float32)
    data[400:] = data[0]
    df = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, vector array<float>"
    )
    indexed, centres = vectors.assign_cells(df.filter("id < 300"), configured=12)
    path = str(tmp_path / "cells")
    vectors.store_cells(indexed, path)
    vectors.store_cells(vectors.place_in_cells(df.filter("id >= 300"), centres), path, "append")
    stored = spark.read.parquet(path)
    assert stored.count() == 600
    asked = df.filter("id % 13 = 0").selectExpr("id query_id", "vector query_vector")
    reach = vectors.measured_reach(stored, centres, 5)
    found = vectors.search_cells(stored, centres, asked, probes=1, limit=5, reach=reach).collect()
    want = {(q, i) for q in range(0, 600, 13) for i in brute(data, data[q], "l2", 5)}
    assert len({(r["query_id"], r["id"]) for r in found} & want) >= 0.9 * len(want)
    for r in found:
        off = data[r["query_id"]].astype(float) - data[r["id"]].astype(float)
        assert abs(r["distance"] - (off**2).sum()) < 1e-9
    assert vectors.measured_reach(stored.limit(0), centres, 5) == 0.0


def test_cell_count():
    assert [vectors.cell_count(n) for n in (0, 3, 100, 10**9)] == [2, 2, 10, 256]


def test_vector_table(spark, tmp_path, rows):
    table = tables.VectorTable(spark, str(tmp_path / "kb"), 3)
    assert table.read().count() == 0 and table.read().schema == VECTOR_RECORD
    docs = spark.createDataFrame([("A", "t", [1.0])], "ticker string, text string, vector array<float>")
    table.add(docs, "2024-01-01")
    table.add(docs.withColumn("source", F.lit("10-K_1")), "2024-01-02")
    assert sorted(rows(table.read(), "date", "source", "vector")) == [
        ("2024-01-01", "unknown", [1.0, 0.0, 0.0]), ("2024-01-02", "10-K_1", [1.0, 0.0, 0.0]),
    ]
    assert vectors.list_documents(table.read(), "A", 1).count() == 1
    table.clear()
    assert table.read().count() == 0


# --- sources, sinks and refreshes --------------------------------------------


def test_submissions(spark, tmp_path, rows):
    recent = {
        "accessionNumber": ["1", "2"], "form": ["10-K"], "filingDate": ["2024-01-01", "x"],
        "size": 7, "items": ["i1", "i2"],
    }
    (tmp_path / "CIK0000000005.json").write_text(json.dumps({"filings": {"recent": recent, "files": []}}))
    (tmp_path / "CIK0000000005-submissions-001.json").write_text(json.dumps({"accessionNumber": ["3"], "form": ["8-K"]}))
    (tmp_path / "CIK0000000006.json").write_text(json.dumps({"filings": {"recent": {"accessionNumber": []}}}))
    (tmp_path / "CIK0000000007.json").write_text(json.dumps([{"accessionNumber": "9", "form": "10-Q"}]))
    got = submissions.read_submissions(spark, str(tmp_path), ["items", "size"])
    order = got.orderBy("cik", "source_rank", "position")
    assert rows(order, "cik", "accessionNumber", "form", "items", "size") == [
        ("0000000005", "1", "10-K", "i1", None),
        ("0000000005", "2", None, "i2", None),
        ("0000000005", "3", "8-K", None, None),
        ("0000000007", "9", "10-Q", None, None),
    ]


def test_table_formats(spark, tmp_path, rows):
    schema = FILINGS
    row = {
        "ticker": "IBM", "cik": "0000051143", "form": "10-K", "accessionNumber": "n",
        "filingDate": "2024-02-20", "filing_date_dt": datetime.date(2024, 2, 20), "filing_year": 2024,
        "reportDate": "", "primaryDocument": None,
        "processed_datetime": datetime.datetime(2024, 1, 1, 12),
    }
    df = spark.createDataFrame([tuple(row.get(f.name) for f in schema)], schema)
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / f"f.{fmt}")
        assert tables.save_unless_empty(df, path)
        assert rows(tables.load_table(spark, path, schema)) == rows(df)
        assert rows(tables.scan_table(spark, path, schema)) == rows(df)
    with pytest.raises(ValueError):
        tables.scan_table(spark, "x", schema, "orc")
    with pytest.raises(ValueError):
        tables.write_table(df, str(tmp_path / "g"), "orc")
    assert not tables.save_unless_empty(df.filter("false"), str(tmp_path / "none.parquet"))
    assert not tables.table_exists(spark, str(tmp_path / "none.parquet"))
    assert tables.load_table(spark, str(tmp_path / "none.parquet"), schema).count() == 0


def test_replace_a_table_that_is_read(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    tables.replace_table(spark.read.parquet(path).filter("id > 0"), path, "parquet")
    assert sorted(rows(spark.read.parquet(path))) == [(1,), (2,)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_append_missing_and_facts_table(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("A", 1), ("B", 2)], "k string, v int")
    tables.append_missing(df, path, ["k"], ["k"])
    tables.append_missing(df.unionByName(df.withColumn("k", F.lit("C"))).filter("v = 2"), path, ["k"], ["k"])
    assert sorted(rows(spark.read.parquet(path), "k", "v")) == [("A", 1), ("B", 2), ("C", 2)]
    tables.append_facts(df, "facts_with_meta", {"form": "10-K"})
    tables.append_facts(df, "facts_with_meta", {"form": "10-Q"})
    assert spark.table("facts_with_meta").groupBy("form").count().count() == 2


def test_cut_lineage(spark):
    df = spark.range(5).withColumn("x", F.rand(1))
    cut = cut_lineage(df, "part")
    assert cut.count() == 5 and "Range" not in cut._jdf.queryExecution().toString()


def raw_filings(spark):
    return spark.createDataFrame(
        [("1", "n1", "10-K", "2022-02-01", "2021-12-31", "a.htm"),
         ("1", "n2", "10-K", "2023-02-01", "2022-12-31", "b.htm"),
         ("2", "n3", "10-K", "2023-03-01", "2022-12-31", "c.htm")],
        "cik string, accessionNumber string, form string, filingDate string, reportDate string, "
        "primaryDocument string",
    )


def test_collect_is_incremental_and_idempotent(spark, tmp_path, rows):
    securities = universe.securities_frame(
        spark, [{"ticker": t, "name": t, "exchange": "X"} for t in ("A", "B")]
    )
    mapping = spark.createDataFrame([("A", "0000000001"), ("B", "0000000002")], "ticker string, cik string")
    path = str(tmp_path / "filings")
    raw = raw_filings(spark)

    def run(years, source=raw, force=True):
        return collect_filings(
            securities, YearRange(*years, 2024), mapping, source, path, "parquet", force
        )

    assert sorted(rows(run((2022, 2022)), "accessionNumber")) == [("n1",)]
    # Without a forced check the stored table stands.
    assert run((2022, 2023), force=False).count() == 1
    assert sorted(rows(run((2022, 2023)), "accessionNumber")) == [("n1",), ("n2",), ("n3",)]
    late = raw.withColumn("primaryDocument", F.lit("changed"))
    again = run((2022, 2023), late)
    assert sorted(rows(again, "primaryDocument")) == [("a.htm",), ("b.htm",), ("c.htm",)]


def test_unnamed_index_fields(spark, rows):
    """Arrays at the root, below it, and a list of objects; what is no array is left out."""
    docs = [
        {"accessionNumber": ["1", "2"], "size": [10, None], "name": "x", "items": ["a"]},
        {"filings": {"recent": {"accessionNumber": ["3"], "size": [30], "form": ["10-K"]}}, "act": ["no"]},
        [{"accessionNumber": "4", "form": "8-K", "size": 40, "act": "34"}],
    ]
    files = spark.createDataFrame(
        [(str(k), 0, f"f{k}", json.dumps(d)) for k, d in enumerate(docs)],
        "cik string, source_rank int, file_name string, value string",
    )
    got = submissions.filings_from_json(files, ["items"], others="rest")
    assert sorted(rows(got, "accessionNumber", "form", "items")) == [
        ("1", None, "a"), ("2", None, None), ("3", "10-K", None), ("4", "8-K", None),
    ]
    rest = {r["accessionNumber"]: r["rest"] for r in got.collect()}
    assert rest == {"1": {"size": "10"}, "2": {"size": None}, "3": {"size": "30"}, "4": {"size": "40", "act": "34"}}


HTML = """<html xmlns:us-gaap="http://fasb.org/us-gaap/2023"><body><h1>R</h1>
<xbrli:context id="c"><xbrli:period><xbrli:instant>2022-12-31</xbrli:instant></xbrli:period></xbrli:context>
<ix:nonFraction name="us-gaap:Assets" contextRef="c" id="f">{}</ix:nonFraction>
<ix:nonNumeric name="us-gaap:Note" contextRef="c" id="g">words</ix:nonNumeric></body></html>"""


def described(spark):
    return spark.createDataFrame(
        [(1, "A", "u", datetime.date(2023, 2, 1), datetime.date(2022, 12, 31), "10-K", "n1", "2023-02-01"),
         (2, "B", "u", datetime.date(2023, 3, 1), None, "10-K", "n2", "2023-03-01"),
         (3, "B", None, datetime.date(2023, 3, 1), None, "10-K", "n3", "2023-03-01")],
        "filing_id int, ticker string, xbrl_instance_url string, filing_date_dt date, "
        "report_date_dt date, form string, accessionNumber string, filingDate string",
    )


def fact_pages(spark):
    listed = [(i, HTML.format(i * 100)) for i in (1, 2, 3)] + [(4, "<p>none</p>")]
    return spark.createDataFrame(listed, "filing_id int, html string")


def test_filing_facts_end_to_end(spark, rows):
    numeric, text = filing_facts(described(spark), fact_pages(spark))
    assert numeric.dtypes == [(f.name, f.dataType.simpleString()) for f in NUMERIC_FACTS]
    assert sorted(rows(numeric, "ticker", "concept_name", "fact_value", "concept_namespace")) == [
        ("A", "Assets", 100.0, "us-gaap"), ("B", "Assets", 200.0, "us-gaap"),
    ]
    assert sorted(rows(text, "ticker", "fact_value")) == [("A", "words"), ("B", "words")]
    assert facts_of_ticker(described(spark), fact_pages(spark), "A").count() == 1


def read_times(spark, path):
    log = spark.read.parquet(f"{path}.read").filter("digest is not null")
    return {r["filing_key"]: r["count"] for r in log.groupBy("filing_key").count().collect()}


def test_facts_refresh_reads_new_and_changed_pages(spark, tmp_path, rows):
    path = str(tmp_path / "facts")
    everyone = universe.securities_frame(
        spark, [{"ticker": t, "name": t, "exchange": "X"} for t in ("A", "B")]
    )
    pages = fact_pages(spark)
    first = refresh_facts(everyone.filter("ticker = 'A'"), described(spark), pages, path)
    assert rows(first, "ticker", "fact_value") == [("A", 100.0)]
    assert [f.name for f in first.schema] == NUMERIC_FACTS.fieldNames()
    second = refresh_facts(everyone, described(spark), pages, path)
    assert sorted(rows(second, "ticker", "fact_value")) == [("A", 100.0), ("B", 200.0)]
    assert read_times(spark, path) == {"1": 1, "2": 1}
    # Filing 4 is a new one of a stored ticker without any fact, filing 3 gets its address late.
    late = described(spark).withColumn("xbrl_instance_url", F.lit("u"))
    late = late.unionByName(late.filter("filing_id = 1").withColumn("filing_id", F.lit(4)))
    third = refresh_facts(everyone, late, pages, path)
    assert sorted(rows(third, "ticker", "fact_value")) == [("A", 100.0), ("B", 200.0), ("B", 300.0)]
    fourth = refresh_facts(everyone, late, pages.filter("false"), path)
    assert fourth.count() == 3 and set(read_times(spark, path).values()) == {1}
    # A changed page replaces the facts of its filing and of no other.
    changed = pages.withColumn("html", F.replace("html", F.lit(">200<"), F.lit(">999<")))
    fifth = refresh_facts(everyone, late, changed, path)
    assert sorted(rows(fifth, "ticker", "fact_value")) == [("A", 100.0), ("B", 300.0), ("B", 999.0)]
    refresh_facts(everyone, late, changed, path)
    times = read_times(spark, path)
    assert times["1"] == times["4"] == 1 and times["2"] == 2
    # A page that loses its facts empties the folder of its ticker.
    bare = changed.withColumn("html", F.when(F.col("filing_id") == 1, "<p>none</p>").otherwise(F.col("html")))
    last = refresh_facts(everyone, late, bare, path)
    assert sorted(rows(last, "ticker", "fact_value")) == [("B", 300.0), ("B", 999.0)]
    assert sorted(rows(refresh_facts(everyone, late, pages, path), "fact_value")) == [(100.0,), (200.0,), (300.0,)]


def test_pages_that_land_later_and_broken_runs(spark, tmp_path, rows, monkeypatch):
    path = str(tmp_path / "facts")
    everyone = universe.securities_frame(
        spark, [{"ticker": t, "name": t, "exchange": "X"} for t in ("A", "B")]
    )
    pages = fact_pages(spark)
    blank = F.when(F.col("filing_id") == 1, F.col("html"))
    first = refresh_facts(everyone, described(spark), pages.withColumn("html", blank), path)
    assert rows(first, "ticker", "fact_value") == [("A", 100.0)]
    # Facts of filing 2 are written, the log is not; the next run does not double them.
    real = facts_plan._note

    def broken(*_):
        raise OSError("gone")

    monkeypatch.setattr(facts_plan, "_note", broken)
    with pytest.raises(OSError):
        refresh_facts(everyone, described(spark), pages, path)
    monkeypatch.setattr(facts_plan, "_note", real)
    second = refresh_facts(everyone, described(spark), pages, path)
    assert sorted(rows(second, "ticker", "fact_value")) == [("A", 100.0), ("B", 200.0)]
    # A run that breaks off while folders change makes the next one read all that is in them.
    monkeypatch.setattr(facts_plan, "refresh_partitions", broken)
    changed = pages.withColumn("html", F.replace("html", F.lit(">100<"), F.lit(">7<")))
    with pytest.raises(OSError):
        refresh_facts(everyone, described(spark), changed, path)
    monkeypatch.undo()
    third = refresh_facts(everyone, described(spark), changed, path)
    assert sorted(rows(third, "ticker", "fact_value")) == [("A", 7.0), ("B", 200.0)]


def test_facts_refresh_without_facts_and_with_digits(spark, tmp_path, rows):
    path = str(tmp_path / "facts")
    digits = {"A": "0700", "B": "0005"}
    renamed = described(spark).replace(digits, subset=["ticker"])
    everyone = universe.securities_frame(
        spark, [{"ticker": t, "name": t, "exchange": "X"} for t in digits.values()]
    )
    blank = fact_pages(spark).withColumn("html", F.lit("<p>none</p>"))
    assert refresh_facts(everyone, renamed, blank, path).collect() == []
    other = str(tmp_path / "other")
    for _ in range(2):
        got = refresh_facts(everyone, renamed, fact_pages(spark), other)
        assert sorted(rows(got, "ticker", "fact_value")) == [("0005", 200.0), ("0700", 100.0)]


def test_failed_replacement_keeps_the_old_table(spark, tmp_path, rows, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    files, target, jvm = tables._files(spark, path)

    class Refusing:
        calls = 0

        def __getattr__(self, name):
            return getattr(files, name)

        def rename(self, a, b):
            self.calls += 1
            return False if self.calls == 2 else files.rename(a, b)

    monkeypatch.setattr(tables, "_files", lambda *_: (Refusing(), target, jvm))
    with pytest.raises(OSError):
        tables.replace_table(spark.range(9), path, "parquet")
    assert spark.read.parquet(path).count() == 3


def test_knowledge_base_records(spark, tmp_path, rows):
    records = knowledge_base.knowledge_base_records(
        described(spark), fact_pages(spark), 2, 2023, 2023
    )
    got = rows(records.orderBy("source"), "ticker", "source", "section", "date")
    assert got == [
        ("A", "10-K_n1", "chunk_1", "2023-02-01"), ("B", "10-K_n2", "chunk_1", "2023-03-01"),
        ("B", "10-K_n3", "chunk_1", "2023-03-01"),
    ]
    given = records.select("source", "section", F.array(F.lit(1.0)).alias("vector"))
    path = str(tmp_path / "kb")
    knowledge_base.store_records(records, given, path, 2, "2024-01-01")
    assert spark.read.parquet(path).count() == 3


def test_filing_texts_sink(spark, tmp_path, rows):
    filings_df = spark.createDataFrame(
        [("A", "1", "2023-02-01", "n1", None), ("A", "1", "03/05/2022", None, "x/Archives/edgar/data/1/n2/i.html"),
         ("A", "1", "odd", "n3", None), ("B", "", "2023-02-01", "n1", None), ("C", "3", "2023-01-01", "gone", None)],
        "ticker string, cik string, filingDate string, accessionNumber string, documents_url string",
    )
    raw = spark.createDataFrame(
        [(n, f"<DOCUMENT><TYPE>10-K<TEXT><p>{n}</p></TEXT>") for n in ("n1", "n2", "n3")],
        "accessionNumber string, raw string",
    )
    path = str(tmp_path / "texts")
    for _ in range(2):
        knowledge_base.store_filing_texts(filings_df, raw, path)
    got = sorted((t, str(y), x) for t, y, x in rows(spark.read.parquet(path), "ticker", "year", "text"))
    assert got == [("A", "2022", "n2"), ("A", "2023", "n1"), ("A", "unknown_year", "n3")]


def test_valid_filings(spark, rows):
    df = spark.createDataFrame(
        [("2023-01-01", "a"), ("2023/01/01", "b"), ("1999-01-01", "c"), ("2023-01-01", ""), (None, "d")],
        "filingDate string, accessionNumber string",
    )
    assert rows(filings.valid_filings(df, 2020, 2024), "accessionNumber") == [("a",)]
