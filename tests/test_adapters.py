import datetime

import duckdb
import pytest

import __spark_entry__
from driver_queries import adapters as A


def order_table(spark, path, *keys):
    day = datetime.datetime(1998, 3, 1)
    spark.createDataFrame(
        [(k, 7, "F", 10.0, day, "1-URGENT") for k in keys],
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp_ntz, o_orderpriority string",
    ).write.parquet(f"{path}/orders.parquet")


def test_accession_numbers_end_in_six_digits(spark, tmp_path, rows):
    order_table(spark, tmp_path, 42, 1234567)
    got = rows(A.raw_filings(spark, str(tmp_path)), "o_orderkey", "accessionNumber")
    assert dict(got) == {42: "0000000007-98-000042", 1234567: "0000000007-98-123456"}


def test_pages_are_written_after_the_only_shuffle_of_lines(spark, tmp_path):
    order_table(spark, tmp_path, 42)
    day = datetime.datetime(1998, 4, 1)
    spark.createDataFrame(
        [(42, n, 5, 9, 100.0 + n, 3.0, 0.05, day) for n in (2, 1)],
        "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint,"
        " l_extendedprice double, l_quantity double, l_discount double, l_shipdate timestamp_ntz",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    pages = A.filing_pages(spark, str(tmp_path))
    html = pages.first()["html"]
    assert html.index("Line 1 of part 5") < html.index("Line 2 of part 5")
    plan = pages._jdf.queryExecution().toString().partition("== Physical Plan ==")[2]
    assert plan.count("Exchange ") == 2  # lines and orders
    assert "listagg" not in plan


@pytest.mark.parametrize(
    "name",
    [
        "collect_filings", "collect_filings_twice", "columnar_json_others", "columnar_json_rows",
        "usable_filings", "valid_filings", "filings_csv_round_trip", "filings_dedup",
        "filings_derive",
    ],
)
def test_filings_of_long_keys_are_those_of_the_sql(spark, tmp_path, name):
    day = datetime.datetime(1998, 3, 1)
    people = [(42, "One"), (1234567, "Two")]
    tables = {
        "nation": ([(1, "FRANCE")], "n_nationkey int, n_name string"),
        "customer": (
            [(k, n, 1, 5.0, "BUILDING") for k, n in people],
            "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,"
            " c_mktsegment string",
        ),
        "orders": (
            [
                (k, c, s, 10.0, day, "1-URGENT")
                for k, c, s in [(7, 42, "F"), (1000008, 1234567, "F"), (7654321, 1234567, "P")]
            ],
            "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
            " o_orderdate timestamp_ntz, o_orderpriority string",
        ),
    }
    db = duckdb.connect()
    for table, (content, schema) in tables.items():
        spark.createDataFrame(content, schema).write.parquet(f"{tmp_path}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = __spark_entry__.queries()[name](spark, str(tmp_path))
    want = db.execute(__spark_entry__.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(d[0] for d in want.description) == columns
    place = {d[0]: k for k, d in enumerate(want.description)}
    expected = [tuple(str(r[place[c]]) for c in columns) for r in want.fetchall()]
    found = [tuple(str(x) for x in r) for r in got.select(*columns).collect()]
    assert found and sorted(found) == sorted(expected)
