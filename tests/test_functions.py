import math

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.functions.vectors import distance, fit_dimension, score


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, fn, values, kind="string"):
    out = column(spark, values, kind).select("i", fn(F.col("v")).alias("r")).orderBy("i")
    return [r["r"] for r in out.collect()]


def python_float(s):
    try:
        return float(s)
    except (TypeError, ValueError):
        return None


def python_int(s):
    try:
        return int(s)
    except (TypeError, ValueError):
        return None


NUMBERS = [
    "1", " 1.5 ", "1d", "1f", "1e5", "-2.", ".5", "+3", "1_000", "_1", "1__0", "inf", "-Infinity",
    "INF", "1,000", "", None, "abc", "1.2.3", "1e", "\xa07\xa0", "--1", "0x10", ".",
]


def test_float_follows_python(spark):
    assert apply(spark, X.float_or_null, NUMBERS) == [python_float(n) for n in NUMBERS]
    assert math.isnan(apply(spark, X.float_or_null, ["nan"])[0])


def test_int_follows_python(spark):
    assert apply(spark, X.int_or_null, NUMBERS) == [python_int(n) for n in NUMBERS]


def test_strip_follows_python(spark):
    values = ["  a ", "\xa0b\xa0", "\n\tc\r\n", "　d ", "\x1ce\x85", " ", "", None, "f g"]
    expected = [None if v is None else v.strip() for v in values]
    assert apply(spark, X.strip, values) == expected


def test_white_space_is_what_python_strips():
    every = {chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()}
    assert set(X.WHITE_SPACE) == every


def test_zero_fill_never_cuts(spark):
    assert apply(spark, X.zero_fill, ["320193", "12345678901", ""]) == [
        "0000320193", "12345678901", "0000000000",
    ]


def test_dates(spark):
    values = ["2023-12-31", "2023-1-5", "2023-13-01", "12/31/2023", "", None, "2023-02-30"]
    assert [d and str(d) for d in apply(spark, X.parse_date, values)] == [
        "2023-12-31", "2023-01-05", None, None, None, None, None,
    ]
    assert str(apply(spark, X.parse_two_formats, ["12/31/2023"])[0]) == "2023-12-31"


def test_names(spark):
    assert apply(spark, X.normalise_name, ["indices/sp 100", "a-b_c.d"]) == [
        "indices_sp_100", "a-b_c_d",
    ]
    assert apply(spark, X.slug, ["Note 1. Basis of (X) — Text.", "__A__b__"]) == [
        "note_1_basis_of_x_text", "a_b",
    ]
    assert apply(spark, lambda c: X.truncate(c, 3), ["abc", "abcd"]) == ["abc", "abc..."]
    assert apply(spark, lambda c: X.url_segment(c, -2), ["a/b/c", "a"]) == ["b", None]


@pytest.mark.parametrize("chunk", [0, 1])
def test_float_text_follows_python(spark, chunk):
    values = [0.0, -0.0, 1.0, 1234567.0, 12345678.9, 1e15, 1e16, 1.5e-5, 0.0001, 123.456, -2.5e20]
    values = values[chunk::2] + [float("inf"), float("-inf")]
    assert apply(spark, X.float_text, values, "double") == [repr(v) for v in values]


def test_two_decimals_follow_python(spark):
    values = [0.125, 0.375, 2.675, 1.005, -0.125, 12.345, 0.0, -3.14159, 1e6 + 0.005, 99.995]
    assert apply(spark, X.two_decimals, values, "double") == [f"{v:.2f}" for v in values]


def test_vectors(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [0.0, 2.0])], "a array<float>, b array<float>"
    )
    a, b = F.col("a"), F.col("b")
    got = df.select(*[distance(a, b, m).alias(m) for m in ("l2", "cosine", "dot")]).first()
    assert tuple(got) == (5.0, 1.0, 1.0)
    fitted = df.select(fit_dimension(a, 3).alias("up"), fit_dimension(a, 1).alias("down")).first()
    assert (fitted["up"], fitted["down"]) == ([1.0, 0.0, 0.0], [1.0])
    assert df.select(score(F.lit(3.0), "l2").alias("s")).first()["s"] == 0.25
    with pytest.raises(ValueError):
        distance(a, b, "manhattan")
