import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tests_llm_help import SCHEMA, documents, invented  # noqa: E402

CLASHING = (
    "ids decoded fingerprint component_id shard slot size spans base rejected key chances count "
    "hash items __row"
).split()


@pytest.fixture
def edge_texts():
    long = " ".join(invented(300, seed=9))
    return ["", None, " \t\n", "word", "One two", "a" * 5000, long, long, "Été 你好 \U0001f600 x", "xxx\x00y"]


@pytest.fixture
def edge_docs(spark, edge_texts):
    """Nulls, empty and long texts, repeated rows, and columns named like results."""
    docs = documents(spark, edge_texts)
    nameless = documents(spark, ["no id"]).withColumn("doc_id", F.lit(None).cast("long"))
    docs = docs.union(docs.filter("doc_id < 3")).union(nameless)
    return docs.withColumns({n: F.lit(n) for n in CLASHING})


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
