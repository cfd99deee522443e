import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tests_llm_help import documents
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def known():
    lines = open(PATH, "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def ids(raw):
    return np.frombuffer(raw, dtype="<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_same_ids_as_tiktoken_and_back(known, text):
    own = bpe.encoder(PATH, public_tokenizers.PATTERN)
    text = text.encode("utf-8", "ignore").decode()
    raw = own.encode(text)
    assert ids(raw) == known.encode_ordinary(text)
    assert own.decode(raw) == text.encode()


def test_blocks_and_forgetting_change_nothing(known, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 7)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    own = bpe.BytePairEncoder(PATH, public_tokenizers.PATTERN)
    text = "The quick  brown\n\n fox's 1234 tails, été 你好 " * 20
    for _ in range(2):
        assert ids(own.encode(text)) == known.encode_ordinary(text)


def test_long_runs(known):
    own = bpe.encoder(PATH, public_tokenizers.PATTERN)
    for text in ("a" * 20_000, " " * 20_000 + "b", "ab" * 3000):
        assert ids(own.encode(text)) == known.encode_ordinary(text)


def test_model_is_one_piece_per_rank():
    own = bpe.encoder(PATH, public_tokenizers.PATTERN)
    assert own.model.get_piece_size() == len(own.entries) + 1
    assert own.back == own.entries
    assert own.model.get_score(17) == -17.0


def test_edges(edge_docs, edge_texts, no_docs, known):
    out = bpe.encode_documents(edge_docs)
    assert set(out.columns) == set(edge_docs.columns)
    rows = out.select("doc_id", "text", "ids", "decoded").collect()
    assert len(rows) == edge_docs.count()
    for row in rows:
        assert ids(row["ids"]) == known.encode_ordinary(row["text"] or "")
        assert bytes(row["decoded"]) == (row["text"] or "").encode()
    assert bpe.digests(bpe.encode_documents(no_docs)).collect() == []


def test_other_vocabulary(spark):
    docs = documents(spark, ["some words here"])
    one = bpe.encode_documents(docs, vocabulary="byte_bpe_50k.tiktoken").first()
    assert bytes(one["decoded"]) == b"some words here"


def test_one_worker_encodes_and_decodes(spark):
    """Two steps of Python in a task would be two workers, each with a vocabulary in memory."""
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    told = bpe.digests(bpe.encode_documents(docs))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert [r.n_tokens > 0 for r in told.orderBy("doc_id").collect()] == [True, False, False]
