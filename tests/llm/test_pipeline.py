import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from test_decontaminate import judged
from test_near_copies import first_ones
from test_pii import cover, spans

import corpus_pipeline
from factloom.llm import bpe, simhash, toxicity
from factloom.llm.common import table
from factloom.session import cut_lineage

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage."""
    out, docs = [], table(spark, FOLDER, "documents")
    out.append({r["doc_id"]: r for r in docs.collect()})
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = cut_lineage(stage(spark, docs, FOLDER), name)
        assert name == "byte_pairs" or docs.columns == columns
        out.append({r["doc_id"]: r for r in docs.collect()})
    return out


def test_toxic_documents_go(spark, stages):
    docs = table(spark, FOLDER, "documents")
    chain = toxicity.train(docs, table(spark, FOLDER, "labels"))
    bad = {r["doc_id"] for r in toxicity.score(docs, chain).filter("rejected").collect()}
    assert set(stages[1]) == set(stages[0]) - bad


def test_one_of_each_class_stays(stages):
    """All pairs of five-word shingle sets, 0.8 or more."""
    keys = sorted(stages[1])
    kept = first_ones([stages[1][k]["text"] for k in keys])
    assert set(stages[2]) == {keys[k] for k in kept}


def test_contaminated_documents_go(stages):
    items = pq.read_table(f"{FOLDER}/benchmark.parquet").to_pylist()
    found = judged([(k, r["text"]) for k, r in stages[2].items()], [(i["item_id"], i["text"]) for i in items])
    assert set(stages[3]) == {k for k, f in found.items() if not f[3]}
    assert all(stages[3][k] == stages[0][k] for k in stages[3])


def test_personal_data_is_replaced(stages):
    assert set(stages[4]) == set(stages[3])
    for key, row in stages[4].items():
        before = stages[3][key]["text"]
        if not spans(before):
            assert row["text"] == before
        elif row["text"] != cover(before, spans(before)):
            assert len(re.findall(r"\[(?:EMAIL|IP|CARD|PHONE)\]", row["text"])) > len(spans(before))
        assert row["n_chars"] == len(row["text"])


def test_ids_of_all_kept_documents(stages):
    import hashlib

    own = bpe.encoder(bpe.vocabulary_path(bpe.VOCABULARY), bpe.public_tokenizers.PATTERN)
    assert set(stages[5]) == set(stages[4])
    for key, row in stages[5].items():
        raw = own.encode(stages[4][key]["text"])
        assert row["n_tokens"] == len(raw) // 4
        assert row["ids_sha256"] == hashlib.sha256(raw).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(stages[4][key]["text"].encode()).hexdigest()


def test_stages_on_edge_rows(spark, edge_docs):
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, FOLDER), "edge")
    assert docs.count() > 0
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    assert np.uint64(simhash.fingerprint_of(None)) == 0
