"""One query per operator on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import ann, bpe, conversation_repair, decontaminate, hash_tree, language_model
from factloom.llm import pii, quality_rules, simhash, token_counts, toxicity, url_graph, whitening
from factloom.llm.common import prepare, table
from factloom.llm.oracles import ORACLES as ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SHARDS = 16


def query(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_url_filter(spark, sf):
    judged = url_graph.judged_pages(table(spark, sf, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op2_simhash(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    shown = simhash.hexadecimal(F.col("fingerprint"))
    return found.select("doc_id", shown.alias("fingerprint"), "component_id")


@query
def op3_personal_data(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = pii.find_spans(docs, pii.train(docs))
    return found.select(
        "doc_id",
        *[pii.kind_count(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.span_list(F.col("base")), 256).alias("base_sha256"),
        pii.span_list(F.col("spans")).alias("spans"),
    )


@query
def op4_byte_pairs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode_documents(docs))


@query
def op5_nearest(spark, sf):
    return ann.nearest(table(spark, sf, "embeddings"), F.col("id") % 20 == 0)


@query
def op6_language_model(spark, sf):
    return language_model.scored_documents(table(spark, sf, "documents"))


@query
def op7_sharding(spark, sf):
    tree = hash_tree.even_tree(SHARDS)
    return hash_tree.assign_shards(table(spark, sf, "documents"), tree)


@query
def op8_token_counts(spark, sf):
    return token_counts.context_totals(
        token_counts.length_histogram(table(spark, sf, "documents"))
    )


@query
def op9_decontamination(spark, sf):
    found = decontaminate.overlaps(
        table(spark, sf, "documents"), table(spark, sf, "benchmark")
    )
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", items.alias("items_sha256"), "contaminated"
    )


@query
def op10_toxicity(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, table(spark, sf, "labels"))
    scored = toxicity.score(docs, chain)
    return scored.select("doc_id", "chances.*", F.col("rejected").alias("is_toxic"))


@query
def op11_quality_rules(spark, sf):
    judged = quality_rules.judged(table(spark, sf, "documents"))
    counts = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()
    return judged.select("doc_id", *[f"measures.{c}" for c in counts], "base_failed", "kept")


@query
def op12_conversation_repair(spark, sf):
    rows = table(spark, sf, "conversations")
    return conversation_repair.repairs(conversation_repair.damaged(rows), rows)


@query
def op13_whitening(spark, sf):
    return whitening.whitened(table(spark, sf, "embeddings"))
