"""Token counts for every context limit from an exact histogram of encoded lengths.

Documents are encoded and at once reduced to a count per length, summed before anything is shuffled.
All answers come from the histogram: with sums from the right (how many documents are longer than a
limit) and from the left, totals, truncated totals and quantiles need no second look at a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.bpe import encoder, vocabulary_path
from factloom.session import cut_lineage

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Lengths that are summed in one group; groups are summed among themselves.
GROUP = 4096


def token_count(text: Column, vocabulary: str = VOCABULARY, pattern: str | None = None) -> Column:
    """Tokens of the whole text; none for null."""
    pattern = pattern or public_tokenizers.PATTERN

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(vocabulary_path(vocabulary), pattern)
        for texts in batches:
            yield pd.Series([len(ids) // 4 for ids in own.encode_all(texts)], dtype="int64")

    return count(text)


def length_histogram(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``n_tokens, n_docs``: how many rows of ``docs`` have each length.

    Null and empty texts have length 0, repeated rows count as often as they come, an empty table
    gives no rows. The histogram is written to the shared folder, so no answer encodes again.
    """
    lengths = docs.select(token_count(F.col(text), **options).alias("n_tokens"))
    counts = lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    return cut_lineage(counts, "lengths")


def context_totals(histogram: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """What a limit of ``limit`` tokens keeps, for each length that occurs or each of ``limits``.

    ``n_docs`` documents have just that length, ``docs_within`` at most that, ``docs_cut`` more;
    ``tokens_within`` are in documents that fit, ``tokens_kept`` are kept of all documents when
    longer ones are cut, ``tokens_lost`` are cut off, ``share_within`` is the share of documents
    that fit, which answers any quantile. Null limits and repeated ones are left out.
    """
    rows = histogram.select(F.col("n_tokens").alias("limit"), "n_docs")
    if limits is not None:
        asked = limits.select(F.col(limits.columns[0]).cast("long").alias("limit")).dropna()
        asked = asked.distinct().withColumns(
            {"n_docs": F.lit(0).cast("long"), "asked": F.lit(True)}
        )
        rows = rows.withColumn("asked", F.lit(False)).unionByName(asked)
        rows = rows.groupBy("limit").agg(
            F.sum("n_docs").alias("n_docs"), F.max("asked").alias("asked")
        )
    else:
        rows = rows.withColumn("asked", F.lit(True))
    rows = rows.withColumns(
        {"group": F.floor(F.col("limit") / GROUP), "tokens": F.col("limit") * F.col("n_docs")}
    )
    sums = rows.groupBy("group").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("size"))
    # One row for each GROUP of lengths: a text of a billion tokens adds a quarter of a million.
    after = Window.orderBy(F.col("group").desc()).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    ends = sums.select(
        "group",
        F.coalesce(F.sum("docs").over(after), none).alias("docs_after"),
        F.coalesce(F.sum("size").over(after), none).alias("size_after"),
    )
    whole = sums.agg(F.sum("docs").alias("all_docs"), F.sum("size").alias("all_tokens"))
    later = Window.partitionBy("group").orderBy(F.col("limit").desc())
    later = later.rowsBetween(Window.unboundedPreceding, -1)
    cut = F.coalesce(F.sum("n_docs").over(later), none) + F.col("docs_after")
    beyond = F.coalesce(F.sum("tokens").over(later), none) + F.col("size_after")
    out = (
        rows.join(ends, "group")
        .withColumns({"docs_cut": cut, "tokens_beyond": beyond})
        .filter("asked")
        .crossJoin(F.broadcast(whole))
    )
    kept = F.col("all_tokens") - F.col("tokens_beyond") + F.col("limit") * F.col("docs_cut")
    return out.select(
        "limit",
        "n_docs",
        (F.col("all_docs") - F.col("docs_cut")).alias("docs_within"),
        "docs_cut",
        (F.col("all_tokens") - F.col("tokens_beyond")).alias("tokens_within"),
        kept.alias("tokens_kept"),
        (F.col("all_tokens") - kept).alias("tokens_lost"),
        ((F.col("all_docs") - F.col("docs_cut")) / F.col("all_docs")).alias("share_within"),
    )


def length_quantiles(totals: DataFrame, shares: list[float]) -> DataFrame:
    """``share, n_tokens``: the least length that at least this share of documents has at most."""
    asked = totals.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    return (
        totals.select("limit", "share_within")
        .join(F.broadcast(asked), F.col("share_within") >= F.col("share") - 1e-12)
        .groupBy("share")
        .agg(F.min("limit").alias("n_tokens"))
    )
