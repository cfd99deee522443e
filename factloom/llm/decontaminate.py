"""Benchmark decontamination by a prefix-filtered set join.

A window is a run of benchmark words as long as the rule says, or a whole shorter item. Each window
is a set of word shingles. They are ordered by how rare they are in the documents, and since all of
a window must occur, the rarest one is prefix enough: documents are joined on it alone. Bounds on
position and length drop candidates that would begin before the text or end after it; the rest is
verified word by word over the window's own size.

Documents are read twice, once to count the shingles that benchmarks use and once to find those that
were chosen. In both passes a bitmap of bounded size, built from the benchmark, drops most shingles
before anything is shuffled. It may let others pass and never drops one that counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import ROW, numbered
from factloom.session import cut_lineage

WINDOW, SHINGLE = 13, 3
#: Bytes of text that are hashed at once.
BLOCK = 1 << 16
#: Bits of a bitmap for each shingle it holds, and the most bits it has (8 MB).
BITS_EACH, MOST_BITS = 1024, 1 << 26
#: Word characters after lower-casing: 0-9, a-z and all but ASCII; any other byte ends a word.
_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
FOLD = bytes(
    b if b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def _powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(_BASE, BLOCK + 1)
_INVERSE = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), BLOCK + 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def _hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, by a running polynomial over blocks of words."""
    out, k = [], 0
    while k < len(words):
        size, end = 0, k
        while end < len(words) and (size == 0 or size + len(words[end]) <= BLOCK):
            size += len(words[end])
            end += 1
        flat = np.frombuffer(b"".join(words[k:end]), dtype=np.uint8).astype(np.uint64)
        ends = np.cumsum([len(w) for w in words[k:end]])
        starts = np.concatenate([[0], ends[:-1]])
        if size > BLOCK:  # one word longer than a block
            powers, inverse = _powers(_BASE, size + 1), np.ones(1, dtype=np.uint64)
        else:
            powers, inverse = _POWERS, _INVERSE
        terms = np.cumsum((flat + np.uint64(1)) * powers[:size])
        sums = np.concatenate([np.zeros(1, np.uint64), terms])
        own = (sums[ends] - sums[starts]) * inverse[starts]
        out.append(_mixed(own + (ends - starts).astype(np.uint64)))
        k = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    count = max(0, len(hashes) - size + 1)
    out = np.full(count, size, dtype=np.uint64)
    for k in range(size):
        out = _mixed(out * _BASE + hashes[k : k + count])
    return out


def benchmark_windows(
    items: DataFrame, item: str, text: str, window: int = WINDOW, shingle: int = SHINGLE
) -> DataFrame:
    """``item, words, size, shingle, hash, offset``: every shingle of every window of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(content)
                size = min(window, len(words))
                if not size:
                    continue
                length = min(shingle, size)
                hashes = shingle_hashes(_hash_words(words), length).view(np.int64)
                per = size - length + 1
                begins = np.arange(len(words) - size + 1)
                at = (begins[:, None] + np.arange(per)).ravel()
                texts = [b" ".join(words[k : k + size]).decode() for k in begins.tolist()]
                n = len(at)
                yield pa.record_batch(
                    [
                        pa.array([name] * n, type=pa.string()),
                        pa.array(np.repeat(np.array(texts, dtype=object), per), type=pa.string()),
                        pa.array(np.full(n, size, dtype=np.int32)),
                        pa.array(np.full(n, length, dtype=np.int32)),
                        pa.array(hashes[at]),
                        pa.array(np.tile(np.arange(per, dtype=np.int32), len(begins))),
                    ],
                    names=["item", "words", "size", "shingle", "hash", "offset"],
                )

    return items.select(F.col(item).cast("string"), F.col(text)).mapInArrow(
        cut, "item string, words string, size int, shingle int, hash long, offset int"
    )


def bitmap(hashes: DataFrame, count: int) -> np.ndarray:
    """A bitmap of ``hash``, of at most ``MOST_BITS`` bits; filled in Spark, 64 bits a row."""
    bits = min(MOST_BITS, 1 << max(16, (count * BITS_EACH - 1).bit_length()))
    place = F.shiftrightunsigned("hash", 64 - (bits.bit_length() - 1))
    cells = (
        hashes.select(place.alias("place"))
        .groupBy(F.shiftright("place", 6).alias("cell"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits"))
    )
    out = np.zeros(bits >> 6, dtype=np.uint64)
    found = cells.toArrow()
    out[found["cell"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _within(cells: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - (len(cells) * 64).bit_length() + 1)
    return (cells[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def _counted(docs: DataFrame, cells, lengths: list[int]) -> DataFrame:
    """``hash, count`` of shingles that the bitmap lets pass, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for content in batch.column(0):
                hashes = _hash_words(words_of(content.as_py()))
                for length in lengths:
                    own = shingle_hashes(hashes, length)
                    found.append(own[_within(cells.value, own)])
            if found:
                values, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch(
                    [pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))],
                    names=["hash", "count"],
                )

    seen = docs.mapInArrow(count, "hash long, count long")
    return seen.groupBy("hash").agg(F.sum("count").alias("count"))


CANDIDATE = "array<struct<hash:long,at:int,before:int,near:string>>"


def _candidates(docs: DataFrame, key: str, text: str, cells, lengths, window) -> DataFrame:
    """``__row, key, n_words, found``: where chosen shingles may occur, with the words around."""
    kind = docs.schema[key].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for content in batch.column(2):
                words = words_of(content.as_py())
                hashes = _hash_words(words)
                own = []
                for length in lengths:
                    all_of = shingle_hashes(hashes, length)
                    places = np.flatnonzero(_within(cells.value, all_of))
                    for value, at in zip(
                        all_of[places].view(np.int64).tolist(), places.tolist(), strict=True
                    ):
                        begin = max(0, at - window + length)
                        near = b" ".join(words[begin : at + window]).decode()
                        own.append({"hash": value, "at": at, "before": at - begin, "near": near})
                sizes.append(len(words))
                found.append(own)
            shape = pa.list_(
                pa.struct(
                    [
                        ("hash", pa.int64()),
                        ("at", pa.int32()),
                        ("before", pa.int32()),
                        ("near", pa.string()),
                    ]
                )
            )
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, type=pa.int64()),
                    pa.array(found, type=shape),
                ],
                names=[ROW, "key", "n_words", "found"],
            )

    return docs.select(ROW, key, text).mapInArrow(
        find, f"{ROW} long, key {kind}, n_words long, found {CANDIDATE}"
    )


def covered(spans: Column) -> Column:
    """How many places the spans (``begin``, ``end`` exclusive; sorted) cover."""
    zero = F.struct(F.lit(0).alias("count"), F.lit(0).alias("reach"))

    def add(a, x):
        more = F.greatest(F.lit(0), x["end"] - F.greatest(x["begin"], a["reach"]))
        reach = F.greatest(a["reach"], x["end"])
        return F.struct((a["count"] + more).alias("count"), reach.alias("reach"))

    return F.aggregate(spans, zero, add, lambda a: a["count"].cast("long"))


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    share: tuple[int, int] = (1, 20),
    with_row: bool = False,
) -> DataFrame:
    """``key, n_words, n_hit, n_items, items, contaminated`` for each row of ``docs``.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` lists the ids (as text,
    sorted) of items with an occurring window. A document is contaminated if it has hits and they
    are at least ``share`` of its words. Nulls and texts without words have no words; such items
    have no windows. Repeated rows are judged each on its own, repeated items count once, and either
    table may be empty. ``docs`` may have any other columns. ``with_row`` keeps ``__row``, which
    ``docs`` must then bring along.
    """
    spark = docs.sparkSession
    windows = cut_lineage(benchmark_windows(items, item, item_text, window, shingle), "windows")
    sizes = windows.groupBy("shingle").agg(F.approx_count_distinct("hash").alias("n")).collect()
    lengths, count = sorted(r["shingle"] for r in sizes), sum(r["n"] for r in sizes)
    rows = docs if with_row else numbered(docs.select(key, text))

    cells = spark.sparkContext.broadcast(bitmap(windows.select("hash"), count))
    common = _counted(docs.select(text), cells, lengths)
    used = windows.select("words", "size", "hash", "offset").distinct()
    rarity = F.struct(F.coalesce("count", F.lit(0)), F.col("hash"), F.col("offset"))
    chosen = (
        used.join(common, "hash", "left")
        .groupBy("words", "size")
        .agg(F.min_by(F.struct("hash", "offset"), rarity).alias("prefix"))
        .select("words", "size", "prefix.hash", "prefix.offset")
    )
    chosen = cut_lineage(chosen, "prefixes")
    picked = spark.sparkContext.broadcast(bitmap(chosen.select("hash"), count))
    seen = cut_lineage(_candidates(rows, key, text, picked, lengths, window), "candidates")

    near = seen.select(ROW, "n_words", F.inline("found"))
    begin = F.col("at") - F.col("offset")
    end = begin + F.col("size")
    inside = (F.col("before") >= F.col("offset")) & (end <= F.col("n_words"))
    first = F.col("before") - F.col("offset") + 1
    same = F.array_join(F.slice(F.split("near", " "), first, F.col("size")), " ") == F.col("words")
    hits = (
        near.join(chosen, "hash")
        .filter(inside)
        .filter(same)
        .select(ROW, begin.alias("begin"), end.alias("end"), "words")
    )
    hits = cut_lineage(hits, "hits")
    spans = hits.groupBy(ROW).agg(
        covered(F.sort_array(F.collect_set(F.struct("begin", "end")))).alias("n_hit")
    )
    owners = windows.select("words", "item").distinct()
    found = (
        hits.select(ROW, "words")
        .distinct()
        .join(owners, "words")
        .groupBy(ROW)
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    out = seen.drop("found").join(spans, ROW, "left").join(found, ROW, "left")
    return out.select(
        *([ROW] if with_row else []),
        F.col("key").alias(key),
        "n_words",
        hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        listed.alias("items"),
        ((hit > 0) & (share[1] * hit >= share[0] * F.col("n_words"))).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    rows = cut_lineage(numbered(docs), "rows")
    judged = overlaps(rows, items, with_row=True, **options)
    # Written, so that its size is known and the texts stay where they are if it is small.
    bad = cut_lineage(judged.filter("contaminated").select(ROW), "contaminated")
    return rows.join(bad, ROW, "left_anti").drop(ROW)
