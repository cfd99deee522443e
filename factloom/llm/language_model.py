"""Scores of texts under a log-bilinear neural model trained with noise-contrastive estimation.

The model predicts the class of a token from its two predecessors. Classes are the most frequent
words, the end of a text, and one class for all other words, which are told apart by their counts in
the corpus. Vectors are learned in numpy inside Spark tasks: every training document is read in one
of a few rounds, each task starts from the parameters of the round before, and the next ones are the
averages over tasks. Training compares each token with words drawn from the unigram distribution;
scoring normalises over all classes with batched matrix products.

Counts cover all training documents and stay a table. Words that make up at least one token in
``HOT`` are few by that definition and go along with each task; all others meet their counts in a
join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import ROW, numbered
from factloom.session import cut_lineage

CLASSES, DIMENSIONS, ROUNDS = 512, 24, 3
#: Tokens of a training step, noise words it draws, and the rate of learning.
STEP, NOISE, RATE = 4096, 64, 0.15
HOT = 1 << 16
#: Tokens that are scored at once.
BLOCK = 1 << 18
#: A line feed is in no word, so it marks the end of a text.
END = "\n"
OTHER_CLASS, END_CLASS = 0, 1
HELD_OUT_OF, HELD_OUT = 7, 2


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def held_out(key: Column) -> Column:
    """Whether a document is kept from training; a null key is like an empty one."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % HELD_OUT_OF == HELD_OUT


class Parameters(NamedTuple):
    """Vectors of context words (the last row is the beginning of a text), weights of the two
    positions, vectors of predicted classes, and these classes' intercepts."""

    context: np.ndarray
    places: np.ndarray
    target: np.ndarray
    bias: np.ndarray


class Counts(NamedTuple):
    """Totals of the training tokens and the words that go along with tasks."""

    tokens: int
    distinct: int
    classes: list[str]
    hot: dict[str, int]
    class_tokens: np.ndarray

    @property
    def other_tokens(self) -> int:
        return int(self.class_tokens[OTHER_CLASS])

    @property
    def other_distinct(self) -> int:
        listed = len(self.classes) - 1 - (0 if self.class_tokens[END_CLASS] else 1)
        return self.distinct - listed


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, count`` over all rows of the one column of ``texts``, ends included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0):
                seen.update(words_of(text.as_py()))
            seen[END.encode()] += batch.num_rows
            yield pa.record_batch(
                [
                    pa.array([w.decode() for w in seen], type=pa.string()),
                    pa.array(list(seen.values()), type=pa.int64()),
                ],
                names=["word", "count"],
            )

    found = texts.mapInArrow(count, "word string, count long")
    return found.groupBy("word").agg(F.sum("count").alias("count"))


def summed(counts: DataFrame, classes: int = CLASSES) -> Counts:
    """What tasks need of the counts; at most ``HOT`` words and ``classes`` pass the driver."""
    tokens, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    words = counts.filter(F.col("word") != END)
    top = words.orderBy(F.col("count").desc(), "word").limit(classes - 2).collect()
    hot = {r["word"]: r["count"] for r in words.filter(F.col("count") * HOT >= tokens).collect()}
    hot.update((r["word"], r["count"]) for r in top)
    ends = counts.filter(F.col("word") == END).first()
    each = np.array([0, ends["count"] if ends else 0, *(r["count"] for r in top)], dtype=np.int64)
    each[OTHER_CLASS] = tokens - each.sum()
    return Counts(tokens, distinct, ["", END, *(r["word"] for r in top)], hot, each)


def started(counts: Counts, dimensions: int = DIMENSIONS) -> Parameters:
    """Parameters that give each class its share of the training tokens, whatever the context."""
    rng, size = np.random.default_rng(1), len(counts.classes)
    return Parameters(
        rng.normal(0, 0.1, (size + 1, dimensions)).astype(np.float32),
        np.ones((2, dimensions), dtype=np.float32),
        rng.normal(0, 0.1, (size, dimensions)).astype(np.float32),
        np.log(noise_of(counts)).astype(np.float32),
    )


def noise_of(counts: Counts) -> np.ndarray:
    share = counts.class_tokens + 1.0
    return share / share.sum()


def contexts(classes: np.ndarray, starts: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the predecessor and of the one before; ``begin`` where the text begins."""
    one, two = np.roll(classes, 1), np.roll(classes, 2)
    one[starts] = begin
    two[starts] = begin
    second = starts + 1
    second = second[second < len(classes)]
    two[second] = begin
    return one, two


def _scatter(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``values`` by row number."""
    out = np.zeros((size, values.shape[1]), dtype=np.float32)
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    out[ordered[starts]] = np.add.reduceat(values[order], starts)
    return out


class Trainer:
    """Noise-contrastive steps with step sizes that follow past gradients."""

    def __init__(self, parameters: Parameters, noise: np.ndarray, seed: int):
        self.own = Parameters(*(p.copy() for p in parameters))
        self.past = [np.full_like(p, 1e-4) for p in parameters]
        self.noise, self.rng = np.cumsum(noise), np.random.default_rng(seed)
        self.log_noise = np.log(noise * NOISE).astype(np.float32)
        self.tokens = 0

    def step(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        p, size = self.own, len(target)
        drawn = np.searchsorted(self.noise, self.rng.random(NOISE)).clip(0, len(p.bias) - 1)
        first, second = p.context[one], p.context[two]
        seen = first * p.places[0] + second * p.places[1]
        goal, others = p.target[target], p.target[drawn]
        true = np.einsum("ij,ij->i", seen, goal) + p.bias[target] - self.log_noise[target]
        false = seen @ others.T + p.bias[drawn] - self.log_noise[drawn]
        up = (1 / (1 + np.exp(np.clip(true, -30, 30)))).astype(np.float32)
        down = (-1 / (1 + np.exp(np.clip(-false, -30, 30)))).astype(np.float32)
        back = up[:, None] * goal + down @ others
        target_slope = _scatter(target, up[:, None] * seen, len(p.bias))
        np.add.at(target_slope, drawn, down.T @ seen)
        bias_slope = np.bincount(target, up, len(p.bias)).astype(np.float32)
        np.add.at(bias_slope, drawn, down.sum(axis=0))
        both = np.concatenate([back * p.places[0], back * p.places[1]])
        slopes = (
            _scatter(np.concatenate([one, two]), both, len(p.context)),
            np.stack([(back * first).sum(axis=0), (back * second).sum(axis=0)]),
            target_slope,
            bias_slope,
        )
        for value, past, slope in zip(p, self.past, slopes, strict=True):
            slope = slope / np.float32(size)
            past += slope * slope
            value += RATE * slope / np.sqrt(past)
        self.tokens += size


def _flat(parameters: Parameters) -> np.ndarray:
    """All parameters as rows: context, places, target, and intercepts in the last column."""
    width = parameters.context.shape[1]
    rows = np.concatenate([parameters.context, parameters.places, parameters.target])
    bias = np.zeros(len(rows), dtype=rows.dtype)
    bias[-len(parameters.bias) :] = parameters.bias
    return np.concatenate([rows, bias[:, None]], axis=1)[:, : width + 1]


def _unflat(rows: np.ndarray, classes: int) -> Parameters:
    rows = rows.astype(np.float32)
    head, tail = classes + 1, classes + 3
    return Parameters(rows[:head, :-1], rows[head:tail, :-1], rows[tail:, :-1], rows[tail:, -1])


def _class_ids(texts: Iterable, place: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all tokens of the texts, and where each text begins."""
    flat, starts = [], []
    for text in texts:
        starts.append(len(flat))
        flat += [place.get(w, OTHER_CLASS) for w in words_of(text)]
        flat.append(END_CLASS)
    return np.array(flat, dtype=np.int32), np.array(starts, dtype=np.int64)


def _groups(batch: pa.Array) -> Iterator[list]:
    """Texts whose characters together are few enough to be worked on at once."""
    group, size = [], 0
    for text in batch:
        text = text.as_py()
        group.append(text)
        size += len(text or "") + 1
        if size >= 4 * BLOCK:
            yield group
            group, size = [], 0
    if group:
        yield group


def train(
    texts: DataFrame, key: str, text: str, counts: Counts, rounds: int = ROUNDS
) -> Parameters:
    """Parameters after each row of ``texts`` was learned from once, in ``rounds`` rounds."""
    spark, noise = texts.sparkSession, noise_of(counts)
    place = {word.encode(): k for k, word in enumerate(counts.classes) if k > END_CLASS}
    parameters, size = started(counts), len(counts.classes)
    names = [f"v{k}" for k in range(DIMENSIONS + 1)]
    shape = "row int, weight double, " + ", ".join(f"{n} double" for n in names)
    for number in range(rounds):
        sent = spark.sparkContext.broadcast((parameters, noise, place))

        def learn(batches, sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            before, noise, place = sent.value
            trainer = Trainer(before, noise, 1000 + number)
            for batch in batches:
                for group in _groups(batch.column(0)):
                    classes, starts = _class_ids(group, place)
                    one, two = contexts(classes, starts, size)
                    order = trainer.rng.permutation(len(classes))
                    for k in range(0, len(order), STEP):
                        part = order[k : k + STEP]
                        trainer.step(classes[part], one[part], two[part])
            if trainer.tokens:
                rows = _flat(trainer.own).astype(float)
                columns = [pa.array(np.arange(len(rows), dtype=np.int32))]
                columns.append(pa.array(np.full(len(rows), float(trainer.tokens))))
                columns += [pa.array(rows[:, k].copy()) for k in range(rows.shape[1])]
                yield pa.record_batch(columns, names=["row", "weight", *names])

        part = texts.filter(F.pmod(F.xxhash64(key, F.lit("round")), F.lit(rounds)) == number)
        mean = [(F.sum(F.col(n) * F.col("weight")) / F.sum("weight")).alias(n) for n in names]
        learned = part.select(text).mapInArrow(learn, shape).groupBy("row").agg(*mean).collect()
        if learned:
            rows = np.array([r[1:] for r in sorted(learned, key=lambda r: r["row"])])
            parameters = _unflat(rows, size)
        sent.unpersist()
    return parameters


class Scorer:
    """Scores of whole texts, but for words that are not among the ``hot`` ones."""

    def __init__(self, parameters: Parameters, counts: Counts):
        self.own, self.size = parameters, len(counts.classes)
        words = [END, *sorted(counts.hot)]
        self.place = {word.encode(): k for k, word in enumerate(words)}
        number = {word: k for k, word in enumerate(counts.classes)}
        self.classes = np.array([number.get(w, OTHER_CLASS) for w in words] + [OTHER_CLASS])
        ends = counts.class_tokens[END_CLASS]
        seen = np.array([ends, *(counts.hot[w] for w in words[1:])], float)
        base = np.log10((seen + 1) / (counts.tokens + counts.distinct + 1))
        other = np.log10((seen + 1) / (counts.other_tokens + counts.other_distinct + 1))
        #: The last entry stands for words that are counted elsewhere.
        self.base = np.append(base, 0.0)
        self.other = np.append(np.where(self.classes[:-1] == OTHER_CLASS, other, 0.0), 0.0)
        self.known = np.append(seen > 0, False)
        self.sums = np.full((self.size + 1) ** 2, np.nan)

    def _seen(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        p = self.own
        return p.context[one] * p.places[0] + p.context[two] * p.places[1]

    def _normalise(self, codes: np.ndarray) -> None:
        """Sums over all classes for contexts that were not met before."""
        new = np.unique(codes[np.isnan(self.sums[codes])])
        for k in range(0, len(new), 8192):
            part = new[k : k + 8192]
            seen = self._seen(part % (self.size + 1), part // (self.size + 1))
            logits = seen @ self.own.target.T + self.own.bias
            top = logits.max(axis=1, keepdims=True)
            self.sums[part] = (top[:, 0] + np.log(np.exp(logits - top).sum(axis=1))).astype(float)

    def log_probabilities(self, classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probability of each token's class."""
        one, two = contexts(classes, starts, self.size)
        codes = two.astype(np.int64) * (self.size + 1) + one
        self._normalise(codes)
        out = np.empty(len(classes))
        for k in range(0, len(classes), 65_536):
            part = slice(k, k + 65_536)
            seen = self._seen(one[part], two[part])
            out[part] = np.einsum("ij,ij->i", seen, self.own.target[classes[part]])
        return out + self.own.bias[classes] - self.sums[codes]

    def score(self, texts: list) -> tuple[list, list, list, list, list]:
        """Tokens, known tokens, base score, model score, and words to be looked up, by text."""
        flat, starts, rare, last = [], [], [], len(self.base) - 1
        get, end = self.place.get, self.place[END.encode()]
        for text in texts:
            starts.append(len(flat))
            words = words_of(text)
            own = [get(w, last) for w in words]
            if last in own:
                rare.append(Counter(w for w, k in zip(words, own, strict=True) if k == last))
            else:
                rare.append({})
            flat += own
            flat.append(end)
        at, starts = np.array(flat, dtype=np.int64), np.array(starts, dtype=np.int64)
        classes = self.classes[at]
        model = self.log_probabilities(classes, starts) / math.log(10) + self.other[at]
        add = np.add.reduceat
        sizes = np.diff(np.append(starts, len(at)))
        listed = [
            [{"word": w.decode(), "times": n} for w, n in sorted(words.items())] for words in rare
        ]
        known = add(self.known[at].astype(np.int64), starts)
        return sizes, known, add(self.base[at], starts), add(model, starts), listed


RARE = "array<struct<word:string,times:long>>"


def _scored(
    docs: DataFrame, key: str, text: str, parameters: Parameters, counts: Counts
) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((parameters, counts))
    shape = pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for batch in batches:
            done = 0
            for group in _groups(batch.column(3)):
                sizes, known, base, model, rare = scorer.score(group)
                own = batch.slice(done, len(group))
                done += len(group)
                yield pa.record_batch(
                    [
                        *(own.column(k) for k in range(3)),
                        pa.array(sizes, type=pa.int64()),
                        pa.array(known, type=pa.int64()),
                        pa.array(base, type=pa.float64()),
                        pa.array(model, type=pa.float64()),
                        pa.array(rare, type=shape),
                    ],
                    names=[ROW, "key", "held_out", "n_tokens", "known", "base", "model", "rare"],
                )

    kind = docs.schema[key].dataType.simpleString()
    rows = numbered(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    return rows.select(ROW, "key", held_out(F.col("key")).alias("held_out"), "text").mapInArrow(
        score,
        f"{ROW} long, key {kind}, held_out boolean, n_tokens long, known long, base double, "
        f"model double, rare {RARE}",
    )


def scored_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    classes: int = CLASSES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row.

    Null and empty texts are one token, the end. Documents whose key has the remainder ``HELD_OUT``
    are scored and not learned from; without any others all words are unknown and all classes
    equally likely. Repeated rows are learned from and scored each; other columns are left out.
    """
    learned = docs.filter(~held_out(F.col(key)))
    table = cut_lineage(word_counts(learned.select(text)), "word-counts")
    counts = summed(table, classes)
    parameters = train(learned.select(key, text), key, text, counts, rounds)
    scored = cut_lineage(_scored(docs, key, text, parameters, counts), "scored")
    met = scored.select(ROW, F.inline("rare")).join(table, "word", "left")
    seen = F.coalesce("count", F.lit(0))
    every, others = counts.tokens + counts.distinct, counts.other_tokens + counts.other_distinct
    looked_up = met.groupBy(ROW).agg(
        F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((seen + 1) / F.lit(float(every + 1)))).alias("more_base"),
        F.sum(F.col("times") * F.log10((seen + 1) / F.lit(float(others + 1)))).alias("more_model"),
    )
    none = F.lit(0.0)
    return scored.drop("rare").join(looked_up, ROW, "left").select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", none)).alias("base_score"),
        (F.col("model") + F.coalesce("more_model", none)).alias("score"),
    )
