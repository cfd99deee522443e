"""Toxicity by a classifier chain over categories.

Each link of the chain is a linear model on the presence of words and stems and on the probabilities
of all earlier links. While a link is trained, the earlier probabilities of a document come from
models that have not seen that document (out-of-fold), as they will when new documents are scored.

No word is given beforehand. Terms are all those of the labelled documents that go with the label
beyond chance. The earlier categories are groups of toxic documents that use the same such terms,
found by k-means; the last category is the given label. The threshold is the one with the best F1
on out-of-fold predictions.

Models are fitted on a bounded, documented sample of labelled rows; all documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.decontaminate import words_of
from factloom.session import cut_lineage

#: Labelled documents that models are fitted on, and documents a term must be in.
SAMPLE, LEAST_DOCS = 12_000, 8
#: Standard errors that a term's share in toxic and clean documents must lie apart.
APART = 4.0
FOLDS, STEPS, INNER, RIDGE = 5, 10, 25, 0.3
#: Groups of toxic documents, and rounds in which they are found.
GROUPS, ROUNDS = 3, 10
#: Letters of a word that are its stem.
STEM = 4
LABEL = "toxic"


class Link(NamedTuple):
    """One linear model: weights of words, then of earlier probabilities, then the intercept."""

    category: str
    weights: np.ndarray | None


class Chain(NamedTuple):
    """``recall`` and ``clean_rejected`` are shares of out-of-fold predictions at the threshold."""

    words: list[str]
    links: list[Link]
    threshold: float
    recall: float = 0.0
    clean_rejected: float = 0.0


class Presence:
    """Which terms each document has, as sorted pairs, with a few columns of numbers beside them."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, count: int, width: int, beside=None):
        self.rows, self.terms, self.count, self.width = rows, terms, count, width
        self.beside = np.zeros((count, 0)) if beside is None else beside

    def taken(self, mask: np.ndarray) -> Presence:
        place, inside = np.cumsum(mask) - 1, mask[self.rows]
        rows, terms = place[self.rows[inside]], self.terms[inside]
        return Presence(rows, terms, int(mask.sum()), self.width, self.beside[mask])

    def extended(self, column: np.ndarray) -> Presence:
        beside = np.concatenate([self.beside, column[:, None]], axis=1)
        return Presence(self.rows, self.terms, self.count, self.width, beside)

    def times(self, w: np.ndarray) -> np.ndarray:
        own = np.bincount(self.rows, w[self.terms], minlength=self.count)
        return own + self.beside @ w[self.width : -1] + w[-1]

    def back(self, r: np.ndarray) -> np.ndarray:
        own = np.bincount(self.terms, r[self.rows], minlength=self.width)
        return np.concatenate([own, self.beside.T @ r, [r.sum()]])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(x: Presence, y: np.ndarray) -> np.ndarray | None:
    """Ridge logistic regression by Newton steps, each solved by conjugate gradients.

    The intercept is hardly shrunk. None where a category has no examples of both kinds.
    """
    if y.min(initial=1) == y.max(initial=0):
        return None
    shrink = np.full(x.width + x.beside.shape[1] + 1, RIDGE)
    shrink[-1] = 1e-6
    w = np.zeros(len(shrink))
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(STEPS):
        p = _sigmoid(x.times(w))
        curve = p * (1 - p)
        left = x.back(y - p) - shrink * w
        step, way = np.zeros(len(w)), left.copy()
        size = first = left @ left
        for _ in range(INNER):
            if size <= 1e-10 * first or size == 0:
                break
            bent = x.back(curve * x.times(way)) + shrink * way
            length = size / (way @ bent)
            step, left = step + length * way, left - length * bent
            size, before = left @ left, size
            way = left + size / before * way
        w += np.clip(step, -3, 3)
    return w


def _held(x: Presence, y: np.ndarray) -> np.ndarray:
    """Each document's probability from a model of the other folds; zero where there is none."""
    folds, out = np.arange(x.count) % FOLDS, np.zeros(x.count)
    for k in range(FOLDS):
        w = _fit(x.taken(folds != k), y[folds != k])
        if w is not None:
            out[folds == k] = _sigmoid(x.taken(folds == k).times(w))
    return out


def fit_chain(x: Presence, labels: dict[str, np.ndarray], words: list[str]) -> Chain:
    """A chain over ``labels`` in their order; ``x`` holds the presence of ``words``."""
    links, held, y = [], np.zeros(x.count), np.zeros(x.count)
    for category, y in labels.items():
        held = _held(x, y)
        links.append(Link(category, _fit(x, y)))
        x = x.extended(held)
    threshold = best_threshold(held, y)
    recall = float((held[y > 0] >= threshold).mean()) if y.any() else 0.0
    clean = float((held[y == 0] >= threshold).mean()) if not y.all() else 0.0
    return Chain(words, links, threshold, recall, clean)


def groups_of(x: Presence, y: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    """Labels of ``GROUPS`` groups of the documents in ``y`` that use the same terms, largest first.

    Documents are unit vectors of weighted terms. Each group starts from the document least like
    those that others started from.
    """
    toxic = x.taken(y > 0)
    dense = np.zeros((toxic.count, x.width))
    dense[toxic.rows, toxic.terms] = weights[toxic.terms]
    dense /= np.maximum(np.linalg.norm(dense, axis=1), 1e-12)[:, None]
    centres = dense[[int(dense.sum(axis=1).argmax())]] if toxic.count else dense
    while 0 < len(centres) < min(GROUPS, toxic.count):
        near = (dense @ centres.T).max(axis=1)
        near[~dense.any(axis=1)] = 2
        centres = np.concatenate([centres, dense[[int(near.argmin())]]])
    group = np.zeros(toxic.count, dtype=int)
    for _ in range(ROUNDS):
        if not len(centres):
            break
        group = (dense @ centres.T).argmax(axis=1)
        sums = np.stack([dense[group == g].sum(axis=0) for g in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
    order = np.argsort(-np.bincount(group, minlength=GROUPS), kind="stable")
    out = {}
    for k, g in enumerate(order):
        label = np.zeros(x.count)
        label[y > 0] = group == g
        out[f"kind_{k + 1}"] = label
    return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1, half way to the next lower probability.

    At least half of those at or above it must be in ``y``. Above 1, so that nothing is rejected, if
    no threshold holds that, as where labels are too few to learn from.
    """
    if not y.any():
        return 2.0
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    score = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(p[1:] < p[:-1], True)
    sure = last & (2 * hits >= np.arange(1, len(y) + 1))
    if not sure.any():
        return 2.0
    best = int(np.argmax(np.where(sure, score, -1)))
    return float((p[best] + (p[best + 1] if best + 1 < len(p) else 0)) / 2)


def chain_probabilities(chain: Chain, x: Presence) -> list[np.ndarray]:
    """A column for each category; zero where it had no examples of both kinds."""
    out = []
    for link in chain.links:
        none = link.weights is None
        out.append(np.zeros(x.count) if none else _sigmoid(x.times(link.weights)))
        x = x.extended(out[-1])
    return out


def terms_of(text: str | None) -> set[str]:
    """The distinct words of a text, and their stems, marked by a star."""
    words = {word.decode() for word in set(words_of(text))}
    return words | {f"{word[:STEM]}*" for word in words if len(word) > STEM}


def distinct_terms(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sorted(terms_of(x)) for x in texts])

    return cut(text)


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = LABEL,
    sample: int = SAMPLE,
) -> Chain:
    """A chain from the labelled documents, of which ``sample`` at most are taken by hash of key.

    A document with several labels counts as toxic if one says so; of several texts under one key
    the least is taken. Null keys and labels take no part. The terms are all that are in
    ``LEAST_DOCS`` documents of the sample and ``APART`` standard errors from chance; what reaches
    the driver is bounded by the sample.
    """
    wanted = (
        labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
        .dropna()
        .groupBy("key")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(sample)
    )
    found = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text")).join(
        F.broadcast(wanted), "key"
    )
    found = found.groupBy("key", "label").agg(F.min("text").alias("text"))
    found = cut_lineage(
        found.select("key", "label", distinct_terms(F.col("text")).alias("words")), "labelled"
    )
    total, toxic = found.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    clean = total - toxic
    names = [*[f"kind_{k + 1}" for k in range(GROUPS)], label]
    if not toxic or not clean:
        return Chain([], [Link(c, None) for c in names], 2.0)
    share, with_toxic = F.col("n") / F.lit(total), F.col("n_toxic") / F.lit(toxic)
    apart = with_toxic - (F.col("n") - F.col("n_toxic")) / F.lit(clean)
    spread = F.sqrt(share * (1 - share) * F.lit(1 / toxic + 1 / clean) + F.lit(1e-12))
    chosen = (
        found.select(F.explode("words").alias("word"), "label")
        .groupBy("word")
        .agg(F.count("*").alias("n"), F.sum("label").alias("n_toxic"))
        .filter(F.col("n") >= LEAST_DOCS)
        .select("word", (apart / spread).alias("apart"))
        .filter(F.abs("apart") >= APART)
        .orderBy("word")
    )
    chosen = [(r["word"], r["apart"]) for r in chosen.collect()]
    words, place = [w for w, _ in chosen], {w: k for k, (w, _) in enumerate(chosen)}
    session = docs.sparkSession
    listed = session.createDataFrame(list(place.items()), "word string, place int")
    used = found.select("key", F.explode("words").alias("word")).join(F.broadcast(listed), "word")
    used = used.groupBy("key").agg(F.sort_array(F.collect_list("place")).alias("places"))
    rows = found.select("key", "label").join(used, "key", "left")
    rows = rows.orderBy(F.xxhash64("key"), "key").collect()
    x = _presence([r["places"] or [] for r in rows], len(words))
    y = np.array([r["label"] for r in rows], dtype=float)
    groups = groups_of(x, y, np.maximum([a for _, a in chosen], 0.0))
    return fit_chain(x, {**groups, label: y}, words)


def _presence(places: list, width: int) -> Presence:
    counts = [len(p) for p in places]
    rows = np.repeat(np.arange(len(places)), counts)
    flat = np.fromiter((t for p in places for t in p), dtype=np.int64, count=sum(counts))
    return Presence(rows, flat, len(places), width)


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """``docs`` with ``chances`` (a number per category) and ``rejected``.

    Columns of those names are replaced. A null text scores like an empty one; a probability that
    equals the threshold rejects.
    """
    place = {word: k for k, word in enumerate(chain.words)}
    names = [link.category for link in chain.links]

    @F.pandas_udf(", ".join(f"`{name}` double" for name in names))
    def chances(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            places = [[place[w] for w in place.keys() & terms_of(t)] for t in texts]
            found = chain_probabilities(chain, _presence(places, len(place)))
            yield pd.DataFrame(dict(zip(names, found, strict=True)))

    scored = docs.withColumn("chances", chances(F.col(text)))
    return scored.withColumn("rejected", F.col("chances")[names[-1]] >= F.lit(chain.threshold))


def clean_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with the columns they came with."""
    chain = train(docs, labels, **options)
    text = options.get("text", "text")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    scored = score(docs.select(own, F.col(text).alias("text")), chain)
    return scored.filter(~F.col("rejected")).select("own.*")
