"""Small tables and reference algorithms for the tests of this folder."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, first=0):
    rows = [(first + k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def invented(count, seed=1, low=5, high=60):
    """Texts of invented words."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeilnorst", k=rng.randint(2, 7))) for _ in range(400)]
    return [
        " ".join(rng.choices(words, k=rng.randint(low, high))).capitalize() for _ in range(count)
    ]


def classes_of(nodes, links):
    """The least member of each node's class."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
