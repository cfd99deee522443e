"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

Each row of ``RULES`` bounds one count of a text by a share of another. ``compiled`` turns the table
into a column; nothing runs in Python, no text is shuffled, and no group of rows is ever formed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in a window that is looked for twice, fewest words, and repeated words in a hundred.
WINDOW, FEWEST, REPEATED = 8, 20, 30
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# Frequent words of the languages that the stop-word rule covers, by language code.
STOP_WORDS = {
    "en": "the of and to a in is that it on for was with as be this by are at from an".split(),
    "de": "der die und in den von zu das mit sich des für auf ist im nicht dem eine ein als".split(),
    "fr": "de la le et les des en un du une est que pour dans qui au sur par pas avec ou".split(),
    "es": "de la que el en y los se del las por un con no una para su es al lo".split(),
}
BULLETS = ("-", "*", "•")
ELLIPSES = ("...", "…")


class Rule(NamedTuple):
    """``low <= 1000 * part / whole <= high``, for texts of ``words`` words or more.

    A rule with ``languages`` leaves texts of other or unknown languages alone.
    """

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None
    words: int = 1
    languages: tuple[str, ...] = ()


RULES = (
    Rule("word_length", "word_chars", "n_words", 3_000, 12_000, FEWEST),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("stop_words", "n_stop_words", "n_words", 20, None, 50, tuple(STOP_WORDS)),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 500),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 900),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 300),
)


def _longs(array: Column) -> Column:
    return F.size(array).cast("long")


def _repeated_keys(pairs: Column) -> Column:
    """Of ``(key, at)`` structs in order, the ``at`` of those whose key a neighbour has too."""

    def met(pair, k):
        before = (k > 0) & (F.get(pairs, k - 1)["key"] == pair["key"])
        return before | F.coalesce(F.get(pairs, k + 1)["key"] == pair["key"], F.lit(False))

    return F.transform(F.filter(pairs, met), lambda pair: pair["at"])


def _covered(starts: Column, window: int) -> Column:
    """How many places windows from these ascending starts cover."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))

    def step(done, at):
        fresh = F.lit(window) - F.greatest(F.lit(0), done["upto"] - at)
        return F.struct((done["n"] + fresh).alias("n"), (at + F.lit(window)).alias("upto"))

    return F.aggregate(starts, start, step, lambda done: done["n"])


def measured(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` and one column ``measures`` of counts.

    A text's windows are told apart by hash first. Only if two hashes of a text agree are windows
    compared as words, and only those in question, so the count is exact and a text without
    repetition costs one hash a word. Sorting makes the work ``n log n`` in a text's words.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "measures"]
    row = F.struct(*kept).alias("row")
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(whole, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>"))
    words = words.otherwise(F.split(trimmed, "[ \t-\r]+", -1))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    cut = docs.select(row, whole.alias("whole"), words.alias("words"), lines.alias("lines"))

    hashed = cut.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    # Hashes of pairs, of pairs of pairs and so on; the last step may overlap.
    width = 1
    while width < window:
        ahead = min(width, window - width)
        left = F.greatest(F.lit(0), F.size("hashes") - ahead)
        joined = F.zip_with(
            F.slice("hashes", F.lit(1), left),
            F.slice("hashes", F.lit(1 + ahead), left),
            lambda a, b: F.xxhash64(a, b),
        )
        hashed = hashed.withColumn("hashes", joined)
        width += ahead
    # Distinct hashes are distinct windows, so most texts stop here.
    again = F.size(F.array_distinct("hashes")) < F.size("hashes")
    pairs = F.transform(
        F.when(again, F.col("hashes")),
        lambda h, k: F.struct(h.alias("key"), (k + 1).alias("at")),
    )
    likely = hashed.withColumn("pairs", F.sort_array(pairs)).drop("hashes")
    spelled = F.transform(
        _repeated_keys(F.col("pairs")),
        lambda at: F.struct(F.array_join(F.slice("words", at, window), " ").alias("key"), at.alias("at")),
    )
    spelled = likely.withColumn("spelled", F.sort_array(spelled)).drop("pairs")
    found = spelled.withColumn("starts", F.sort_array(_repeated_keys(F.col("spelled"))))

    stops = sorted({w for some in STOP_WORDS.values() for w in some})
    length = F.char_length("whole").cast("long")

    def without(characters):
        return F.char_length(F.translate("whole", characters, "")).cast("long")

    def starting(marks):
        return lambda x: F.btrim(x, F.lit(SPACES)).rlike(f"^[{''.join(marks)}]".replace("[-", "[\\-"))

    def ending(marks):
        bare = lambda x: F.btrim(x, F.lit(SPACES))
        return lambda x: F.endswith(bare(x), F.lit(marks[0])) | F.endswith(bare(x), F.lit(marks[1]))

    measures = {
        "n_words": _longs(F.col("words")),
        "word_chars": without(SPACES),
        "n_symbols": length - without(SYMBOLS),
        "n_lines": _longs(F.col("lines")),
        "n_dup_lines": _longs(F.col("lines")) - _longs(F.array_distinct("lines")),
        "n_bullet_lines": _longs(F.filter("lines", starting(BULLETS))),
        "n_ellipsis_lines": _longs(F.filter("lines", ending(ELLIPSES))),
        "n_stop_words": _longs(F.filter("words", lambda w: F.lower(w).isin(stops))),
        "n_repeat_words": F.coalesce(_covered(F.col("starts"), window), F.lit(0).cast("long")),
    }
    # As columns of their own first: fields of a struct would be worked out at each use.
    flat = found.select("row", *[c.alias(n) for n, c in measures.items()])
    return flat.select("row.*", F.struct(*measures).alias("measures"))


def compiled(rules: tuple[Rule, ...], measures: Column, language: Column) -> Column:
    """The names of the rules that a text breaks, as one expression."""

    def broken(rule: Rule) -> Column:
        part, whole = measures[rule.part] * 1000, measures[rule.whole]
        outside = F.lit(False)
        if rule.low is not None:
            outside = outside | (part < whole * rule.low)
        if rule.high is not None:
            outside = outside | (part > whole * rule.high)
        outside = outside & (measures["n_words"] >= rule.words)
        if rule.languages:
            outside = outside & F.coalesce(language.isin(*rule.languages), F.lit(False))
        return F.when(outside, F.lit(rule.name))

    return F.filter(F.array(*[broken(r) for r in rules]), lambda name: name.isNotNull())


def judged(
    docs: DataFrame,
    text: str = "text",
    language: str = "lang",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """``docs`` with ``measures``, ``base_failed``, ``broken_rules`` and ``kept``.

    A null or empty text has no words and fails the base. A null or unlisted language, or a table
    without that column, spares the text the stop-word rule. Rows are judged one by one: repeated
    rows and ties get equal answers, an empty table gives an empty one. Input columns named like the
    four results are replaced, all others stay.
    """
    known = F.col(language) if language in docs.columns else F.lit(None).cast("string")
    m = F.col("measures")
    failed = (m["n_words"] < FEWEST) | (m["n_repeat_words"] * 100 > m["n_words"] * REPEATED)
    out = measured(docs, text).withColumns(
        {"base_failed": failed, "broken_rules": compiled(rules, m, known)}
    )
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
