"""Section extraction from plain text, and chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.constants import (
    FOOTNOTES_PATTERN,
    NO_BODY_MESSAGE,
    NO_TEXT_MESSAGE,
    NOTE_PATTERN,
    PARAGRAPH_CHUNK,
    SECTION_PATTERNS,
    SEGMENT_PATTERN,
    WINDOW_OVERLAP,
    WINDOW_SIZE,
)
from factloom.functions.text import is_blank, let, present, slug, strip
from factloom.sources.html import visible_text

# Dot matches all, case is ignored, white space includes the no-break space, and only \n ends a line.
_FLAGS = "(?isUd)"


def _span(text: Column, pattern: str) -> Column:
    """From the first heading to the nearest end marker after it; null when absent."""
    return F.nullif(F.regexp_extract(text, _FLAGS + pattern, 0), F.lit(""))


def _entry(section: Column, name: Column, content: Column) -> Column:
    return F.struct(
        section.alias("section"), name.alias("section_name"), content.alias("content")
    )


def _known(text: Column, specs) -> Column:
    entries = [_entry(F.lit(i), F.lit(n), _span(text, p)) for i, p, n in specs]
    return F.filter(F.array(*entries), lambda s: s["content"].isNotNull())


def notes_of(footnotes: Column) -> Column:
    """Single notes of a footnote block as ``id, title, content``.

    Notes keep the place where their id came up first and the text that came
    up last.
    """
    titles = F.regexp_extract_all(footnotes, F.lit(_FLAGS + NOTE_PATTERN), F.lit(1))
    texts = F.regexp_extract_all(footnotes, F.lit(_FLAGS + NOTE_PATTERN), F.lit(2))
    found = F.transform(
        F.arrays_zip(titles.alias("title"), texts.alias("content")),
        lambda n: F.struct(
            slug(strip(n["title"])).alias("id"),
            strip(n["title"]).alias("title"),
            strip(n["content"]).alias("content"),
        ),
    )

    def last_of_each(notes: Column) -> Column:
        ids = F.array_distinct(F.transform(notes, lambda n: n["id"]))
        return F.transform(
            ids, lambda i: F.element_at(F.filter(notes, lambda n: n["id"] == i), F.lit(-1))
        )

    return let(found, last_of_each)


def sections_of(text: Column, footnotes: bool = False, segments: bool = False) -> Column:
    """Array of ``section, section_name, content`` in a fixed order, absent ones left out."""
    specs = list(SECTION_PATTERNS)
    if footnotes:
        specs.append(FOOTNOTES_PATTERN)
    if segments:
        specs.append(SEGMENT_PATTERN)
    return _known(text, specs)


def footnotes_of(text: Column) -> Column:
    return _span(text, FOOTNOTES_PATTERN[1])


def extract_sections(
    texts: DataFrame,
    text: str = "text",
    footnotes: bool = False,
    segments: bool = False,
) -> DataFrame:
    """Named sections of each text, one row each: ``section_pos, section, section_name, content``.

    All patterns run in one pass over the text column; nothing is shuffled.
    """
    keep = [c for c in texts.columns if c != text]
    found = sections_of(F.col(text), footnotes, segments)
    return texts.select(*keep, F.posexplode(found).alias("section_pos", "__s")).select(
        *keep, "section_pos", "__s.*"
    )


def extract_notes(texts: DataFrame, text: str = "text") -> DataFrame:
    """Single notes inside the footnote block: ``note_pos, note_id, title, content``."""
    keep = [c for c in texts.columns if c != text]
    blocks = texts.select(*keep, footnotes_of(F.col(text)).alias("__block")).filter(
        F.col("__block").isNotNull()
    )
    return blocks.select(
        *keep, F.posexplode(notes_of(F.col("__block"))).alias("note_pos", "__n")
    ).select(*keep, "note_pos", F.col("__n.id").alias("note_id"), "__n.title", "__n.content")


#: Paragraphs that are packed at once.
PACKED = 512


def _chunk_starts(sizes: Column, max_size: int) -> Column:
    """Numbers of the paragraphs that open a chunk after the first one, from the paragraph sizes.

    Blocks of paragraphs are packed one after the other. What is carried from block to block is the
    size of the open chunk, so the work grows with the number of paragraphs.
    """
    none = F.array().cast("array<int>")

    def add(state: Column, size: Column) -> Column:
        closes = (state["size"] + size > max_size) & (state["size"] > 0)
        return F.struct(
            (F.when(closes, F.lit(0)).otherwise(state["size"]) + size + 2).alias("size"),
            (state["at"] + 1).alias("at"),
            F.when(closes, F.array_append(state["starts"], state["at"]))
            .otherwise(state["starts"])
            .alias("starts"),
        )

    def pack(state: Column, k: Column) -> Column:
        begin = F.struct(state["size"].alias("size"), (k * PACKED).alias("at"), none.alias("starts"))
        inner = F.aggregate(F.slice(sizes, k * PACKED + 1, PACKED), begin, add)
        return let(
            inner,
            lambda done: F.struct(
                done["size"].alias("size"),
                F.array_append(state["blocks"], done["starts"]).alias("blocks"),
            ),
        )

    begin = F.struct(F.lit(0).alias("size"), F.array().cast("array<array<int>>").alias("blocks"))
    last = F.greatest(F.lit(0), F.ceil(F.size(sizes) / PACKED).cast("int") - 1)
    whole = F.aggregate(F.sequence(F.lit(0), last), begin, pack, lambda state: state["blocks"])
    return F.flatten(whole)


def pack_paragraphs(text: Column, max_size: int = PARAGRAPH_CHUNK) -> Column:
    """Array of chunks: paragraphs packed greedily up to ``max_size`` characters.

    A chunk closes when the next paragraph would pass the limit; a paragraph is
    never cut. Each one counts two more characters for the blank line after it.
    """
    paragraphs = F.filter(F.split(text, "\n\n"), lambda p: ~is_blank(p))

    def chunks(parts: Column) -> Column:
        count = F.size(parts)
        starts = let(
            F.transform(parts, lambda p: F.length(p)), lambda sizes: _chunk_starts(sizes, max_size)
        )

        def cut(later: Column) -> Column:
            return F.zip_with(
                F.concat(F.array(F.lit(0)), later),
                F.array_append(later, count),
                lambda a, b: strip(F.array_join(F.slice(parts, a + 1, b - a), "\n\n")),
            )

        return F.when(count > 0, let(starts, cut)).otherwise(F.array().cast("array<string>"))

    return F.when(text.isNotNull(), let(paragraphs, chunks))


def chunk_rows(section: Column, max_size: int = PARAGRAPH_CHUNK) -> Column:
    """Array of ``chunk_pos, text, section, section_name`` for one section struct."""

    def rows(chunks: Column) -> Column:
        several = F.size(chunks) > 1

        def row(text: Column, i: Column) -> Column:
            number = (i + 1).cast("string")
            numbered = F.concat(section["section"], F.lit("_part_"), number)
            titled = F.concat(section["section_name"], F.lit(" (Part "), number, F.lit(")"))
            return F.struct(
                i.alias("chunk_pos"),
                text.alias("text"),
                F.when(several, numbered).otherwise(section["section"]).alias("section"),
                F.when(several, titled).otherwise(section["section_name"]).alias("section_name"),
            )

        return F.transform(chunks, row)

    return let(pack_paragraphs(section["content"], max_size), rows)


def chunk_sections(sections: DataFrame, max_size: int = PARAGRAPH_CHUNK) -> DataFrame:
    """Chunks of ``section, section_name, content`` rows, numbered when there are several."""
    named = ("section", "section_name", "content")
    keep = [c for c in sections.columns if c not in named]
    whole = F.struct(*named)
    return sections.select(*keep, F.inline(chunk_rows(whole, max_size)))


def windows_of(text: Column, size: int = WINDOW_SIZE, overlap: int = WINDOW_OVERLAP) -> Column:
    """Array of windows of ``size`` characters, each starting ``size - overlap`` after the last.

    The text is first cut into blocks as long as the step, in one linear pass;
    a window is a block and as much of the following ones as the overlap needs.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the window")
    following = -(-overlap // step)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))

    def joined(parts: Column) -> Column:
        return F.transform(
            parts,
            lambda b, i: F.left(
                F.array_join(F.slice(parts, i + 1, F.lit(following + 1)), ""), F.lit(size)
            ),
        )

    return let(blocks, joined)


def window_chunks(
    documents: DataFrame,
    text: str = "text",
    size: int = WINDOW_SIZE,
    overlap: int = WINDOW_OVERLAP,
) -> DataFrame:
    """One row per window: ``chunk_no`` from 1 and ``chunk``."""
    keep = [c for c in documents.columns if c != text]
    return documents.select(
        *keep, F.posexplode(windows_of(F.col(text), size, overlap)).alias("__i", "chunk")
    ).select(*keep, (F.col("__i") + 1).alias("chunk_no"), "chunk")


def submission_body(text: Column) -> Column:
    """Plain text of the 10-K inside a full submission, or a fixed message."""

    def body(part: Column) -> Column:
        opened, closed = F.instr(part, "<TEXT>"), F.instr(part, "</TEXT>")
        inside = F.substring(part, opened + 6, closed - opened - 6)
        usable = part.contains("<TYPE>10-K") & (opened > 0) & (closed > opened)
        return F.when(usable, inside)

    bodies = F.filter(F.transform(F.split(text, "<DOCUMENT>"), body), lambda b: b.isNotNull())
    first = F.get(bodies, F.lit(0))
    return (
        F.when(~F.coalesce(present(text), F.lit(False)), F.lit(NO_TEXT_MESSAGE))
        .when(first.isNull(), F.lit(NO_BODY_MESSAGE))
        .otherwise(visible_text(first))
    )
