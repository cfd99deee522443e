"""Byte-level BPE by a sentencepiece model that is written from a rank file.

The model is not trained: every entry of the rank file becomes one piece, its bytes mapped to 256
letters, its score the negative rank, its id the rank. Normalisation is the identity. Merging the
pair of the best score, the leftmost first, is then what a rank tokenizer does. Pre-tokens are cut
by a pattern first; a pre-token that is a whole entry takes its id, all others are encoded by the
model. Decoding maps ids to pieces and letters back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import pieces

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Byte b is the letter of code point FIRST_LETTER + b.
FIRST_LETTER = 0x100
LETTERS = {byte: chr(FIRST_LETTER + byte) for byte in range(256)}
#: Pre-tokens that a worker remembers, twice so many at most, and the longest of them.
REMEMBERED, LONGEST_REMEMBERED = 100_000, 32
#: Characters of short texts, or pre-tokens of a long one, that are worked on at once.
BLOCK = 1 << 18
#: Field numbers of sentencepiece's public model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
UNKNOWN_KIND, BPE_KIND = 2, 2


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes(out + bytes([value]))


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def read_ranks(path: str) -> list[bytes]:
    """Entries in the order of their ranks, which must be 0, 1, 2 and so on."""
    with open(path, "rb") as lines:
        entries = {int(rank): base64.b64decode(entry) for entry, rank in map(bytes.split, lines)}
    if sorted(entries) != list(range(len(entries))):
        raise ValueError(f"ranks of {path} have gaps")
    return [entries[rank] for rank in range(len(entries))]


def letters(entry: bytes) -> str:
    return entry.decode("latin-1").translate(LETTERS)


def serialised_model(entries: list[bytes]) -> bytes:
    """The bytes of a sentencepiece BPE model; the id after the last rank is its unknown piece."""
    out = []
    for rank, entry in enumerate(entries):
        score = b"\x15" + struct.pack("<f", -float(rank))
        out.append(_block(PIECES, _block(1, letters(entry).encode()) + score))
    out.append(_block(PIECES, _block(1, b"<unk>") + _number(3, UNKNOWN_KIND)))
    out.append(_block(TRAINER, _number(3, BPE_KIND) + _number(4, len(entries) + 1)))
    plain = _number(3, 0) + _number(4, 0) + _number(5, 0)
    out.append(_block(NORMALIZER, _block(1, b"identity") + plain))
    return b"".join(out)


class BytePairEncoder:
    """Encoder and decoder of one vocabulary; ids travel as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, pattern: str):
        self.entries = read_ranks(path)
        self.whole = {
            entry: struct.pack("<I", rank) for rank, entry in enumerate(self.entries)
        }
        self.model = sentencepiece.SentencePieceProcessor(
            model_proto=serialised_model(self.entries)
        )
        #: The inverse mapping, taken from the model's own pieces.
        self.back = [
            bytes(ord(letter) - FIRST_LETTER for letter in self.model.id_to_piece(rank))
            for rank in range(len(self.entries))
        ]
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _merged(self, mapped: list[str]) -> list[list[int]]:
        # The library would else start threads for every call.
        return self.model.encode(mapped, out_type=int, num_threads=1) if mapped else []

    def _fill(self, parts: set[str]) -> dict[str, bytes]:
        """Ids of pre-tokens that are not remembered."""
        found, other = {}, []
        for part in parts:
            ids = self.whole.get(part.encode())
            if ids is None:
                other.append(part)
            else:
                found[part] = ids
        mapped = [letters(part.encode()) for part in other]
        for part, ids in zip(other, self._merged(mapped), strict=True):
            found[part] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def _ids(self, lists: list[list[str]]) -> list[bytes]:
        """Ids of several lists of pre-tokens; what none of them has met is encoded at once."""
        known = self.known
        missing = {part for parts in lists for part in parts if part not in known}
        if missing:
            found = {part: self.older[part] for part in missing if part in self.older}
            known.update(found)
            known.update(self._fill(missing - found.keys()))
        out = [b"".join([known[part] for part in parts]) for parts in lists]
        for part in missing:
            if len(part) > LONGEST_REMEMBERED:
                del known[part]
        if len(known) >= REMEMBERED:
            # What was not met since the last turn is forgotten at this one.
            self.older, self.known = known, {}
        return out

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text; nothing for a null or empty one. Texts are worked on in blocks."""
        split, lists, size = self.pattern.findall, [], 0
        for text in texts:
            if text and len(text) > BLOCK:
                yield from self._ids(lists)
                lists, size = [], 0
                matches = (match.group() for match in self.pattern.finditer(text))
                yield b"".join(self._ids([part])[0] for part in pieces(matches, BLOCK))
                continue
            lists.append(split(text) if text else [])
            size += len(text or "")
            if size >= BLOCK:
                yield from self._ids(lists)
                lists, size = [], 0
        yield from self._ids(lists)

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes | None) -> bytes:
        back = self.back
        return b"".join([back[i] for i in np.frombuffer(ids or b"", dtype="<u4").tolist()])


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> BytePairEncoder:
    """One encoder per worker and vocabulary."""
    return BytePairEncoder(path, pattern)


def vocabulary_path(vocabulary: str) -> str:
    """A name of the public vocabulary files, or a path."""
    return vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)


def encoded(text: Column, vocabulary: str = VOCABULARY, pattern: str | None = None) -> Column:
    """Ids as little-endian unsigned 32-bit integers; empty for null."""
    pattern = pattern or public_tokenizers.PATTERN

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(vocabulary_path(vocabulary), pattern)
        for texts in batches:
            yield pd.Series(list(own.encode_all(texts)), dtype=object)

    return encode(text)


def decoded(ids: Column, vocabulary: str = VOCABULARY, pattern: str | None = None) -> Column:
    """The bytes that ids stand for; empty for null."""
    pattern = pattern or public_tokenizers.PATTERN

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(vocabulary_path(vocabulary), pattern)
        for part in batches:
            yield pd.Series([own.decode(x) for x in part], dtype=object)

    return decode(ids)


def coded(text: Column, vocabulary: str = VOCABULARY, pattern: str | None = None) -> Column:
    """``ids, decoded``: ids of a text and the bytes they stand for, both made by one worker."""
    pattern = pattern or public_tokenizers.PATTERN

    @F.pandas_udf("ids binary, decoded binary")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(vocabulary_path(vocabulary), pattern)
        for texts in batches:
            ids = list(own.encode_all(texts))
            yield pd.DataFrame(
                {"ids": ids, "decoded": [own.decode(x) for x in ids]}, dtype=object
            )

    return code(text)


def encode_documents(
    docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, pattern: str | None = None
) -> DataFrame:
    """The rows of ``docs`` with ``ids`` and ``decoded`` in place of columns of those names.

    Nulls and empty texts have no ids. Rows are encoded on their own, so repeated rows repeat their
    ids, and an empty table stays empty. Texts of any length are cut in blocks of pre-tokens.
    """
    both = coded(F.col(text), vocabulary, pattern)
    return docs.withColumns({"ids": both["ids"], "decoded": both["decoded"]})


def digests(encoded_docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of encoded documents."""
    return encoded_docs.select(
        key,
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
