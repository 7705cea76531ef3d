"""Encoding a corpus with a public byte-level BPE vocabulary by forced boundaries.

A pair of bytes that stands side by side in no token of the vocabulary can't be merged, so a text may be cut
between them and its parts encoded apart. Texts are first cut where the pre-tokeniser, too, is sure to begin a new
piece: between a character that is no white space and ASCII white space. Parts repeat a lot, so each worker keeps
those it has met. A long part, say of a script without spaces or of coded data, is split into the pre-tokeniser's
pieces, and each piece is cut at every forced pair of bytes; so no merge runs over a long string. Encoding is then
mostly a table lookup, and no text is shuffled. The vocabulary is read on the driver and travels with the tasks.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
# fixed values: the published splitting pattern of this vocabulary
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_SPACE = " \t\n\r\x0b\x0c"
KEPT_PARTS = 400_000
LONG = 64  # characters; longer parts are not kept but cut further


def read_ranks(vocabulary: str | bytes) -> dict[bytes, int]:
    """From a file's place or its content."""
    if isinstance(vocabulary, str):
        with open(vocabulary, "rb") as f:
            vocabulary = f.read()
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}


def inner_pairs(tokens) -> np.ndarray:
    """256 x 256 truth table: which pairs of bytes stand side by side inside a token."""
    seen = np.zeros((256, 256), bool)
    for t in tokens:
        if len(t) > 1:
            b = np.frombuffer(t, np.uint8)
            seen[b[:-1], b[1:]] = True
    return seen


class Encoder:
    """Encodes texts to ids without special tokens; look-alikes of those are ordinary text."""

    def __init__(self, vocabulary: str | bytes):
        import tiktoken

        ranks = self.ranks = read_ranks(vocabulary)
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        inner = self.inner = inner_pairs(ranks)
        self.pieces = regex.compile(PATTERN)
        space = [ord(c) for c in ASCII_SPACE]
        free = ~inner[:, space].any(axis=1)  # bytes after which a cut before any ASCII space is certain
        bad = [c for c in range(256) if not free[c] and chr(c) not in ASCII_SPACE]
        if any(c < 0x80 for c in bad):
            raise ValueError("the vocabulary has tokens that hold a letter before white space")
        self.held = frozenset(bad)  # last bytes of wide characters after which no cut is certain
        odd = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in ASCII_SPACE)
        self.odd = re.compile(f"[{odd}]")
        self.wide = re.compile(f"[^\\x00-\\x7f](?=[{ASCII_SPACE}])")
        self.cut = re.compile(rf"(?<=\S)(?=[{ASCII_SPACE}])")
        self.plain = re.compile(r"\s*\S+|\s+")
        self.kept: dict[str, array] = {}

    def parts(self, text: str) -> list[str]:
        """The text in parts that encode independently of each other."""
        held = self.held
        if not self.odd.search(text) and (text.isascii() or not any(c.encode()[-1] in held for c in self.wide.findall(text))):
            return self.plain.findall(text)
        at = [m.start() for m in self.cut.finditer(text) if text[m.start() - 1].encode()[-1] not in held]
        return [text[i:j] for i, j in zip([0, *at], [*at, len(text)])]

    def fragments(self, piece: bytes) -> list[bytes]:
        """A piece of the pre-tokeniser, cut between any two bytes that stand side by side in no token."""
        b = np.frombuffer(piece, np.uint8)
        at = (np.flatnonzero(~self.inner[b[:-1], b[1:]]) + 1).tolist()
        return [piece[i:j] for i, j in zip([0, *at], [*at, len(piece)])]

    def long_part(self, part: str) -> array:
        ids, whole, merge = array("i"), self.ranks.get, self.bpe._encode_single_piece
        for piece in self.pieces.findall(part):
            for f in self.fragments(piece.encode()):
                known = whole(f)
                if known is None:
                    ids.extend(merge(f))
                else:
                    ids.append(known)
        return ids

    def encode_into(self, text: str, out: array) -> None:
        kept = self.kept
        if len(kept) > KEPT_PARTS:
            kept.clear()
        get, extend = kept.get, out.extend
        for part in self.parts(text):
            ids = get(part)
            if ids is None:
                if len(part) > LONG:
                    ids = self.long_part(part)
                else:
                    ids = kept[part] = array("i", self.bpe.encode_ordinary(part))
            extend(ids)

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        if text:
            self.encode_into(text, out)
        return list(out)


_ENCODERS: dict[bytes, Encoder] = {}


def shipped(vocabulary: bytes) -> Encoder:
    """One per worker process and vocabulary."""
    key = md5(vocabulary).digest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def ship(df: DataFrame, path: str):
    """A vocabulary's content (under 1 MB), read here and broadcast."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _batches(vocabulary, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shipped(vocabulary.value)
        for batch in batches:
            ids, ends = array("i"), np.zeros(batch.num_rows + 1, np.int32)
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                if text:
                    enc.encode_into(text, ids)
                ends[i + 1] = len(ids)
            if counts:
                value = pa.array(np.diff(ends).astype(np.int64))
            else:
                value = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), value], ["id", "v"])

    return run


def encode_corpus(docs: DataFrame, id_col: str, text_col: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per input row: id_col and ids, the token ids of the whole text without special tokens.

    A null text and an empty text both give an empty list, never null; a blank text is encoded as it stands.
    Repeated ids and rows come out as often as they go in, an empty table gives no row, other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(_batches(ship(docs, vocabulary), False), f"id {kind}, v array<int>").toDF(id_col, "ids")


def count_tokens(docs: DataFrame, id_col: str, text_col: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per input row: id_col and n_tokens; 0 for null and empty texts."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(_batches(ship(docs, vocabulary), True), f"id {kind}, v long").toDF(id_col, "n_tokens")
