"""Repetition inside a document by tokeniser fertility: rejection bands per script, then five-word runs for what is left.

Every text is measured with a public vocabulary: characters per token, share of tokens that are single bytes, and token
entropy, all over the whole text as it stands; and its words, lower-cased, alone: tokens per word and the entropy that
their tokens lack, log2(tokens) - entropy. If a share s of W words is repeated, each repeated word brings tokens that
stood there before, so of T tokens at most T - s W are distinct, and the lack is at least -log2(1 - s W / T). The fewer
tokens a word has, the larger that is; so the greatest number of tokens per word that any document of a script has
gives the script a band of the lack, and a document outside its script's band can't reach the share. Bands come from
all documents and reject without loss. Documents within their band are verified by runs of five words.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.tokens import TOKENIZERS, ship, shipped
from vectide.llm.words import WORD
from vectide.session import Scratch

RUN = 5
LEAST_WORDS = 6
SHARE = 0.3
AT_ONCE = 1_000_000  # characters of whole texts that are measured together
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
MEASURES = "id long, script string, n_words int, n_tokens int, chars_per_token double, byte_share double, token_entropy double, tokens_per_word double, lack double, screened boolean"


@lru_cache(maxsize=65536)
def _script(word: str) -> str:
    try:
        return unicodedata.name(word[0]).split(" ")[0].split("-")[0].lower()
    except ValueError:
        return "other"


def repeated_words(codes: np.ndarray, run: int = RUN) -> int:
    """Number of words that lie in a run of so many words that began earlier in the same document, too; runs may overlap."""
    n = len(codes)
    if n <= run:
        return 0
    code = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    one, width, have = code, code.max() + 1, 1
    while have < run:  # name each run by the name of its beginning and its next word
        code = np.unique(code[: n - have] * width + one[have:], return_inverse=True)[1].astype(np.int64)
        have += 1
    first = np.full(code.max() + 1, n, np.int64)
    np.minimum.at(first, code, np.arange(len(code)))
    again = np.flatnonzero(first[code] < np.arange(len(code)))
    if not len(again):
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + run, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _entropies(part: np.ndarray, kind: np.ndarray, weight: np.ndarray | None, n: int) -> np.ndarray:
    """For each of n parts the entropy of its kinds (numbers below 2**31), in bits; NaN for a part without any."""
    both, at = np.unique(part.astype(np.int64) << 31 | kind, return_inverse=True)
    seen, own = np.bincount(at, weight, len(both)), both >> 31
    total = np.bincount(own, seen, n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.log2(total) - np.bincount(own, seen * np.log2(seen), n) / total


class _Words:
    """Numbers of the words met so far, with their tokens and scripts."""

    def __init__(self, enc):
        self.enc, self.number = enc, {}
        self.flat, self.start = array("i"), array("q", [0])
        self.script, self.names = array("i"), {}

    def of(self, w: str) -> int:
        c = self.number.get(w)
        if c is None:
            c = self.number[w] = len(self.start) - 1
            self.flat.extend(self.enc.bpe.encode_ordinary(" " + w))
            self.start.append(len(self.flat))
            self.script.append(self.names.setdefault(_script(w), len(self.names)))
        return c


def _measure(vocabulary, share: float, last_is: str):
    """Measures of each row, and as last the share of repeated words (of every row, or of rows that their own bound leaves open), or the numbers of the words of rows left open."""
    def rows(ids: list, texts: list, ws: list[list[str]], known: _Words) -> pa.RecordBatch:
        n, raw, ends = len(ids), array("i"), []
        for t in texts:
            if t:
                known.enc.encode_into(t, raw)
            ends.append(len(raw))
        tokens, n_raw = np.array(raw, np.int64), np.diff(np.r_[0, ends]).astype(np.int64)
        doc = np.repeat(np.arange(n), n_raw)
        none = n_raw == 0
        byte = np.bincount(doc, tokens < 256, n)
        raw_entropy = _entropies(doc, tokens, None, n)
        n_words = np.array([len(w) for w in ws], np.int64)
        codes = np.fromiter((known.of(w) for x in ws for w in x), np.int64, int(n_words.sum()))
        wdoc = np.repeat(np.arange(n), n_words)
        both, own, counts = np.unique(wdoc << 31 | codes, return_inverse=True, return_counts=True)
        udoc, ucode = both >> 31, both & (1 << 31) - 1
        start = np.frombuffer(known.start, np.int64)
        sizes = np.diff(start)[ucode]
        total = np.bincount(udoc, sizes * counts, n)
        take = np.repeat(start[ucode] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(int(sizes.sum()))
        flat = np.frombuffer(known.flat, np.int32) if len(known.flat) else np.zeros(0, np.int32)
        with np.errstate(divide="ignore", invalid="ignore"):
            lack = np.log2(total) - _entropies(np.repeat(udoc, sizes), flat[take].astype(np.int64), np.repeat(counts, sizes), n)
            per_word = total / n_words
        names = sorted(known.names, key=known.names.get)
        rank = np.argsort(np.argsort(names)) if names else np.zeros(0, np.int64)
        votes = np.bincount(udoc * max(len(names), 1) + (np.array(known.script, np.int64)[ucode] if len(ucode) else ucode), counts, n * max(len(names), 1)).reshape(n, -1)
        winner = np.lexsort((np.broadcast_to(rank, votes.shape), votes), axis=1)[:, -1] if names else np.zeros(n, np.int64)
        screened = (n_words < LEAST_WORDS) | ~(lack >= least_lack(share, np.maximum(per_word, share)) - 1e-9)
        first = np.searchsorted(udoc, np.arange(n))
        edge = np.r_[0, np.cumsum(n_words)]
        last = []
        for i in range(n):
            mine = slice(edge[i], edge[i + 1])
            if not n_words[i]:
                last.append(None if last_is == "codes" else 0.0)
            elif screened[i] and last_is != "every":
                last.append(None)
            elif last_is == "codes":
                last.append((own[mine] - first[i]).astype(np.int32))
            else:
                last.append(repeated_words(codes[mine]) / n_words[i])
        some = n_words > 0
        null = lambda v, ok: pa.array(v.astype(float), pa.float64(), mask=~ok)
        chars = np.array([len(t) if t else 0 for t in texts], float)
        cols = [
            pa.array(ids, pa.int64()), pa.array([names[k] if ok else None for k, ok in zip(winner, some)], pa.string()), pa.array(n_words.astype(np.int32)), pa.array(n_raw.astype(np.int32)),
            null(chars / np.maximum(n_raw, 1), ~none), null(byte / np.maximum(n_raw, 1), ~none), null(raw_entropy, ~none), null(per_word, some), null(lack, some), pa.array(screened | ~some),
            pa.array(last, pa.list_(pa.int32()) if last_is == "codes" else pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(cols, [*(x.split()[0] for x in MEASURES.split(", ")), "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(shipped(vocabulary.value))
        for batch in batches:
            if len(known.number) > 400_000:
                known = _Words(known.enc)
            ids, texts, ws, held = [], [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids.append(i), texts.append(text), ws.append(WORD.findall(text.lower()) if text else [])
                held += len(text or "")
                if held > AT_ONCE:
                    yield rows(ids, texts, ws, known)
                    ids, texts, ws, held = [], [], [], 0
            if ids:
                yield rows(ids, texts, ws, known)

    return run


def least_lack(share, tokens_per_word):
    """Bits of entropy that a text's tokens lack at least if such a share of its words is repeated."""
    return -np.log2(np.maximum(1 - share / tokens_per_word, 1e-300))


def measure_repetition(docs: DataFrame, id_col: str, text_col: str, share: float = SHARE, vocabulary: str = VOCABULARY, every: bool = True) -> DataFrame:
    """Per input row: script (of most of its words), n_words, n_tokens, chars_per_token, byte_share (of tokens that are single bytes), token_entropy (bits), tokens_per_word, lack (bits), screened, repeated_share.

    screened rows can't have the asked share of repeated words, or have under six words; their repeated_share is measured
    like any other, or null if not every share is wanted. Texts without words have null measures of words and a share of 0; null and
    empty texts have 0 tokens and null measures. Whole texts are read, however long; no row is shuffled. Other columns
    are ignored.
    """
    read = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return read.mapInArrow(_measure(ship(docs, vocabulary), share, "every" if every else "open"), f"{MEASURES}, last double").withColumnsRenamed({"id": id_col, "last": "repeated_share"})


def rejection_bands(measured: DataFrame, share: float = SHARE) -> DataFrame:
    """script, least_lack: the band of each script, from its greatest number of tokens per word; one row for each of the scripts there are, under 200."""
    return measured.where("n_words > 0").groupBy("script").agg(F.max("tokens_per_word").alias("most")).select("script", (-F.log2(F.greatest(1 - share / F.col("most"), F.lit(1e-300)))).alias("least_lack"))


def repeating(docs: DataFrame, id_col: str, text_col: str, share: float = SHARE, vocabulary: str = VOCABULARY) -> DataFrame:
    """id_col and repeated_share of the rows of LEAST_WORDS words or more of which at least such a share is repeated.

    Bands per script reject, runs of five words decide about the rest, which travels as numbers of its words.
    """
    read = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    measured = Scratch(docs.sparkSession, "repetition").write(read.mapInArrow(_measure(ship(docs, vocabulary), share, "codes"), f"{MEASURES}, last array<int>"))
    bands = F.broadcast(rejection_bands(measured, share))
    left = measured.where((F.col("n_words") >= LEAST_WORDS) & F.col("last").isNotNull()).join(bands, "script").where("lack >= least_lack - 1e-9")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = [repeated_words(np.asarray(x.values)) / len(x.values) for x in batch.column(1)]
            keep = np.flatnonzero(np.array(shares, float) >= share - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(np.array(shares, float)[keep])], ["id", "repeated_share"])

    return left.select("id", "last").mapInArrow(verify, "id long, repeated_share double").withColumnRenamed("id", id_col)


def fertility_bands(measured: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Per script, over all documents: how many, and the band between two quantiles of each fertility measure.

    A document outside its script's band is suspect in another way than repetition (wrong encoding, noise).
    Quantiles are mergeable sketches (percentile_approx), so a script that holds most rows is no hot group.
    """
    q = lambda c, p: F.percentile_approx(c, p, 10000)
    return measured.where("n_words > 0").groupBy("script").agg(
        F.count(F.lit(1)).alias("n_docs"), *(q(c, p).alias(f"{c}_{n}") for c in ("chars_per_token", "byte_share", "token_entropy", "tokens_per_word", "lack") for n, p in (("low", low), ("high", high)))
    )


def outside_bands(measured: DataFrame, id_col: str) -> DataFrame:
    """id_col, script and, for each fertility measure, whether the row lies outside its script's band; rows outside of one at least."""
    kinds = ("chars_per_token", "byte_share", "token_entropy", "lack")
    m = measured.where("n_words > 0").join(F.broadcast(fertility_bands(measured)), "script")
    out = [((F.col(c) < F.col(f"{c}_low")) | (F.col(c) > F.col(f"{c}_high"))).alias(f"{c}_out") for c in kinds]
    return m.select(id_col, "script", *out).where(" or ".join(f"{c}_out" for c in kinds))
