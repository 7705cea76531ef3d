"""Text to vector: a registry of embedders that work on whole Arrow batches, with a deterministic stand-in for tests."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str], int], np.ndarray]


def byte_hash(texts: list[str], dim: int) -> np.ndarray:
    """Unit vectors from the bytes of a text; no meaning, but always the same: byte i adds its value less 96, in hundredths, to component i mod dim. NaN for an empty text, which is refused."""
    out = np.full((len(texts), dim), np.nan)
    for i, t in enumerate(texts):
        if t:
            b = np.frombuffer(t.encode(), np.uint8).astype(float)
            v = np.bincount(np.arange(len(b)) % dim, (b - 96) * 0.01, dim)
            size = np.linalg.norm(v)
            out[i] = v / size if size > 1e-8 else v
    return out


EMBEDDERS: dict[str, Embedder] = {"byte_hash": byte_hash}


def register(name: str, f: Embedder) -> None:
    """Makes an embedder known by name; it must be picklable, as it runs in the workers."""
    EMBEDDERS[name] = f


def embed(rows: DataFrame, text: str, dim: int, model: str = "byte_hash", out: str = "embedding") -> DataFrame:
    """rows with an embedding of a text column; null texts and texts that the embedder refuses (empty ones) have none."""
    f = EMBEDDERS[model]

    @F.pandas_udf("array<double>")
    def run(t: pd.Series) -> pd.Series:
        known = t.notna()
        res = pd.Series([None] * len(t), index=t.index, dtype=object)
        if known.any():
            res[known] = pd.Series([v if np.isfinite(v).all() else None for v in f(t[known].tolist(), dim)], index=t[known].index)
        return res

    return rows.withColumn(out, run(text))
