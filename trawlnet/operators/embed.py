"""Batched embedding with a pluggable model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlnet.functions.batches import once

Model = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def embed(
    df: DataFrame,
    make_model: Callable[[], Model],
    column: str = "chunk",
    batch_size: int = 8,
    output: str = "embedding",
) -> DataFrame:
    """Add one vector per row; the model sees up to ``batch_size`` texts per call.

    ``make_model`` runs once per task, so clients and weights are made on the executor.
    Only the text goes to Python; the other columns wait on the JVM side. Rows keep their
    order and place.
    """

    @once
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for texts in batches:
            rows: list[np.ndarray] = []
            for start in range(0, len(texts), batch_size):
                answer = model(texts.iloc[start : start + batch_size].tolist())
                rows.extend(np.asarray(v, dtype=np.float64) for v in answer)
            yield pd.Series(rows, dtype=object)

    return df.withColumn(output, vectors(F.col(column)))


class _Places(dict):
    """Token to its place among ``2 * dim``: the second half counts negatively."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        digest = hashlib.md5(token.encode("utf-8"), usedforsecurity=False).hexdigest()
        negative = int(digest[8], 16) >= 8
        place = self[token] = int(digest[:8], 16) % self.dim + self.dim * negative
        return place


def hashing_model(dim: int = 64) -> Callable[[], Model]:
    """A model that needs no service: signed feature hashing of lower-cased tokens.

    A token adds +1 or -1 to one of ``dim`` places, both read off its md5 digest; the
    vector is then scaled to length one. Blank text gives the zero vector.
    """

    def make() -> Model:
        places = _Places(dim)

        def vector(text: str | None) -> np.ndarray:
            codes = [places[token] for token in (text or "").lower().split()]
            counts = np.bincount(codes, minlength=2 * dim) if codes else np.zeros(2 * dim)
            total = (counts[:dim] - counts[dim:]).astype(np.float64)
            return total / (np.linalg.norm(total) or 1.0)

        return lambda texts: [vector(text) for text in texts]

    return make
