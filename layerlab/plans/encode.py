"""Batch job: text -> one vector per layer, with a pluggable encoder.

This is the one place where rows cross into Python, in Arrow batches; the
encoder is built once per task.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# texts -> array of shape (texts, layers, tokens, width)
Encoder = Callable[[list[str]], np.ndarray]


def encode_layers(
    df: DataFrame,
    make_encoder: Callable[[], Encoder],
    key: str = "sample_id",
    text: str = "text",
    pool: str = "first",
    batch_size: int = 16,
    partitions: int | None = None,
) -> DataFrame:
    """(key, layer, vec, seconds): pooled token vector per layer.

    `seconds` is the encoder time of the row's batch divided by its rows.
    Resuming is a filter or anti-join on `df` before the call
    (operators.tables.skip_done_batches). Set `partitions` to spread
    expensive encoders over more tasks than the input has.
    """
    at = 0 if pool == "first" else -1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start : start + batch_size]
                began = time.perf_counter()
                states = encoder(part["_text"].fillna("").tolist())[:, :, at, :]
                seconds = (time.perf_counter() - began) / len(part)
                rows, layers, _ = states.shape
                yield pd.DataFrame(
                    {
                        key: np.repeat(part[key].to_numpy(), layers),
                        "layer": np.tile(np.arange(layers, dtype=np.int32), rows),
                        "vec": list(states.reshape(rows * layers, -1).astype(np.float64)),
                        "seconds": seconds,
                    }
                )

    source = df.select(key, df[text].alias("_text"))
    if partitions:
        source = source.repartition(partitions, key)
    kind = dict(df.dtypes)[key]
    return source.mapInPandas(run, f"{key} {kind}, layer int, vec array<double>, seconds double")


class HashEncoder:
    """Deterministic stand-in for a model: features from the digest of the whole text."""

    def __init__(self, layers: int = 4, width: int = 8):
        self.layers, self.width = layers, width

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), self.layers, 2, self.width))
        for i, text in enumerate(texts):
            digest = hashlib.md5(text.encode("utf-8")).hexdigest()
            for layer in range(self.layers):
                for token in range(2):
                    for d in range(self.width):
                        feature = hashlib.md5(f"{layer}:{token}:{d}:{digest}".encode()).hexdigest()
                        out[i, layer, token, d] = int(feature[:8], 16) / 2.0**32
        return out
