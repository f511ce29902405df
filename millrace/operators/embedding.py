"""Embedding models as column makers: pooling, unit length, batches, packed vectors.

No weights are shipped. A caller passes ``load``, which each worker calls once; the model that it
returns takes a list of texts and gives (hidden states [texts, tokens, width], mask [texts, tokens]).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

Model = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
BATCH = 32


def pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit vectors: the mean over tokens that the mask marks as real. Texts without one give zeros."""
    real = np.asarray(mask, np.float32)
    sums = np.einsum("ntw,nt->nw", np.asarray(hidden, np.float32), real)
    means = sums / np.maximum(real.sum(1, keepdims=True), 1e-9)
    return means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)


def embedder(load: Callable[[], Model], batch: int = BATCH) -> Callable[[Column], Column]:
    """A maker of vector columns (array<float>) from text columns. Null counts as empty.

    Texts reach the model ``batch`` at a time, so its memory does not follow the Arrow batch.
    """

    @F.pandas_udf("array<float>")
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in frames:
            texts, out = texts.fillna("").tolist(), []
            for k in range(0, len(texts), batch):
                out += list(pooled(*model(texts[k : k + batch])))
            yield pd.Series(out, dtype=object)

    return run


def stored(passages, embed: Callable[[Column], Column], model: str):
    """passages with vec by this model and its name in ``model``, ready to be appended to a corpus."""
    return passages.withColumn("vec", embed(F.col("text"))).withColumn("model", F.lit(model))


@F.pandas_udf(T.BinaryType())
def packed_bytes(vectors: pd.Series) -> pd.Series:
    """Vectors as little-endian 32-bit floats; null stays null. corpus.unpacked() reads them."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())
