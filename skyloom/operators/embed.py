"""Model-backed embeddings as an Arrow map, and a model-free control."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embed(df: DataFrame, key: str, inputs: str, loader: Callable[[], Callable[[np.ndarray], np.ndarray]], width: int, batch: int = 256) -> DataFrame:
    """(key, embedding array<array<float>>) of windows ``inputs``; ``loader`` runs once per task and returns encode(batch x time [x 3]) -> batch x T x width.

    A null window gets a null embedding; rows keep their key, so nothing is put back by position.
    """

    def run(batches):
        encode = loader()
        for part in batches:
            ids, windows = part.column(key), part.column(inputs).to_pylist()
            out: list = [None] * len(windows)
            some = [i for i, w in enumerate(windows) if w is not None]
            for a in range(0, len(some), batch):
                got = encode(np.array([windows[i] for i in some[a : a + batch]], dtype=np.float32))
                if got.ndim != 3 or got.shape[0] != len(some[a : a + batch]) or got.shape[2] != width:
                    raise ValueError(f"the model returned shape {got.shape}; expected ({len(some[a : a + batch])}, T, {width})")
                for i, e in zip(some[a : a + batch], got):
                    out[i] = e.astype(np.float32).tolist()
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.list_(pa.list_(pa.float32())))], names=[key, "embedding"])

    kind = dict(df.dtypes)[key]
    return df.select(key, inputs).mapInArrow(run, f"{key} {kind}, embedding array<array<float>>")


def random_embedding(df: DataFrame, key: str, width: int, seed: int = 42) -> DataFrame:
    """``embedding`` of uniform numbers in [-1, 1) that depend on key, place and seed only: the first 32 bits of an md5."""
    bits = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), i.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double")
    return df.withColumn("embedding", F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: (bits(i) / float(1 << 31) - 1).cast("float")))


def shapes(df: DataFrame, column: str) -> DataFrame:
    """(t, d, n): how many rows have each nesting size."""
    return df.select(F.size(column).alias("t"), F.size(F.try_element_at(F.col(column), F.lit(1))).alias("d")).groupBy("t", "d").agg(F.count(F.lit(1)).alias("n"))
