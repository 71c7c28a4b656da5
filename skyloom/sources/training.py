"""State of a training kept as tables, so that a run whose driver is lost is taken up at its last whole epoch.

A folder has ``epoch-000007`` for each of the last ``KEPT`` epochs: arrays in pieces of ``PIECE`` numbers
(name, piece, shape, values), and one row of settings and scalars as JSON.  A folder counts once its writer has
committed it, so an epoch that was being stored when the driver died is not seen.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

PIECE, KEPT = 1 << 17, 2
SCHEMA = "name string, piece int, shape array<int>, values array<double>, note string"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def whole(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    fs, where = _files(spark, f"{path}/_SUCCESS")
    return fs.exists(where)


def epochs(spark: SparkSession, folder: str) -> list[int]:
    """Epochs that are stored whole, in order."""
    fs, where = _files(spark, folder)
    if not fs.exists(where):
        return []
    names = [re.fullmatch(r"epoch-([0-9]{6})", f.getPath().getName()) for f in fs.listStatus(where)]
    return sorted(int(m[1]) for m in names if m and whole(spark, f"{folder}/{m[0]}"))


def store(spark: SparkSession, folder: str, epoch: int, arrays: dict[str, np.ndarray], note: dict) -> None:
    """Write an epoch, then delete those before the ``KEPT`` last ones."""
    rows = [("", 0, [], [], json.dumps(note))]
    for name, a in arrays.items():
        flat = np.asarray(a, dtype=float).ravel()
        rows += [(name, i, list(a.shape), flat[i * PIECE : (i + 1) * PIECE].tolist(), None) for i in range(max(1, -(-len(flat) // PIECE)))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/epoch-{epoch:06d}")
    for old in epochs(spark, folder)[:-KEPT]:
        fs, where = _files(spark, f"{folder}/epoch-{old:06d}")
        fs.delete(where, True)


def latest(spark: SparkSession, folder: str) -> tuple[int, dict[str, np.ndarray], dict] | None:
    """The last whole epoch with its arrays and note; None where there is none."""
    found = epochs(spark, folder)
    if not found:
        return None
    rows = spark.read.schema(SCHEMA).parquet(f"{folder}/epoch-{found[-1]:06d}").orderBy("name", "piece").collect()  # a model's weights
    pieces: dict[str, list] = {}
    for r in rows:
        if r["note"] is None:
            pieces.setdefault(r["name"], []).append(r)
    arrays = {name: np.concatenate([np.array(r["values"], dtype=float) for r in parts]).reshape(parts[0]["shape"]) for name, parts in pieces.items()}
    return found[-1], arrays, json.loads(next(r["note"] for r in rows if r["note"] is not None))


def once(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table that later runs find there."""
    spark = df.sparkSession
    if not whole(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
