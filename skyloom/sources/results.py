"""Readers of experiment results: run names, logs and report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder of a file; of one of Spark's partition folders its value.
PARENT = r"([^/=]+)/[^/]+$"
RUN = r"^(.+?)_(test|all)_(?:c([01])|(concat|avg|[a-z]))_std([01])_p([0-9.]+)_seed([0-9]+)$"


def embedding_name(run: Column) -> Column:
    """A linear run's directory without scenario and seed."""
    return F.regexp_replace(run, r"_concat_seed[0-9]+$", "")


def run_fields(run: Column) -> dict[str, Column]:
    """Fields of a clustering run's name, in the older form (c0/c1) and the one with the scenario's name."""
    part = lambda i: F.regexp_extract(run, RUN, i)
    scenario = F.when(part(3) == "1", "concat").when(part(3) == "0", "avg").otherwise(F.nullif(part(4), F.lit("")))
    return {
        "embedding": F.nullif(part(1), F.lit("")),
        "mode": F.nullif(part(2), F.lit("")),
        "scenario": scenario,
        "standardize": F.nullif(part(5), F.lit("")).cast("int"),
        "perplexity": F.nullif(part(6), F.lit("")).cast("double"),
        "seed": F.nullif(part(7), F.lit("")).cast("int"),
    }


def clustering_logs(spark: SparkSession, glob: str) -> DataFrame:
    """(run, split, method, ari, nmi, f1) of every result line in the logs."""
    number = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    pattern = rf"(\w+)\s*(?:→|->)\s*(K-Means|Ward)\s+ARI={number},\s*NMI={number},\s*F1={number}"
    raw = spark.read.text(glob).select("value", F.regexp_extract(F.col("_metadata.file_path"), PARENT, 1).alias("run")).filter(F.col("value").rlike(pattern))
    part = lambda i: F.regexp_extract("value", pattern, i)
    return raw.select("run", part(1).alias("split"), part(2).alias("method"), *[part(i).cast("double").alias(c) for i, c in ((3, "ari"), (4, "nmi"), (5, "f1"))])


def _records(spark: SparkSession, glob: str) -> DataFrame:
    """(path, names, cells) of every line after a file's own header.

    Files are read split by split; a header is the first line of its file's first block, and headers are
    broadcast, a row a file.  Cells may be quoted, but not hold line breaks; empty cells are null.
    """

    def cells(line: Column) -> Column:
        bare = lambda c: F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"')
        return F.transform(F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda c: F.nullif(bare(c), F.lit("")))

    lines = spark.read.text(glob).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    heads = lines.groupBy("path").agg(F.min_by(F.struct("value", "id"), F.struct("block", "id")).alias("head"))
    heads = heads.select("path", cells(F.col("head.value")).alias("names"), F.col("head.id").alias("first"))
    return lines.join(F.broadcast(heads), "path").filter((F.col("id") != F.col("first")) & (F.col("value") != "")).select("path", "names", cells(F.col("value")).alias("cells"))


def reports(spark: SparkSession, glob: str) -> DataFrame:
    """Long form (run, file, row, metric, value) of report files whose first column names the row; every file's columns are matched by its own header."""
    raw = _records(spark, glob)
    pair = F.explode(F.slice(F.arrays_zip("names", "cells"), 2, F.size("names")))
    return raw.select(F.regexp_extract("path", PARENT, 1).alias("run"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("cells")[0].alias("row"), pair.alias("c")).select(
        "run", "file", "row", F.col("c.names").alias("metric"), F.col("c.cells").try_cast("double").alias("value")
    )


def files(spark: SparkSession, glob: str) -> DataFrame:
    """(folder, name, size) of files; contents are not read."""
    raw = spark.read.format("binaryFile").load(glob).select("path", "length")
    return raw.select(F.regexp_extract("path", PARENT, 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"))


def parameters(text: Column, schema: str) -> Column:
    """A JSON object whose Python None and NaN are read as null."""
    return F.from_json(F.regexp_replace(text, r"\b(?:None|NaN)\b", "null"), schema)


def training_log(spark: SparkSession, glob: str) -> DataFrame:
    """Training logs with a row each step: epoch and metrics by each file's own header, null where a step or file does not report one."""
    raw = _records(spark, glob)
    names = sorted(r.n for r in raw.select("names").distinct().select(F.explode("names").alias("n")).filter("n is not null").distinct().collect())  # a few metrics
    cell = lambda c: F.get("cells", (F.array_position("names", c) - 1).cast("int"))
    return raw.select(*[cell(c).try_cast("bigint" if c in ("epoch", "step") else "double").alias(c) for c in names])
