"""Exact deduplication by content sort.

Rows are dealt by ``repartitionByRange`` (Spark samples the splitters) on the
first characters of the normalised text and its 64-bit hash, which breaks ties
between texts with the same beginning, so splitters stay small however long the
texts are.  Each range is sorted by Spark's external sort with the whole normalised
text in the key, which places equal texts side by side, and the window operator
walks the range and compares neighbouring texts in full; the smallest doc_id of a
run stays.

One text may make up a third of the table.  Hashes of more than
``rows / (HEAVY x partitions)`` rows, of which there are ``HEAVY x partitions`` at most,
are found by counting; their rows (none in most tables) are sorted apart with a salt in
the range key, in proportion to their number, so a text makes several runs.  The
heads of these runs (whole text, smallest doc_id, length; two a hash and share of rows)
are merged by their full texts, and the rows of a run take what its text has come to.
Hashes only deal rows out: with any hash, equal rows end up in one group and
others do not.

The input is scanned three times: for the counts of hashes, for the splitters and for
the exchange.  Of light rows nothing but hashes and counts is stored.

Only DataFrame functions are used.

Defined cases: null text counts as empty; empty texts are equal to each other;
a null doc_id is larger than all others, so it stays only where a group has no
other row; rows that repeat a doc_id and text count each, and only one of them
stays in ``deduplicate``; an empty table gives an empty result;
extra columns pass through (names starting with ``__dx_`` are reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.shared import written

#: Characters of normalised text in the range key.
PREFIX = 48
#: A hash with more than rows / (HEAVY x partitions) rows is salted.
HEAVY = 8


def normalised(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with ``name``: null as empty, and each run of space and 0x09-0x0D as one space.

    Plain replacements do it for texts that are left without two spaces in a row; only the others need the regular expression.
    """
    spaced = F.coalesce(F.col(text), F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    one = F.when(F.contains(F.col(name), F.lit("  ")), F.regexp_replace(name, " {2,}", " ")).otherwise(F.col(name))
    return docs.withColumn(name, spaced).withColumn(name, one)


def _hash(text: Column) -> Column:
    """What deals rows out; any function of the text will do."""
    return F.xxhash64(text)


def _walked(rows: DataFrame, own: list[str], text: str, doc_id: str, salt: Column | None, partitions: int) -> DataFrame:
    """``own`` of ``rows`` with ``__dx_place``, ``__dx_keep`` and ``__dx_size`` of their run, after the content sort; runs are of equal text and salt."""
    keys = ["__dx_prefix", "__dx_hash", *([] if salt is None else ["__dx_salt"])]  # a constant salt would hide from Spark that ranges hold whole runs
    keyed = rows.withColumn("__dx_prefix", F.substring("__dx_norm", 1, PREFIX)).withColumns({} if salt is None else {"__dx_salt": salt})
    ranged = keyed.select(*own, *([] if f"`{text}`" in own else ["__dx_norm"]), *keys).repartitionByRange(partitions, *keys)
    if f"`{text}`" in own:  # a text travels once
        ranged = normalised(ranged, text, "__dx_norm")
    run = Window.partitionBy(*keys, "__dx_norm")
    ordered = run.orderBy(F.col(doc_id).asc_nulls_last())
    placed = ranged.withColumn("__dx_place", F.row_number().over(ordered)).withColumn("__dx_keep", F.first(doc_id).over(ordered))
    return placed.withColumn("__dx_size", F.count(F.lit(1)).over(run))


def _parts(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame | None, int]:
    """Light rows and heavy ones (with ``__dx_ways``, the salts of their hash; None where there are none), both hashed, and the number of partitions."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = normalised(docs, text, "__dx_norm").withColumn("__dx_hash", _hash(F.col("__dx_norm")))
    most = max(1, docs.count() // (HEAVY * partitions))
    heavy = written(hashed.groupBy("__dx_hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most))
    if heavy.isEmpty():
        return hashed, None, partitions
    ways = F.broadcast(heavy.select("__dx_hash", F.ceil(F.col("n") / most).alias("__dx_ways")))  # HEAVY x partitions rows at most
    return hashed.join(ways, "__dx_hash", "left_anti"), hashed.join(ways, "__dx_hash"), partitions


def _spread() -> Column:
    """A salt that does not depend on doc_id, which may repeat."""
    return F.pmod(F.monotonically_increasing_id(), F.col("__dx_ways")).cast("int")


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    light, heavy, partitions = _parts(own, "text")
    sha = F.sha2("__dx_norm", 256)
    out = _walked(light, ["doc_id"], "text", "doc_id", None, partitions).select("doc_id", "__dx_keep", "__dx_size", sha.alias("__dx_sha"))
    if heavy is not None:
        head = F.when(F.col("__dx_place") == 1, F.col("__dx_norm"))
        rows = written(_walked(heavy, ["doc_id"], "text", "doc_id", _spread(), partitions).select("doc_id", "__dx_keep", "__dx_size", sha.alias("__dx_sha"), "__dx_place", head.alias("__dx_head")))
        merged = rows.filter("__dx_place = 1").groupBy("__dx_head").agg(F.min("__dx_keep").alias("__dx_keep"), F.sum("__dx_size").alias("__dx_size"))
        known = merged.select(F.sha2("__dx_head", 256).alias("__dx_sha"), "__dx_keep", "__dx_size")
        out = out.unionByName(rows.select("doc_id", "__dx_sha").join(known, "__dx_sha"))
    keep = F.col("__dx_keep")
    return out.select("doc_id", keep.alias("keep_id"), F.col("__dx_size").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.col("__dx_sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns only."""
    light, heavy, partitions = _parts(docs, text)
    own = [f"`{c}`" for c in docs.columns]
    out = _walked(light, own, text, doc_id, None, partitions).filter("__dx_place = 1").select(*own)
    if heavy is not None:
        heads = _walked(heavy, own, text, doc_id, _spread(), partitions).filter("__dx_place = 1").select(*own, "__dx_norm")
        first = F.row_number().over(Window.partitionBy("__dx_norm").orderBy(F.col(doc_id).asc_nulls_last()))
        out = out.unionByName(heads.withColumn("__dx_place", first).filter("__dx_place = 1").select(*own))
    return out
