"""Line deduplication by counting documents.

Every text is cut at line feeds.  A line's key is the line without white space
(0x20, 0x09-0x0D) at both ends and with A-Z lower-cased; it travels as its SHA-256.
The distinct keys of each document are exploded and counted with a partial
aggregation, so a line that stands in a third of all documents sends a row a task.
Keys of at least ``min_chars`` code points that stand in ``min_docs`` documents or
more lose all their lines.  Positions of such lines are gathered for each document
(a row a dropped line, no text), joined to the documents, and the other lines are
put together again in their order.

The join that finds dropped lines has two parts.  Keys that stand in more than
``total / (HEAVY x partitions)`` documents, where total sums the documents of all
frequent keys, are ``HEAVY x partitions`` at most, so they can be broadcast at any
size; lines of those keys do not take part in the second join, which Spark plans by
measured sizes and in which no key has more lines than that share of documents and
their repeats within documents.

The input is read three times (counts, positions, assembly), which stores nothing of
it.  Only DataFrame functions are used.

Defined cases: null and empty text are one empty line; a line of white space only
has an empty key, which has no code point and stays unless ``min_chars`` is 0; a
carriage return before a line feed is white space of the key and stays in lines
that are kept; a text whose lines are all dropped becomes empty (kept lines are
joined, so a single kept empty line is empty too); every row counts as a document,
also rows that repeat a doc_id (null or not) or a whole row; there are no ties; an
empty table gives an empty result; extra columns pass through in ``without_repeats``
(names starting with ``__ld_`` are reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.shared import written

#: White space of keys.
WHITE = " \t\n\x0b\x0c\r"
#: Keys in more than total / (HEAVY x partitions) documents are broadcast.
HEAVY = 8
MIN_DOCS = 10
MIN_CHARS = 1


def _lower(text: Column) -> Column:
    """A-Z lower-cased; other letters stay."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _sha(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def _text(docs: DataFrame, text: str) -> Column:
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def _row(docs: DataFrame, text: str, doc_id: str) -> Column:
    """What rows of equal doc_id and text share; null differs from every doc_id."""
    named = F.when(docs[doc_id].isNull(), "-").otherwise(F.concat(F.lit("+"), docs[doc_id].cast("string"), F.lit(":")))
    return _sha(F.concat(named, _text(docs, text)))


def frequent_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """key (SHA-256) and n_docs of the keys of ``min_chars`` code points or more that stand in ``min_docs`` documents or more."""

    def hashed(line: Column) -> Column:
        return F.when(F.char_length(_key(line)) >= min_chars, F.sha2(_key(line), 256))

    keys = docs.select(F.explode(F.array_distinct(F.transform(_lines(_lower(_text(docs, text))), hashed))).alias("key")).filter("key IS NOT NULL")
    return keys.groupBy(F.unhex("key").alias("key")).agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def _dropped(docs: DataFrame, frequent: DataFrame, text: str, doc_id: str, min_chars: int) -> DataFrame:
    """__ld_row and the positions of its dropped lines, ascending."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = frequent.agg(F.sum("n_docs")).first()[0] or 0
    heavy = frequent.filter(F.col("n_docs") > total // (HEAVY * partitions)).select("key", F.lit(True).alias("heavy"))
    light = frequent.filter(F.col("n_docs") <= total // (HEAVY * partitions)).select("key", F.lit(True).alias("light"))
    lines = docs.select(_row(docs, text, doc_id).alias("row"), F.posexplode(_lines(_lower(_text(docs, text)))).alias("pos", "line"))
    lines = lines.select("row", "pos", _key(F.col("line")).alias("line")).filter(F.char_length("line") >= min_chars).select("row", "pos", _sha(F.col("line")).alias("key"))
    marked = lines.join(F.broadcast(heavy), "key", "left")
    # a heavy key's lines look for their row's hash instead, which is no key, so they spread
    marked = marked.withColumn("key", F.when(F.col("heavy"), F.col("row")).otherwise(F.col("key"))).join(light, "key", "left")
    found = marked.filter(F.coalesce("heavy", "light", F.lit(False)))
    return found.groupBy(F.col("row").alias("__ld_row")).agg(F.sort_array(F.collect_set("pos")).alias("__ld_drop"))


def decide(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of ``docs`` without ``text``, with ``__ld_lines`` (lines before), ``__ld_gone`` (lines dropped) and ``__ld_kept`` (the text that stays)."""
    frequent = written(frequent_lines(docs, text, min_docs, min_chars))
    own = [f"`{c}`" for c in docs.columns if c != text]
    # lines are cut below the join, so that taking one of them does not cut the text again
    cut = docs.select(*own, _row(docs, text, doc_id).alias("__ld_row"), _lines(_text(docs, text)).alias("__ld_all"))
    both = cut.join(_dropped(docs, frequent, text, doc_id, min_chars), "__ld_row", "left")
    places = F.sequence(F.lit(0), F.size("__ld_all") - 1)
    kept = F.transform(F.array_except(places, F.col("__ld_drop")), lambda i: F.get("__ld_all", i))
    return both.select(
        *own,
        F.size("__ld_all").cast("long").alias("__ld_lines"),
        F.when(F.col("__ld_drop").isNull(), 0).otherwise(F.size("__ld_drop")).cast("long").alias("__ld_gone"),
        F.array_join(F.when(F.col("__ld_drop").isNull(), F.col("__ld_all")).otherwise(kept), "\n").alias("__ld_kept"),
    )


def drop_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document: doc_id, n_lines (before), n_dropped, kept_text."""
    own = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return decide(own, min_docs=min_docs, min_chars=min_chars).select("doc_id", F.col("__ld_lines").alias("n_lines"), F.col("__ld_gone").alias("n_dropped"), F.col("__ld_kept").alias("kept_text"))


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``text`` reduced to the lines that stay; its columns keep their order."""
    left = decide(docs, text, doc_id, min_docs, min_chars)
    return left.select(*[F.col("__ld_kept").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])
