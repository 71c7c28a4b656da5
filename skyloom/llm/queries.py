"""The queries of the numbered operators, each over its whole table, and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import bpe, decontaminate, exact_dedup, language, lexical, line_dedup, minhash, pii, prefix_trie, substring_dedup, token_files, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def _remainder(column: str = "doc_id"):
    """crc32 of the id's digits, modulo 4; 2 is held out."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(4))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    trees = language.learn(docs.filter(_remainder() != 2))
    return language.predict(docs, trees).select("doc_id", (_remainder() == 2).alias("held_out"), "lang_pred", "score")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.through_files(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def toxicity_model(docs: DataFrame, sf_dir: str):
    """The model of all labelled rows of ``docs`` that are not held out."""
    return toxicity.learn(docs, _table(docs.sparkSession, sf_dir, "labels"), _remainder() != 2)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, sf_dir))
    predicted = F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0)
    return scored.select("doc_id", (_remainder() == 2).alias("held_out"), "score", predicted.alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(_table(spark, sf_dir, "documents"))
    return lexical.search(index, _table(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(ws[s:s + 12], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM w WHERE len(ws) >= 13)
), cov AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY k) AS m FROM win) WHERE m < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM cov
), word AS (
  SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
"""

OP11_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list({'r': r, 'x': x} ORDER BY p) AS ts, CAST(c AS VARCHAR) AS s FROM t GROUP BY c
), crc AS (
  SELECT c, ts, xor(list_reduce(list_concat([4294967295::BIGINT],
      flatten(list_transform(range(1, length(s) + 1), lambda i: [CAST(ascii(s[i]) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 9 AS h
  FROM own
), built AS (
  SELECT a.c, CASE WHEN a.c % 5 = 0 THEN a.ts ELSE list_concat(coalesce(b.ts, [])[:a.h], a.ts[a.h + 1:]) END AS ts
  FROM crc a LEFT JOIN own b ON b.c = a.c - a.c % 5
), path AS (
  SELECT c, len(ts) AS n, d, ts[:d] AS k, CASE WHEN d > 0 THEN ts[:d - 1] END AS pk, coalesce(strlen(ts[d].x), 0) AS b
  FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM built)
), node AS (
  SELECT k, any_value(pk) AS pk, any_value(d) AS d, any_value(b) AS b, min(c) AS m, count(*) AS n,
    coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '') AS ends
  FROM path GROUP BY k
), kids AS (
  SELECT pk AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY pk
), facts AS (
  SELECT node.k, node.pk, node.d, node.m, node.n, node.ends, coalesce(kids.n, 0) AS kids, (node.n - 1) * node.b AS saved FROM node LEFT JOIN kids USING (k)
), sums AS (
  SELECT f.k[:a] AS k, sum(f.saved) AS saved, count(*) FILTER (f.kids = 0) AS leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM facts) f GROUP BY 1
)
SELECT f.m AS conv_id, CAST(f.d AS BIGINT) AS depth, p.m AS parent_conv_id, CAST(f.n AS BIGINT) AS n_convs, CAST(f.kids AS BIGINT) AS n_children,
  CAST(sums.leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM facts f JOIN sums USING (k) LEFT JOIN facts p ON p.k = f.pk
"""

OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
), words AS (
  SELECT r, doc_id, regexp_extract_all(x, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM d
), sums AS (
  SELECT count(*) FILTER (len(ws) > 0)::BIGINT AS n, sum(len(ws))::BIGINT AS l FROM words
), posting AS (
  SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS t FROM words) GROUP BY r, t
), term AS (
  SELECT t, floor(1000 * ln((2 * n + 2) / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*)::BIGINT AS df FROM posting GROUP BY t), sums
), mass AS (
  SELECT r, doc_id, 10 + (90 * len(ws) * n) // l AS m FROM words, sums WHERE len(ws) > 0
), item AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS score
  FROM item JOIN term USING (t) JOIN posting USING (t) JOIN mass USING (r) GROUP BY item_id, r, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10
"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, p, ls[p] AS line, translate(trim(ls[p], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM d)
), bad AS (
  SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS t, count(*) AS n FROM l ANTI JOIN bad USING (k) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_near_dedup, op2_language, op3_pii, op4_substring_dedup, op5_decontamination, op6_token_files, op7_exact_dedup, op8_url_filter, op9_bpe, op10_toxicity, op11_prefix_trie, op12_lexical_search, op13_line_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": OP4_SQL, "op7_exact_dedup": OP7_SQL, "op8_url_filter": urls.oracle(), "op11_prefix_trie": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_line_dedup": OP13_SQL}
