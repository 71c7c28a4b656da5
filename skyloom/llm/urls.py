"""URL filtering: host rules first, then a weighted vocabulary.

Hosts, paths and the longest fitting rule are column expressions.  The vocabulary
is a table (term, strict, weight, whole) that an Aho-Corasick automaton matches
against the lower-cased URL after ``://`` (the whole URL where there is none), all
URLs of a batch in one run over their text; a hit of a ``whole`` term counts where
neither neighbour is a letter a-z or a digit.  One strict term blocks, and so do
``SOFT_HITS`` or more distinct soft terms whose weights reach ``SOFT_WEIGHT``.

The automaton is built from at most ``BLOCK_TERMS`` terms and broadcast; larger
vocabularies are cut into blocks by a hash of the term, one pass over a batch
each, and the hits of all blocks count together.

Defined cases: a null url has empty host and path, fits no rule and is allowed; one
without ``://`` has empty host and path too and is judged by the vocabulary; terms
are lower-cased, null and empty ones are left out, and a repeated term counts once
(strict if one of its rows is, with its largest weight); repeated pages are judged
each; empty tables give an empty result, or let everything pass that no rule
blocks; columns other than page_id and url are not read, so their names may clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules of the contract, as (verdict, host and path).
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
# The default vocabulary; strict terms, and soft terms of weight 1 and one half.
STRICT = (
    "porn", "porno", "pornhub", "xxx", "xvideos", "hentai", "camgirl", "camgirls", "sexcam", "sexcams", "milf", "nudes", "hookup", "escort", "escorts", "fetish",
    "casino", "casinos", "jackpot", "poker", "roulette", "blackjack", "baccarat", "sportsbook", "viagra", "cialis", "levitra", "kamagra", "tramadol", "xanax",
    "warez", "keygen", "keygens", "serialz", "cracked", "phishing", "spam", "payday", "pyramid-scheme", "replica-watches", "linkfarm", "doorway", "malware", "botnet", "carding", "fullz",
)
SOFT = (
    "free", "bet", "bets", "betting", "gamble", "gambling", "slot", "slots", "bingo", "lottery", "lotto", "bonus", "pills", "pharmacy", "drugs", "steroids", "diet", "slimming",
    "adult", "dating", "singles", "sexy", "sex", "erotic", "nude", "webcam", "chat", "loan", "loans", "credit", "mortgage", "forex", "crypto", "binary-options", "debt", "refinance",
    "crack", "torrent", "torrents", "nulled", "hack", "hacks", "cheats", "proxy", "vpn", "replica", "replicas", "knockoff", "counterfeit", "essay-writing", "backlinks", "clickbait",
)
WEAK = ("win", "winner", "cheap", "discount", "deal", "deals", "promo", "coupon", "coupons", "offer", "offers", "sale", "buy", "best", "hot", "instant", "guaranteed", "limited")
#: Distinct soft terms, and their weight together, that block.
SOFT_HITS, SOFT_WEIGHT = 2, 2.0
#: Terms of one automaton.
BLOCK_TERMS = 200_000

TERMS = "term string, strict boolean, weight double, whole boolean"


def default_terms() -> list[tuple[str, bool, float, bool]]:
    return [(t, True, 1.0, True) for t in STRICT] + [(t, False, 1.0, True) for t in SOFT] + [(t, False, 0.5, True) for t in WEAK]


class Vocabulary:
    """One block of terms as an Aho-Corasick automaton."""

    def __init__(self, rows: list[tuple[str, bool, float, bool]]):
        self.rows = rows
        self.size = np.array([len(r[0]) for r in rows], dtype=np.int64)
        self.strict, self.weight, self.whole = (np.array([r[i] for r in rows]) for i in (1, 2, 3))
        self._machine = None

    def __getstate__(self):
        return {**self.__dict__, "_machine": None}  # built anew on each worker

    def _run(self, text: str):
        import ahocorasick

        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for i, r in enumerate(self.rows):
                self._machine.add_word(r[0], i)
            self._machine.make_automaton()
        return self._machine.iter(text)

    def hits(self, urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row, term) of every distinct term that counts in a lower-cased URL."""
        text = "\n".join(urls)
        found = [x for end, term in self._run(text) for x in (end, term)] if self.rows else []
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end, term = np.array(found, dtype=np.int64).reshape(-1, 2).T
        starts = np.cumsum([0] + [len(u) + 1 for u in urls])
        row = np.searchsorted(starts, end, side="right") - 1
        code = np.frombuffer(f"\n{text}\n".encode("utf-32-le", "surrogatepass"), np.uint32)  # code[i + 1] is character i
        word = ((code >= 0x61) & (code <= 0x7A)) | ((code >= 0x30) & (code <= 0x39))
        first = end - self.size[term] + 1
        ok = (first >= starts[row]) & ~(self.whole[term] & (word[first] | word[end + 2]))
        key = np.unique(row[ok] * len(self.rows) + term[ok])
        return key // len(self.rows), key % len(self.rows)


def _vocabularies(pages: DataFrame, terms: DataFrame | None):
    """Broadcast blocks of distinct terms, each of bounded size."""
    spark = pages.sparkSession
    if terms is None:
        return [spark.sparkContext.broadcast(Vocabulary(default_terms()))]
    low = _lower(F.col("term"))
    rows = terms.select(low.alias("term"), F.coalesce("strict", F.lit(False)).alias("strict"), F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("whole", F.lit(True)).alias("whole")).filter("term <> ''")
    rows = rows.groupBy("term").agg(F.max("strict").alias("strict"), F.max("weight").alias("weight"), F.min("whole").alias("whole"))
    blocks = -(-rows.count() // BLOCK_TERMS)
    mine = lambda b: rows.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b).collect()
    return [spark.sparkContext.broadcast(Vocabulary([tuple(r) for r in mine(b)])) for b in range(blocks)]


def _found(shared):
    """Per URL of a block's terms: strict ones, soft ones, and the soft ones' weight."""

    @F.pandas_udf("strict long, soft long, weight double")
    def found(text: pd.Series) -> pd.DataFrame:
        n, vocabulary = len(text), shared.value
        row, term = vocabulary.hits(text.fillna("").tolist())
        strict = vocabulary.strict[term]
        soft = row[~strict]
        return pd.DataFrame({"strict": np.bincount(row[strict], minlength=n), "soft": np.bincount(soft, minlength=n), "weight": np.bincount(soft, weights=vocabulary.weight[term[~strict]], minlength=n).astype(float)})

    return found


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def judge(pages: DataFrame, rules=RULES, terms: DataFrame | None = None, hits: int = SOFT_HITS, weight: float = SOFT_WEIGHT) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, strict_hits, soft_hits, soft_weight.

    ``terms`` is the vocabulary (term, strict, weight, whole; nulls read as false, 1, true); ``hits`` and ``weight`` of distinct soft terms block.
    """
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = _lower(F.regexp_extract("rest", r"^([^/?#]*)", 1))
    path = F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):  # a longer rule replaces a shorter one
        at = text.index("/")
        fits = ((F.col("host") == text[:at]) | F.col("host").endswith("." + text[:at])) & F.col("path").startswith(text[at:])
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    split = pages.select("page_id", "url").withColumn("rest", rest).withColumn("host", host).withColumn("path", path)
    ruled = split.withColumn("rule", rule).withColumn("by_rule", verdict).withColumn("low", _lower(F.when(F.instr("url", "://") > 0, F.col("rest")).otherwise(F.col("url"))))
    counts = {"strict": F.lit(0), "soft": F.lit(0), "weight": F.lit(0.0)}
    for i, shared in enumerate(_vocabularies(pages, terms)):
        ruled = ruled.withColumn(f"found{i}", _found(shared)("low"))
        counts = {k: c + F.col(f"found{i}.{k}") for k, c in counts.items()}
    blocked = (counts["strict"] > 0) | ((counts["soft"] >= hits) & (counts["weight"] >= weight))
    verdict = F.coalesce("by_rule", F.when(blocked, "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"), *[c.alias(n) for n, c in zip(("strict_hits", "soft_hits", "soft_weight"), counts.values())])


def oracle() -> str:
    """DuckDB SQL of ``judge``."""
    fit = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    by_length = sorted(RULES, key=lambda r: -len(r[1]))
    cases = [(fit.format(h=t[: t.index("/")], p=t[t.index("/") :]), t, v) for v, t in by_length]
    rule = " ".join(f"WHEN {c} THEN '{t}'" for c, t, _ in cases)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in cases)

    def hit(term: str) -> str:
        return f"regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"

    terms = default_terms()
    strict = " + ".join(f"CAST({hit(t)} AS BIGINT)" for t, s, _, _ in terms if s)
    soft = " + ".join(f"CAST({hit(t)} AS BIGINT)" for t, s, _, _ in terms if not s)
    weight = " + ".join(f"{w}::DOUBLE * CAST({hit(t)} AS INTEGER)" for t, s, w, _ in terms if not s)
    return f"""
WITH r AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    translate(CASE WHEN contains(url, '://') THEN rest ELSE coalesce(url, '') END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM r
), v AS (
  SELECT *, {strict} AS strict_hits, {soft} AS soft_hits, {weight} AS soft_weight FROM p
)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN strict_hits > 0 OR (soft_hits >= {SOFT_HITS} AND soft_weight >= {SOFT_WEIGHT}) THEN 'block' ELSE 'allow' END AS verdict, strict_hits, soft_hits, soft_weight
FROM v
"""
