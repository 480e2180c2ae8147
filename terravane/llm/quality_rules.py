"""Operator 10: a threshold table compiled into Spark projections of text ratios, without user functions.

The words of a text are exact; its 3-word windows are told apart by a 64-bit hash within that text.
Null and empty texts have no words: all counts are 0, base_failed is true, kept is false. Repeated rows
and ties give equal rows. Other columns of the input don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, words_of

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that for it was on with as be by at this are from or an a "
    "le la les de des du et un une que qui en dans pour par au sur ce se pas "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "el los las y del se una por con no su para lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """low <= numerator / denominator <= high, judged without division; a zero denominator passes only if low <= 0."""

    name: str
    over: str
    under: str | None
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        top, bottom = F.col(self.over).cast("double"), F.col(self.under).cast("double") if self.under else F.lit(1.0)
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (top >= bottom * self.low)
        if self.high is not None:
            ok = ok & (top <= bottom * self.high)
        return ok


#: The threshold table: lengths, symbols, stop words and lines.
RULES = (
    Rule("words", "n_words", None, low=50, high=1_000_000),
    Rule("mean word length", "word_chars", "n_words", low=2.5, high=14.0),
    Rule("symbols a word", "n_symbols", "n_words", high=0.1),
    Rule("stop words", "n_stop_words", "n_words", low=0.03),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("words a line", "n_words", "n_lines", low=2.0),
)
#: Of the contract: at least so many words, and at most this share of them in repeated 3-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50


def measures(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys and the counts that rules are made of, for every row; whole texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = df.select(*keys, t.alias("_t"), words_of(F.col(text)).alias("_w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("_l"))
    n = F.size("_w")
    counted = base.select(
        *keys,
        n.cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("_t", SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length("_t") - F.char_length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        # (hash, place) of each 3-word window in order of the hash: equal windows are neighbours
        F.sort_array(F.transform(F.slice("_w", 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i")))).alias("_s"),
    )
    none = F.lit(None).cast("struct<h:bigint,i:int>")
    # where a neighbour has the same hash, the place, else null
    twice = F.zip_with(
        F.zip_with(F.concat(F.array(none), F.slice("_s", 1, F.greatest(F.size("_s") - 1, F.lit(0)))), F.col("_s"), lambda a, b: F.when(a["h"] == b["h"], b["i"])),
        F.zip_with(F.col("_s"), F.concat(F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0))), F.array(none)), lambda a, b: F.when(a["h"] == b["h"], a["i"])),
        lambda a, b: F.coalesce(a, b),
    )
    names = [*keys, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words"]
    placed = counted.select(*names, F.when(F.size("_s") > 0, F.sort_array(F.array_compact(twice))).otherwise(F.array().cast("array<int>")).alias("_p"))
    # each place covers three words, or as many as there are up to the next place
    covered = F.aggregate(F.zip_with("_p", F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda s, x: s + x)
    return placed.select(*names, F.when(F.size("_p") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"))


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed, kept and failed_rules (names, empty if none)."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    held = F.lit(True)
    for r in rules:
        held = held & r.holds()
    names = F.array_compact(F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in rules]))
    return measured.withColumns({"base_failed": failed, "kept": ~failed & held, "failed_rules": names})


def quality_rules(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return judge(measures(df, text, keys), rules)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words")


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
k AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM k),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY rid),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(len(list_filter(ws, lambda x: lower(x) IN ({_STOP}))) AS BIGINT) AS n_stop_words
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words BETWEEN 50 AND 1000000
       AND word_chars >= 2.5 * n_words AND word_chars <= 14.0 * n_words
       AND n_symbols <= n_words * CAST(0.1 AS DOUBLE) AND n_stop_words >= n_words * CAST(0.03 AS DOUBLE)
       AND n_dup_lines <= n_lines * CAST(0.5 AS DOUBLE) AND n_words >= 2.0 * n_lines AS kept,
       n_lines, n_stop_words
FROM b
"""
