"""Quality rules: a threshold table compiled into one Spark projection.

``measures`` gives the columns the rules speak of (length, symbol, stop-word, line and
repetition counts); ``RULES`` is the table (name, ratio expression, lowest and highest
value allowed); ``apply_rules`` turns it into one boolean expression per rule. Every step
is a built-in expression on the row's own text: no shuffle, no user function.

Words are runs of ``[^\\x20\\x09-\\x0D]``. Three-word windows are compared by XXH64 of
their words; repeats are found in a sorted array of the window hashes, and only texts with
a repeat sort (hash, position) pairs, so the work grows as n log n of a text.

Defined results: null text has no words (all counts 0, ``base_failed``); a text of fewer
than three words has no window; lines without a word are not counted as copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
STOP_WORDS = tuple(
    # en
    "the of and to in is that for it as was with be by on not he are this or from at an have".split()
    # fr
    + "le la les de des du et un une est que qui dans pour par sur au pas plus avec il elle".split()
    # de
    + "der die das und ein eine ist von zu den mit im nicht auf sich des dem für als auch".split()
    # es
    + "el los las y en que un una por con para del se su al lo como es no más".split())

#: (rule, ratio over the measures, lowest, highest); None: no bound on that side. A text with a
#: ratio outside its bounds is not kept. The bounds leave wide room around ordinary prose.
RULES = (
    ("mean_word_length", "word_chars / n_words", 2.0, 15.0),
    ("symbols_per_word", "n_symbols / n_words", None, 0.25),
    ("stop_word_share", "n_stop / n_words", 0.02, None),
    ("lower_case_share", "n_lower / n_letters", 0.4, None),
    ("copied_line_share", "n_dup_lines / n_lines", None, 0.5),
    ("same_word_share", "n_same_next / n_words", None, 0.3),
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows found twice or more in the array."""
    def over_hashes(h):
        def over_sorted(s):
            repeated = F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.get(s, i) == F.get(s, i - 1))
            return F.when((F.size(s) > 1) & repeated, _let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)).otherwise(0)
        return _let(F.sort_array(h), over_sorted)

    def covered(pairs):
        def at(i):
            return F.get(pairs, i)["h"]
        hit = F.filter(pairs, lambda p, j: (p["h"] == at(j + 1)) | (p["h"] == at(j - 1)))
        return _let(F.sort_array(F.transform(hit, lambda p: p["i"])), lambda pos: F.aggregate(
            F.transform(pos, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(pos, j + 1) - p, F.lit(3)))),
            F.lit(0), lambda a, x: a + x))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3),
                          lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(windows, over_hashes))


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of every text (long): n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines, n_stop, n_letters, n_lower, n_same_next."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("doc_id", t.alias("t"))
    bare = F.regexp_replace("t", "[\\x20\\x09-\\x0D]+", "")
    d = d.select("doc_id", "t", F.length(bare).alias("word_chars"),
                 F.split(F.btrim("t", F.lit(WHITE)), "[\\x20\\x09-\\x0D]+").alias("w"))
    d = d.select("doc_id", "t", "word_chars", F.when(F.col("word_chars") == 0, F.array().cast("array<string>")).otherwise(F.col("w")).alias("w"))
    solid = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    stop = F.array(*[F.lit(x) for x in STOP_WORDS])
    return d.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        _let(solid, lambda ln: F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.size(solid).cast("long").alias("n_lines"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop"),
        F.length(F.regexp_replace("t", "[^\\p{L}]+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("t", "[^\\p{Ll}]+", "")).cast("long").alias("n_lower"),
        F.size(F.filter("w", lambda x, i: x == F.get(F.col("w"), i - 1))).cast("long").alias("n_same_next"))


def rule_column(ratio: str, low: float | None, high: float | None) -> Column:
    """True if the ratio is inside its bounds or undefined (zero denominator)."""
    top, bottom = (F.col(x) for x in ratio.split(" / "))
    ok = F.lit(True)
    if low is not None:
        ok = ok & (top >= low * bottom)
    if high is not None:
        ok = ok & (top <= high * bottom)
    return ok


def apply_rules(m: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``base_failed``, ``failed_rules`` (names) and ``kept``."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(~rule_column(*r[1:]), F.lit(r[0])) for r in rules]), lambda x: x.isNotNull())
    return (m.withColumn("base_failed", base).withColumn("failed_rules", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = apply_rules(measures(table(spark, sf_dir, "documents")))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SET = ", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))
OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM d),
x AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM x) WHERE n > 1),
c AS (SELECT doc_id, sum(least(3, coalesce(nx - i, 3))) AS n
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ln) - len(list_distinct(ln)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(ln) AS n_lines,
             len(list_filter(w, lambda x: lower(x) IN ({_SET}))) AS n_stop,
             length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS n_letters,
             length(regexp_replace(t, '[^\p{{Ll}}]+', '', 'g')) AS n_lower,
             len(list_filter(list_zip(w[2:], w[:-2]), lambda p: p[1] = p[2])) AS n_same_next
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
       {"".join(" AND " + " AND ".join(f"{top} {op} {bound}::DOUBLE * {bottom}" for op, bound in ((">=", lo), ("<=", hi)) if bound is not None)
                for _, ratio, lo, hi in RULES for top, bottom in [ratio.split(" / ")])} AS kept
FROM m
"""
