"""Line dedup over overlapping three-line windows.

Lines are the ``\\n`` pieces of a text; blank lines (white space only) belong to no
window. Each run of three consecutive non-blank lines, trimmed, is hashed to 128 bits.
A window found more than once in the corpus keeps its first occurrence, in the order
(doc_id, text hash, position), nulls first; each later one covers the lines from its
first to its last line, blank ones between included, but not lines of the first
occurrence it overlaps itself. Covered lines of a document are merged and removed.

The global step shuffles one small row per line (two hashes, id, positions). First
occurrences come from a partially aggregated min, so a window held by a third of all
rows costs one row per task; the join back spreads such a window by AQE skew splits,
and its result is narrow.

Defined results: null text stays null; a text with fewer than three non-blank lines is
unchanged; rows with the same id and text share all decisions; a text whose lines
are all covered becomes empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

BLANK = " \t\x0b\f\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_windows(docs: DataFrame, width: int = 3) -> DataFrame:
    """(h1, h2, occ): a row per window; occ = (doc_id, text hash, first line, last line)."""
    trimmed = F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(BLANK)).alias("x")))
    hashed = F.transform(F.filter(trimmed, lambda e: e["x"] != ""), lambda e: F.struct(
        e["i"].alias("i"), F.xxhash64(e["x"]).alias("a"), F.xxhash64(F.lit(7), e["x"]).alias("b")))
    one = (docs.select("doc_id", F.col("text").cast("string").alias("text"))
           .select("doc_id", F.xxhash64("text").alias("th"), hashed.alias("ln"))
           .where(F.size("ln") >= width)
           .select("doc_id", "th", "ln", F.explode(F.sequence(F.lit(0), F.size("ln") - width)).alias("p")))
    part = [F.col("ln")[F.col("p") + j] for j in range(width)]
    return one.select(F.xxhash64(*[x["a"] for x in part]).alias("h1"), F.xxhash64(*[x["b"] for x in part]).alias("h2"),
                      F.struct("doc_id", "th", part[0]["i"].alias("lo"), part[-1]["i"].alias("hi")).alias("occ"))


def covered_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, th, gone): the covered line numbers of each text that has any."""
    w = line_windows(docs, width)
    first = (w.groupBy("h1", "h2").agg(F.min("occ").alias("first"), F.count(F.lit(1)).alias("n"))
             .where(F.col("n") > 1).drop("n"))
    o, f = F.col("occ"), F.col("first")
    own = o["doc_id"].eqNullSafe(f["doc_id"]) & (o["th"] == f["th"])
    later = (w.join(first, ["h1", "h2"]).where(~(own & (o["lo"] == f["lo"])))
             .select(o["doc_id"].alias("doc_id"), o["th"].alias("th"),
                     F.when(own, F.greatest(o["lo"], f["hi"] + 1)).otherwise(o["lo"]).alias("lo"), o["hi"].alias("hi"))
             .where(F.col("lo") <= F.col("hi")))
    return (later.select("doc_id", "th", F.explode(F.sequence("lo", "hi")).alias("i"))
            .groupBy("doc_id", "th").agg(F.collect_set("i").alias("gone")))


def dedup_lines(docs: DataFrame, width: int = 3, counts: bool = False) -> DataFrame:
    """``docs`` with ``text`` freed of repeated windows; with ``counts`` also ``n_lines``
    and ``n_removed``."""
    gone, gid, gth = free_name(docs, "_gone"), free_name(docs, "_gid"), free_name(docs, "_gth")
    c = covered_lines(docs, width).select(F.col("doc_id").alias(gid), F.col("th").alias(gth), F.col("gone").alias(gone))
    out = docs.join(c, F.col("doc_id").eqNullSafe(F.col(gid)) & (F.xxhash64(F.col("text").cast("string")) == F.col(gth)), "left")
    lines = _lines(F.col("text"))
    # the line array is bound once, not split again for every line
    kept = F.flatten(F.transform(F.array(lines), lambda ls: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(gone)), lambda i: F.get(ls, i))))
    if counts:
        out = out.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"))
        out = out.withColumn("n_removed", F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"))
    out = out.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    return out.drop(gone, gid, gth)


def op4_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, counts=True).select(
        "doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i + 1] AS x, trim(ls[i + 1], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t
      FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM d WHERE text IS NOT NULL)),
s AS (SELECT doc_id, i, t || chr(10) || lead(t, 1) OVER w || chr(10) || lead(t, 2) OVER w AS win, lead(i, 2) OVER w AS hi
      FROM l WHERE t <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT win, min(struct_pack(a := doc_id, lo := i, hi := hi)) AS f FROM s WHERE hi IS NOT NULL GROUP BY win HAVING count(*) > 1),
c AS (SELECT doc_id, CASE WHEN doc_id = f.f.a THEN greatest(i, f.f.hi + 1) ELSE i END AS lo, s.hi
      FROM s JOIN f USING (win) WHERE s.hi IS NOT NULL AND NOT (doc_id = f.f.a AND i = f.f.lo)),
g AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS i FROM c WHERE lo <= hi),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
             coalesce(string_agg(x, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS kept
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CAST(length(kept) AS BIGINT) AS n_chars, md5(kept) AS text_md5
FROM d LEFT JOIN k USING (doc_id)
"""
