"""URL filters: empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are counted per host. Three beta-binomial levels
shrink them: a suffix's rate towards the overall rate, a registered domain's towards its
suffix, a host's towards its domain. The strength of each level's prior comes from the
data: with parent mean m, n outcomes and k good ones per group, the expected sum of
(k - n m)^2 / (n m (1 - m)) is J + rho (N - J), so the moment estimate of the intra-group
correlation rho gives a prior of 1 / rho - 1 pseudo-outcomes. A host is blocked if the
upper posterior bound of its good rate stays under ``min_good``. Hand-written rules
(host, path prefix) come first; the longest that fits a url decides.

A page's outcome is the label of the document that its url names: the last number of the
path; it is good if quality is 1 and toxic is not 1. Counting is partially aggregated, so a host that
holds a third of all pages costs one row per task; the host table goes back to the pages
by a join that AQE may split or broadcast after measuring it.

Defined results: null url or no ``://``: empty host and path, judged as host ''; a url
without a path fits no rule; hosts without outcomes get their domain's rate; rows that
repeat count again; no outcome at all: prior mean 1/2, nothing is blocked.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (verdict, rule); a rule is host, then path prefix.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MIN_GOOD = 0.5
Z = 1.645
RHO_LOW, RHO_HIGH = 0.005, 0.5


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def domain_of(host: Column) -> Column:
    """Registered domain: the last two labels."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, slash, p = text.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, n, k): labelled pages and good ones per host; ``pages`` has host and path."""
    good = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id")
            .agg(F.min(((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) != 1)).cast("long")).alias("good"))
            .select(F.col("doc_id").cast("long").alias("doc"), "good"))
    named = pages.select("host", F.regexp_extract("path", "([0-9]{1,18})[^0-9]*$", 1).try_cast("long").alias("doc"))
    return named.where(F.col("doc").isNotNull()).join(good, "doc").groupBy("host").agg(F.count("good").alias("n"), F.sum("good").alias("k"))


def _level(groups: DataFrame, parent: Column) -> float:
    """Prior strength of a level whose rows hold n, k and the parent's mean."""
    g = groups.withColumn("_m", parent)
    x2 = F.pow(F.col("k") - F.col("n") * F.col("_m"), 2) / (F.col("n") * F.col("_m") * (1 - F.col("_m")))
    r = g.where("n > 0").agg(F.sum(x2).alias("x"), F.count(F.lit(1)).alias("j"), F.sum("n").alias("n")).first()
    spare = (r["n"] or 0) - r["j"]
    rho = ((r["x"] or 0.0) - r["j"]) / spare if spare > 0 else RHO_HIGH  # nothing to learn from: weak prior
    return 1.0 / min(max(rho, RHO_LOW), RHO_HIGH) - 1.0


def _shrunk(parent: str, s: float) -> Column:
    return (F.col("k") + s * F.col(parent)) / (F.col("n") + s)


def reputations(counts: DataFrame, z: float = Z) -> DataFrame:
    """(host, n, k, mean, low, high) for every host of ``counts`` (host, n, k)."""
    c = counts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))).checkpoint()
    total = c.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    m0 = ((total["k"] or 0) + 1.0) / ((total["n"] or 0) + 2.0)
    suf = c.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("m0", F.lit(m0))
    suf = suf.withColumn("m1", _shrunk("m0", _level(suf, F.col("m0"))))
    dom = c.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(suf.select("suffix", "m1"), "suffix")
    dom = dom.withColumn("m2", _shrunk("m1", _level(dom, F.col("m1"))))
    host = c.join(dom.select("domain", "m2"), "domain")
    s = _level(host, F.col("m2"))
    a, b = F.col("k") + s * F.col("m2"), F.col("n") - F.col("k") + s * (1 - F.col("m2"))
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return host.select("host", "n", "k", (a / (a + b)).alias("mean"), (a / (a + b) - z * sd).alias("low"), (a / (a + b) + z * sd).alias("high"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, min_good: float = MIN_GOOD) -> DataFrame:
    """Every page with host, path, rule and verdict, and its host's outcomes and posterior
    (n_labelled, n_good, mean, low, high); columns of these names are replaced."""
    p = pages.drop("n_labelled", "n_good", "mean", "low", "high").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    every = p.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    known = outcomes(p, labels)
    counts = every.join(known, "host", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"))
    rule, said = rule_columns(rules)
    rep = reputations(counts).withColumnRenamed("n", "n_labelled").withColumnRenamed("k", "n_good")
    method = F.when(F.round("high", 9) < min_good, "block").otherwise("allow")
    return p.join(rep, "host", "left").withColumn("rule", rule).withColumn("verdict", F.coalesce(said, method))


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict", "n_labelled", "n_good")


_CASES = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))


def _sql_case(value) -> str:
    arms = []
    for r in _CASES:
        h, slash, p = r[1].partition("/")
        arms.append(f"WHEN (p.host = '{h}' OR ends_with(p.host, '.{h}')) AND starts_with(path, '{slash}{p}') THEN '{value(r)}'")
    return "CASE " + " ".join(arms) + " END"


def _sql_rho(src: str, m: str) -> str:
    return (f"(SELECT 1.0 / least(greatest(CASE WHEN coalesce(sum(n), 0) - count(*) > 0 THEN (sum(pow(k - n * {m}, 2) / (n * {m} * (1 - {m}))) - count(*))"
            f" / (sum(n) - count(*)) ELSE {RHO_HIGH} END, {RHO_LOW}), {RHO_HIGH}) - 1.0 AS s FROM {src} WHERE n > 0)")


OP1_SQL = f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
                  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
g AS (SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) <> 1 THEN 1 ELSE 0 END) AS good FROM labels
      WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
o AS (SELECT host, count(good) AS n, sum(good) AS k FROM p JOIN g ON TRY_CAST(regexp_extract(path, '([0-9]{{1,18}})[^0-9]*$', 1) AS BIGINT) = g.doc_id GROUP BY host),
c AS (SELECT h.host, coalesce(n, 0)::DOUBLE AS n, coalesce(k, 0)::DOUBLE AS k, array_to_string(list_reverse(list_reverse(string_split(h.host, '.'))[1:2]), '.') AS domain,
             list_reverse(string_split(h.host, '.'))[1] AS suffix FROM (SELECT DISTINCT host FROM p) h LEFT JOIN o ON h.host = o.host),
t AS (SELECT (sum(k) + 1.0) / (sum(n) + 2.0) AS m0 FROM c),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(m0) AS m0 FROM c, t GROUP BY suffix),
s1 AS (SELECT suffix, (k + s * m0) / (n + s) AS m1 FROM s0, {_sql_rho("s0", "m0")}),
d0 AS (SELECT domain, sum(n) AS n, sum(k) AS k, any_value(m1) AS m1 FROM c JOIN s1 ON c.suffix = s1.suffix GROUP BY domain),
d1 AS (SELECT domain, (k + s * m1) / (n + s) AS m2 FROM d0, {_sql_rho("d0", "m1")}),
h0 AS (SELECT host, n, k, m2 FROM c JOIN d1 ON c.domain = d1.domain),
h1 AS (SELECT host, n, k, k + s * m2 AS a, n - k + s * (1 - m2) AS b FROM h0, {_sql_rho("h0", "m2")}),
h2 AS (SELECT host, n, k, a / (a + b) + {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS high FROM h1)
SELECT page_id, p.host, path, {_sql_case(lambda r: r[1])} AS rule,
       coalesce({_sql_case(lambda r: r[0])}, CASE WHEN round(high, 9) < {MIN_GOOD} THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(n AS BIGINT) AS n_labelled, CAST(k AS BIGINT) AS n_good
FROM p JOIN h2 ON p.host = h2.host
"""
