"""URL filter: host-suffix and path-prefix expressions, joined on short hash prefixes.

A url is expanded into (host suffix + path prefix) expressions, in the manner
of published safe-browsing lists; the expressions meet the rules on the first
eight hex digits of their SHA-256, the full digest confirms, and the longest
rule wins. Only column expressions are used.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict): the rules of the fixed contract.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
DEFAULT_VERDICT = "allow"
HASH_PREFIX = 8


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """Add host, path, rule and verdict to every page.

    ``rules`` has host, path (empty or from its slash on) and verdict. A rule
    fits its host and all subdomains if the path starts with the rule's; the
    longest ``host + path`` wins (then the longer host; one expression with two
    verdicts counts as block). Pages that no rule fits get a null rule and
    ``default``. Null urls and urls without ``://`` have empty host and path.
    Repeated pages and further columns stay; columns named like the added ones
    are refused. Distinct (host, path) pairs are judged once, so a url that
    fills a third of the table is expanded once. Which suffixes and prefixes
    are tried follows from the rules (their most labels, their path lengths).
    """
    if clash := {"host", "path", "rule", "verdict"} & set(pages.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    shape = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    placed = pages.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    if not shape.lengths:
        return placed.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))

    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(shape.labels))),
        lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."),
    )
    lengths = F.filter(F.array(*[F.lit(int(n)) for n in shape.lengths]), lambda n: n <= F.length("path"))
    prefixes = F.transform(lengths, lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    tried = (
        placed.select("host", "path")
        .filter("host <> ''")
        .distinct()
        .withColumn("x", F.explode(expressions))
        .select(F.col("host").alias("u_host"), F.col("path").alias("u_path"), F.sha2(F.concat("x.h", "x.p"), 256).alias("digest"))
        .withColumn("short", F.substring("digest", 1, HASH_PREFIX))
    )
    known = rules.select(
        F.concat("host", "path").alias("r_rule"),
        F.length("host").alias("r_host"),
        (F.col("verdict") == "block").alias("r_block"),
        F.col("verdict").alias("r_verdict"),
        F.sha2(F.concat("host", "path"), 256).alias("r_digest"),
    ).withColumn("r_short", F.substring("r_digest", 1, HASH_PREFIX))
    best = F.max(F.struct(F.length("r_rule"), "r_host", "r_block", "r_rule", "r_verdict")).alias("best")
    judged = tried.join(known, F.col("short") == F.col("r_short")).filter("digest = r_digest").groupBy("u_host", "u_path").agg(best)
    joined = placed.join(judged, (placed.host == judged.u_host) & (placed.path == judged.u_path), "left")
    return joined.select(*placed.columns, F.col("best.r_rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))
