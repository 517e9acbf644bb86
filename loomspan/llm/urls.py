"""Operator 8 [native]: url filtering with rules indexed by their rarest literal token.

A rule is a host rule (``example.net/en/``: the host and all its subdomains, paths that start so) or a pattern (a regular
expression with the literal tokens that any url it fits must hold as whole tokens). Rules are filed under the one of their
tokens that is rarest among the urls. A url's tokens fetch the rules filed there, and only those are tried. Patterns that
may fit inside longer tokens have no such token; they are tried on every url, before its tokens are dealt. The longest host rule
that fits decides; if none does, the first pattern in the order of its name; else the url is allowed.

Spark broadcasts the index only while it is below its own size limit and joins by token otherwise. After the trial each
url is one row again before anything is shuffled, so a host or token of any frequency costs no more than others.

Nulls: a null url, or one without ``://``, has an empty host and path; no host rule fits it; a null url is allowed.
Repeated rows are each judged; an empty table gives no rows; columns not named here are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import table

#: The rules of the query, (verdict, rule).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Default patterns: (name, whole literal tokens or none, regular expression of the part that any Java or RE2 engine reads alike).
PATTERNS = [("casino", ["casino"], "(?i)[/.-]casino[/.-]"), ("cheap-pills", [], "(?i)cheap-pills"), ("spam-farm", [], "(?i)spam-farm")]

RULE_SCHEMA = "rule string, verdict string, host string, path string, pattern string, tokens array<string>"


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(url), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def rule_rows(spark: SparkSession, rules=RULES, patterns=PATTERNS) -> DataFrame:
    rows = []
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        # the last token of a path that ends inside a segment need not be a whole token of a url
        whole = re.sub(r"[^\W_]+$", "", p)
        rows.append((rule, verdict, h.lower(), f"/{p}", None, [t for t in re.split(r"[\W_]+", f"{h}/{whole}".lower()) if t]))
    rows += [(name, "block", None, None, pattern, [t.lower() for t in literal]) for name, literal, pattern in patterns]
    if any(not r[-1] and r[4] is None for r in rows):
        raise ValueError("a host rule needs a literal token")
    return spark.createDataFrame(rows, RULE_SCHEMA)


def index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """``rules`` with the column token: the rule's token that the fewest of ``urls`` (url) hold."""
    each = rules.select("*", F.explode("tokens").alias("token"))
    seen = urls.select(F.explode(tokens(F.col("url"))).alias("token")).join(each.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    ranked = each.join(seen, "token", "left").groupBy("rule", "verdict", "host", "path", "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).token.alias("token"))
    return ranked.withColumnsRenamed({"host": "r_host", "path": "r_path"})


def judge(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """One row for each of ``urls`` (key, url): key, host, path, rule, pattern, verdict."""
    rows = urls.select("key", "url", F.monotonically_increasing_id().alias("_row"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    fits = F.filter("_loose", lambda r: F.call_function("regexp_like", F.col("url"), r.pattern))
    loose = rules.where(F.size("tokens") == 0).agg(F.collect_list(F.struct("rule", "verdict", "pattern")).alias("_loose"))
    rows = rows.crossJoin(F.broadcast(loose)).withColumn("_loose", F.array_min(F.transform(fits, lambda r: F.struct(r.rule.alias("rule"), r.verdict.alias("verdict")))))
    tried = rows.withColumn("token", F.explode_outer(tokens(F.col("url")))).join(index(rules, urls), "token", "left")
    fits_host = F.col("pattern").isNull() & ((F.col("host") == F.col("r_host")) | F.endswith(F.col("host"), F.concat(F.lit("."), F.col("r_host")))) & F.startswith(F.col("path"), F.col("r_path"))
    fits_pattern = F.when(F.col("pattern").isNotNull(), F.expr("regexp_like(url, pattern)"))
    size = F.length("r_host") + F.length("r_path")
    found = tried.groupBy("_row").agg(
        F.first("key").alias("key"),
        F.first("host").alias("host"),
        F.first("path").alias("path"),
        F.max(F.when(fits_host, F.struct(size.alias("size"), "verdict", "rule"))).alias("best"),
        F.least(F.min(F.when(fits_pattern, F.struct("rule", "verdict"))), F.first("_loose")).alias("other"),
    )
    return found.select("key", "host", "path", F.col("best.rule").alias("rule"), F.col("other.rule").alias("pattern"), F.coalesce("best.verdict", "other.verdict", F.lit("allow")).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), "url")
    return judge(pages, rule_rows(spark)).withColumnRenamed("key", "page_id")


ORACLE = r"""
WITH p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
s AS (SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
r AS (SELECT *, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
  CASE WHEN regexp_matches(url, '(?i)[/.-]casino[/.-]') THEN 'casino' WHEN regexp_matches(url, '(?i)cheap-pills') THEN 'cheap-pills' WHEN regexp_matches(url, '(?i)spam-farm') THEN 'spam-farm' END AS pattern FROM s)
SELECT page_id, host, path, rule, pattern, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
