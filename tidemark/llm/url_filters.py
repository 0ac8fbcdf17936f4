"""URL filters: pattern rules, each indexed by the rarest of its literal tokens.

A rule has a host suffix and a path prefix (either may be empty), a regular expression that the whole URL must match
somewhere (or null), and an action. Tokens are the runs of [a-z0-9] in the lower-cased URL. Each rule is filed under
the one of its tokens that the fewest URLs have; a URL's tokens fetch the rules filed under them, and only for these are
host, path and regular expression tried. So a rule's literal tokens must be whole tokens of every URL that it fits, as
host and path are; a pattern of the default list has a sign beside each of its literals. Rules without a token would need to be tried on every URL and are refused.

Of the rules that fit, those with host or path go before those with a pattern alone; then the longest host and path
wins, then the longest pattern, then the smallest rule. With none, the URL is allowed. A null or empty URL, or one
without "://", has empty host and path; its tokens are looked up all the same. Rows are judged one by one, so repeated
rows and ids are kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW_ID, table, with_row_id

RULES_SCHEMA = "rule string, host string, path string, pattern string, literal string, action string"
#: A list of so many rules at most is broadcast; at 300 bytes a rule it is under 30 MB. A longer one is joined by shuffle.
BROADCAST_RULES = 100_000

#: (host, path, action), as the task fixes them.
HOST_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: (pattern, literals that it needs, action).
PATTERN_RULES = (
    (r"://([^/?#]*\.)?casino-[a-z]+\.", "casino", "block"),
    (r"://([^/?#]*\.)?(free|best)-bets\.", "bets", "block"),
    (r"://([^/?#]*\.)?cheap-pills\.", "cheap pills", "block"),
    (r"://([^/?#]*\.)?adult-[a-z0-9]+\.", "adult", "block"),
    (r"://([^/?#]*\.)?ads-track\.", "ads track", "block"),
    (r"://([^/?#]*[.-])?spam(-[a-z0-9-]*)?\.", "spam", "block"),
)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule list of any length: JSON lines with the columns of RULES_SCHEMA; host and path may be left out."""
    return spark.read.schema(RULES_SCHEMA).json(path).fillna("", ["host", "path"])


def default_rules(spark: SparkSession) -> DataFrame:
    rows = [(h + p, h, p, None, f"{h}{p}", a) for h, p, a in HOST_RULES] + [(x, "", "", x, lit, a) for x, lit, a in PATTERN_RULES]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or end, with A-Z lower-cased; null or without "://": empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host, up to "?", "#" or end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.filter(F.split(lower, "[^a-z0-9]+"), lambda x: x != ""))


def index_rules(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """rules with `token`, the rarest of their tokens among all urls (ties: the longest, then the smallest)."""
    of_rules = rules.select("rule", F.explode_outer(tokens_of(F.col("literal"))).alias("token"))
    if of_rules.filter("token is null").limit(1).count():
        raise ValueError("a rule needs a literal token of letters or digits")
    wanted = of_rules.select("token").distinct()
    counts = urls.select(F.explode(tokens_of(F.col("url"))).alias("token")).join(F.broadcast(wanted) if _few(rules) else wanted, "token").groupBy("token").count()
    rarest = of_rules.join(counts, "token", "left").groupBy("rule").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), (-F.length("token")).alias("l"), "token")).alias("s"))
    return rules.join(rarest.select("rule", F.col("s.token").alias("token")), "rule")


def _few(rules: DataFrame) -> bool:
    return rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (page_id, url) -> page_id, host, path, rule, verdict, pattern, n_candidates."""
    index = index_rules(rules, pages).select("token", F.struct("rule", "host", "path", "pattern", "action").alias("r"))
    urls = with_row_id(pages.select("page_id", "url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    tried = urls.withColumn("token", F.explode_outer(tokens_of(F.col("url")))).join(F.broadcast(index) if _few(rules) else index, "token", "left")
    h, p, r = F.col("host"), F.col("path"), F.col("r")
    fits = (
        ((r.host == "") | (h == r.host) | h.endswith(F.concat(F.lit("."), r.host)))
        & p.startswith(r.path)
        & (r.pattern.isNull() | F.coalesce(F.regexp(F.lower("url"), r.pattern), F.lit(False)))
    )
    own = r.pattern.isNull()
    rank = F.struct(own.alias("own"), (F.length(r.host) + F.length(r.path)).alias("l"), F.length(r.pattern).alias("pl"), r.alias("r"))
    best = tried.groupBy(ROW_ID, "page_id", "host", "path").agg(
        F.max(F.when(fits, rank)).alias("b"), F.count("r").alias("n_candidates"))
    b = F.col("b")
    return best.select(
        "page_id", "host", "path", F.when(b.own, b.r.rule).alias("rule"), F.coalesce(b.r.action, F.lit("allow")).alias("verdict"),
        F.when(~b.own, b.r.rule).alias("pattern"), "n_candidates",
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), default_rules(spark)).select("page_id", "host", "path", "rule", "verdict", "pattern")


def _sql() -> str:
    q = lambda s: "'" + re.sub("'", "''", s) + "'"
    hosts = ", ".join(f"({q(h + p)}, {q(h)}, {q(p)}, {q(a)})" for h, p, a in HOST_RULES)
    blocked = "CASE " + " ".join(f"WHEN regexp_matches(lower(url), {q(x)}) THEN {q(x)}" for x, _, _ in sorted(PATTERN_RULES, key=lambda r: (-len(r[0]), r[0]))) + " END"
    return rf"""
WITH u AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
r(rule, rhost, rpath, action) AS (VALUES {hosts}),
m AS (SELECT u.*, (SELECT {{'l': length(rule), 'rule': rule, 'action': action}} FROM r
                   WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rule) DESC, rule LIMIT 1) AS b,
             {blocked} AS x FROM u)
SELECT page_id, host, path, b.rule AS rule, CASE WHEN b IS NOT NULL THEN b.action WHEN x IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN b IS NULL THEN x END AS pattern FROM m
"""


SQL = _sql()
