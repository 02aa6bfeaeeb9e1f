"""URL filters with redirect equivalence, in DataFrame operations only.

Rules name a host and a path prefix; the longest rule that fits a url decides it. Urls that
no rule fits take the decision of their aliases: urls and the targets of declared canonical
links and refresh redirects are the nodes of a graph whose connected components are
equivalent; a component with an allowed url is allowed, else one with a blocked url is blocked,
else the default holds. On request urls are also tied to their normal forms, which no page
declares; that is a guess, and off.

Defined results: null urls and urls without ``://`` have an empty host and path, no alias and
the default verdict; of equally long rules that fit one that allows wins, then the last by
name; repeated urls and rows share one decision; null or broken html declares nothing; html of
any length is searched whole; an empty table gives an empty result; other columns of the table
are not read, so they may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaline.llm.components import connected_components
from alphaline.llm.shared import lower_ascii

#: (verdict, host, path prefix)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEFAULT = "allow"
#: Rules are broadcast up to this number; more are joined by a shuffle.
MAX_BROADCAST_RULES = 100_000


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def normal_form(url: Column) -> Column:
    """Host without www. or m., path without index page, .html or closing slash, own parameters."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(/index)?\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    own = F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref)=")))
    return F.when(host != "", F.concat(F.lit("//"), host, path, F.lit("?"), F.array_join(own, "&")))


def declared_targets(html: Column, url: Column) -> Column:
    """The absolute targets of a page's canonical link and refresh redirect."""
    link = F.regexp_extract(html, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    meta = F.regexp_extract(html, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    found = F.array(F.regexp_extract(link, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1), F.regexp_extract(meta, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    origin = F.regexp_extract(url, r"^([^/?#]*://[^/?#]*)", 1)
    absolute = F.transform(found, lambda t: F.when(t.contains("://"), t).when(t.startswith("//"), F.concat(F.lit("https:"), t)).when(t.startswith("/"), F.concat(origin, t)))
    return F.filter(absolute, lambda t: t.isNotNull() & (t != ""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([*rules], "verdict string, rule_host string, rule_path string")


def decide(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(url, rule, verdict)`` for the distinct ``urls`` that some rule fits."""
    labels = F.split(F.col("host"), r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    parsed = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host != ''").withColumn("labels", labels)
    spread = parsed.select("url", "path", F.explode(suffixes).alias("rule_host"))
    small = F.broadcast(rules) if rules.count() <= MAX_BROADCAST_RULES else rules
    fitting = spread.join(small, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    named = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(named).alias("n"), (F.col("verdict") == "allow").alias("allows"), named.alias("rule"), F.col("verdict"))).alias("best")
    return fitting.groupBy("url").agg(best).select("url", "best.rule", "best.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, *, normal_forms: bool = False) -> DataFrame:
    """``(page_id, host, path, rule, verdict, inherited)`` for every row of ``pages``."""
    known = pages.where("url IS NOT NULL").select("url", declared_targets(F.coalesce("html", F.lit("")), F.col("url")).alias("targets"))
    links = known.where("size(targets) > 0").select(F.col("url").alias("a"), F.explode("targets").alias("b")).distinct()
    urls = known.select("url").distinct()
    every = urls.union(links.select(F.col("b").alias("url"))).distinct()
    if normal_forms:
        links = links.unionByName(every.select(F.col("url").alias("a"), normal_form(F.col("url")).alias("b")).where("b IS NOT NULL"))
    components = connected_components(links).withColumnRenamed("node", "url")
    decided = decide(every, rules)
    votes = decided.join(components, "url").groupBy("component").agg(F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked"))
    shared = components.join(votes, "component").select("url", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("alias_verdict"))
    answers = urls.join(decided, "url", "left").join(shared, "url", "left")
    joined = pages.select("page_id", "url").join(answers, "url", "left")
    return joined.select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        "rule",
        F.coalesce("verdict", "alias_verdict", F.lit(DEFAULT)).alias("verdict"),
        (F.col("verdict").isNull() & F.col("alias_verdict").isNotNull()).alias("inherited"),
    )


ORACLE = r"""
WITH RECURSIVE page AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
link AS (
  SELECT url AS a, t AS b FROM (
    SELECT url, unnest([
      regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
      regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0), '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS t0,
      regexp_extract(url, '^([^/?#]*://[^/?#]*)', 1) AS origin FROM page),
    LATERAL (SELECT CASE WHEN contains(t0, '://') THEN t0 WHEN starts_with(t0, '//') THEN 'https:' || t0 WHEN starts_with(t0, '/') THEN origin || t0 END AS t) WHERE t IS NOT NULL),
url AS (SELECT DISTINCT url FROM page WHERE url IS NOT NULL UNION SELECT b FROM link),
part AS (
  SELECT url, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM url)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT DISTINCT a AS node, a AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
rule(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (
  SELECT url, h || p AS rule, verdict
  FROM part JOIN rule ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY length(h || p) DESC, verdict, h || p DESC) = 1),
vote AS (SELECT r.node AS url, bool_or(verdict = 'allow') AS allowed FROM reach r JOIN best b ON b.url = r.other GROUP BY r.node)
SELECT g.page_id, coalesce(part.host, '') AS host, coalesce(part.path, '') AS path, b.rule,
  coalesce(b.verdict, CASE WHEN v.allowed THEN 'allow' WHEN NOT v.allowed THEN 'block' END, 'allow') AS verdict,
  b.verdict IS NULL AND v.allowed IS NOT NULL AS inherited
FROM page g LEFT JOIN part ON part.url = g.url LEFT JOIN best b ON b.url = g.url LEFT JOIN vote v ON v.url = g.url
"""
