"""URL filters by empirical-Bayes reputation of hosts, with explicit rules on top.

Every labelled page is an outcome, bad or not. The share of bad pages of a host is a
beta-binomial whose prior comes from its registered domain, whose prior comes from its
suffix, whose prior comes from all outcomes. How strongly a level is held to the one
above follows from the data: the moment estimate of the correlation within its groups.
A host is blocked where the lower posterior bound of its share lies above ``worst``, so
a host is never blocked for lack of outcomes. Rules (host and path) come before that.

A page's outcome is that of the labelled document whose text its article carries, found
by a hash of the letters and digits of both; pages are counted per (host, hash) before
anything moves, and what comes back is one row a host.

Defined results: a null url, or one without ``://``, has an empty host and path and is
judged like any other host; a null or empty html has no outcome; labels of one text are
bad if one of them is; labels without id or without a value say nothing; repeated pages
are pages; an empty table of labels blocks nothing; other columns are ignored.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roostline.session import stored

# Rules as (verdict, host, path), and second-level names under country suffixes.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
REGISTRY_NAMES = ("ac", "co", "com", "edu", "gov", "net", "or", "org")
# A host is blocked if its share of bad pages exceeds WORST with a probability of 1 - TAIL.
WORST = 0.5
TAIL = 0.05
# Posteriors are added up on so many points, over so many standard deviations to each side.
POINTS = 512
DEVIATIONS = 9.0
# Within-group correlations outside these are taken as the nearer one: a prior never outweighs a
# hundred pages of a host, however alike the hosts are.
RHO = (0.01, 0.5)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(text, pattern, 2)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The name and the verdict of the longest rule that fits; null if none does.

    The rules become one expression, so they are meant to be some hundreds at most.
    """
    name = verdict = F.lit(None).cast("string")
    for said, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host without user and port; an address is its own."""
    site = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")
    parts = F.split(site, r"\.")
    n = F.size(parts)
    named = F.get(parts, n - 2).isin(*REGISTRY_NAMES) & (F.char_length(F.get(parts, n - 1)) == 2)
    width = F.when(named & (n > 1), 2).otherwise(1)
    alone = (n <= 1) | site.rlike(r"^[0-9.]+$|^\[")
    last = lambda k: F.array_join(F.slice(parts, F.greatest(n - k + 1, F.lit(1)), k), ".")
    return F.when(alone, site).otherwise(last(width + 1)), F.when(alone, site).otherwise(last(width))


def letters_key(text: Column) -> Column:
    """A 128-bit key of the letters and digits of a text; null if there are none."""
    bare = F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("h1"), F.xxhash64(bare, F.lit(1)).alias("h2")))


def article_text(html: Column) -> Column:
    """What an ``<article>`` holds after its heading, without tags and character references."""
    inner = F.regexp_extract(html, r"(?s)<article[^>]*>(.*)</article>", 1)
    return F.regexp_replace(F.regexp_replace(inner, r"(?s)^\s*<h1.*?</h1>|<[^>]*>", ""), r"&#?\w+;", "")


def text_outcomes(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, bad) per text that a label says something about."""
    said = F.coalesce((F.col("quality") == 0).cast("int"), F.lit(0)), F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))
    marked = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id").agg(F.max(F.greatest(*said)).alias("bad"))
    keys = documents.select("doc_id", letters_key(F.col("text")).alias("key")).where("key IS NOT NULL")
    return keys.join(marked, "doc_id").groupBy("key").agg(F.max("bad").alias("bad"))


def host_outcomes(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, n, bad): labelled and bad pages of every host of ``pages``, none left out."""
    pages = pages.select(url_parts(F.col("url"))[0].alias("host"), letters_key(article_text(F.col("html"))).alias("key"))
    copies = pages.groupBy("host", "key").agg(F.count("*").alias("pages"))
    found = copies.join(outcomes, "key", "left")
    return found.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("bad").isNotNull(), F.col("pages"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("bad") * F.col("pages")), F.lit(0)).alias("bad"),
    )


class Level(NamedTuple):
    """Groups of one level with the prior mean each takes from above, and how strong it is."""

    groups: DataFrame
    strength: float


def _strength(groups: DataFrame) -> float:
    """Pseudo-observations of the level's prior, by moments around the means from above."""
    spread = F.col("mean") * (1 - F.col("mean"))
    excess = F.pow(F.col("bad") - F.col("n") * F.col("mean"), 2) - F.col("n") * spread
    pairs = F.col("n") * (F.col("n") - 1) * spread
    sums = groups.agg(F.sum(excess).alias("excess"), F.sum(pairs).alias("pairs")).first()
    rho = sums["excess"] / sums["pairs"] if sums["pairs"] else RHO[0]
    return 1 / min(max(rho, RHO[0]), RHO[1]) - 1


def shrunk(hosts: DataFrame) -> Level:
    """``hosts`` (host, n, bad) with the prior mean of its domain, through suffix and root."""
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    root = ((total["bad"] or 0) + 1) / ((total["n"] or 0) + 2)
    domains = stored(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")

    def posterior(strength: float) -> Column:
        return (F.col("bad") + strength * F.col("mean")) / (F.col("n") + strength)

    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("mean", F.lit(root))
    above = suffixes.select("suffix", posterior(_strength(suffixes)).alias("mean"))
    domains = domains.join(above, "suffix")
    above = domains.select("domain", posterior(_strength(domains)).alias("mean"))
    hosts = hosts.join(above, "domain")
    return Level(hosts, _strength(hosts))


def lower_bound(a: Column, b: Column, tail: float = TAIL) -> Column:
    """The ``tail`` quantile of Beta(a, b), added up over the logit of the share."""
    deviation = F.sqrt(1 / a + 1 / (a * a) + 1 / b + 1 / (b * b))
    mode = F.log(a / b)
    step = deviation * (2 * DEVIATIONS / POINTS)

    def at(i: Column) -> Column:
        return mode + step * (i - POINTS // 2)

    def density(z: Column) -> Column:
        return -a * F.log1p(F.exp(-z)) - b * F.log1p(F.exp(z))

    points = F.sequence(F.lit(0), F.lit(POINTS))
    weights = F.transform(points, lambda i: F.exp(density(at(i)) - density(mode)))
    # The limit travels with the sum, so that it is worked out once.
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("below"), (tail * F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)).alias("limit"))

    def add(s: Column, w: Column) -> Column:
        run = s["sum"] + w
        return F.struct(run.alias("sum"), (s["below"] + (run <= s["limit"]).cast("int")).alias("below"), s["limit"].alias("limit"))

    reached = F.aggregate(weights, start, add)
    return 1 / (1 + F.exp(-at(reached["below"])))


def reputations(pages: DataFrame, outcomes: DataFrame, worst: float = WORST, tail: float = TAIL) -> DataFrame:
    """(host, n, bad, share, bound, blocked) of every host."""
    hosts, strength = shrunk(stored(host_outcomes(pages, outcomes), "hosts"))
    a = F.col("bad") + strength * F.col("mean")
    b = F.col("n") - F.col("bad") + strength * (1 - F.col("mean"))
    # The posterior is added up once per kind of host, not once per host.
    kinds = hosts.select("n", "bad", "mean").distinct().select("n", "bad", "mean", (a / (a + b)).alias("share"), lower_bound(a, b, tail).alias("bound"))
    return hosts.join(kinds, ["n", "bad", "mean"]).select("host", "n", "bad", "share", "bound", (F.col("bound") > worst).alias("blocked"))


def judged(pages: DataFrame, reputation: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    Only the blocked hosts are looked up; Spark broadcasts them where their stored size
    allows it, and splits a hot host where it does not.
    """
    host, path = url_parts(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    pages = pages.select("*", rule.alias("rule"), said.alias("said"))
    blocked = stored(reputation.where("blocked").select("host", F.lit("block").alias("method")), "blocked")
    return pages.join(blocked, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("said", "method", F.lit("allow")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every page's url judged by rules, then by the reputation of its host."""
    pages, documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "documents", "labels"))
    outcomes = text_outcomes(documents, labels)
    return judged(pages, reputations(pages.select("url", "html"), outcomes))


SQL = r"""
WITH urls AS (
  SELECT page_id, html,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), texts AS (
  SELECT d.doc_id, regexp_replace(d.text, '[^\p{L}\p{N}]+', '', 'g') AS bare FROM documents d
), outcomes AS (
  SELECT bare, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM texts JOIN labels USING (doc_id) WHERE bare <> '' AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY bare
), bodies AS (
  SELECT host, regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1),
           '(?s)^\s*<h1.*?</h1>|<[^>]*>', '', 'g'), '&#?\w+;', '', 'g'), '[^\p{L}\p{N}]+', '', 'g') AS bare
  FROM urls
), hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
         regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:[0-9]*)?$', '') AS site
  FROM bodies LEFT JOIN outcomes USING (bare) GROUP BY host
), split AS (
  SELECT *, string_split(site, '.') AS parts, len(string_split(site, '.')) AS k,
         len(string_split(site, '.')) <= 1 OR regexp_matches(site, '^[0-9.]+$|^\[') AS alone FROM hosts
), width AS (
  SELECT *, CASE WHEN k > 1 AND parts[k - 1] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'or', 'org') AND length(parts[k]) = 2 THEN 2 ELSE 1 END AS w FROM split
), named AS (
  SELECT host, n, bad, CASE WHEN alone THEN site ELSE array_to_string(parts[greatest(k - w, 1):k], '.') END AS domain,
         CASE WHEN alone THEN site ELSE array_to_string(parts[greatest(k - w + 1, 1):k], '.') END AS suffix
  FROM width
), s0 AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM named) AS mean FROM named GROUP BY suffix
), sk AS (
  SELECT 1 / least(greatest(coalesce(sum((bad - n * mean) ** 2 - n * mean * (1 - mean)) / nullif(sum(n * (n - 1) * mean * (1 - mean)), 0), 0.01), 0.01), 0.5) - 1 AS strength FROM s0
), d0 AS (
  SELECT domain, sum(named.n) AS n, sum(named.bad) AS bad, any_value((s0.bad + strength * mean) / (s0.n + strength)) AS mean
  FROM named JOIN s0 USING (suffix), sk GROUP BY domain
), dk AS (
  SELECT 1 / least(greatest(coalesce(sum((bad - n * mean) ** 2 - n * mean * (1 - mean)) / nullif(sum(n * (n - 1) * mean * (1 - mean)), 0), 0.01), 0.01), 0.5) - 1 AS strength FROM d0
), h0 AS (
  SELECT host, named.n, named.bad, (d0.bad + strength * mean) / (d0.n + strength) AS mean FROM named JOIN d0 USING (domain), dk
), hk AS (
  SELECT 1 / least(greatest(coalesce(sum((bad - n * mean) ** 2 - n * mean * (1 - mean)) / nullif(sum(n * (n - 1) * mean * (1 - mean)), 0), 0.01), 0.01), 0.5) - 1 AS strength FROM h0
), beta AS (
  SELECT host, bad + strength * mean AS a, n - bad + strength * (1 - mean) AS b FROM h0, hk
), grid AS (
  SELECT host, i, a, b, ln(a / b) + sqrt(1 / a + 1 / (a * a) + 1 / b + 1 / (b * b)) * (18.0 / 512) * (i - 256) AS z FROM beta, range(0, 513) AS r(i)
), weights AS (
  SELECT host, i, z, exp(-a * ln(1 + exp(-z)) - b * ln(1 + exp(z)) + a * ln(1 + b / a) + b * ln(1 + a / b)) AS w FROM grid
), sums AS (
  SELECT host, i, z, sum(w) OVER (PARTITION BY host ORDER BY i) AS run, sum(w) OVER (PARTITION BY host) AS total FROM weights
), bound AS (
  SELECT host, 1 / (1 + exp(-min(z) FILTER (WHERE run > 0.05 * total))) AS bound FROM sums GROUP BY host
), ruled AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM urls
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled JOIN bound USING (host)
"""
