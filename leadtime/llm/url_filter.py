"""URL filter: host and path rules, then empirical-Bayes reputation of hosts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: (verdict, host, path prefix)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


#: Hosts that can have a share of one in FREQUENT of the pages or more.
FREQUENT = 1000


@dataclass(frozen=True)
class Reputation:
    """A host is blocked when the lower posterior bound of its rate of bad pages, mean - z * sd, exceeds ``limit``."""

    limit: float = 0.5
    z: float = 1.645


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' for null or no '://'."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to '?', '#' or the end; '' for null or no '://'."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null where none does."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        hit = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        fits = F.when(hit, F.struct(F.lit(rule_host + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def _precision(groups: DataFrame, parent: Column) -> float:
    """The beta prior's weight in pseudo-counts, by moments.

    For beta-binomial groups E[n (p - m)^2 / (m (1 - m))] = 1 + (n - 1) rho, and the weight is 1 / rho - 1.
    """
    q = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - parent, 2) / (parent * (1 - parent)))
    rho = (q - F.count(F.lit(1))) / F.greatest(F.sum(F.col("n") - 1), F.lit(1))
    held = F.least(F.greatest(F.coalesce(rho, F.lit(0.01)), F.lit(0.001)), F.lit(0.99))
    return groups.agg((1 / held - 1).alias("w")).first()["w"]


def host_levels(host: Column) -> tuple[Column, Column]:
    """Registered domain (last two labels) and suffix (last label)."""
    return F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


@dataclass(frozen=True)
class Levels:
    """Outcomes shrunk level by level: ``hosts`` (host, n, bad), ``domains`` (domain, m2), ``suffixes`` (suffix, m1), corpus mean and host weight."""

    hosts: DataFrame
    domains: DataFrame
    suffixes: DataFrame
    mean: float
    weight: float


def host_reputation(outcomes: DataFrame) -> Levels:
    """Posterior means of every level above the hosts from labelled outcomes (host, bad in {0,1}).

    The corpus rate is the suffixes' prior mean, a suffix's posterior mean that of its domains', a domain's
    that of its hosts'; each level's weight comes from the spread of its own groups. Outcomes with a null
    host or label do not count. Everything is a grouped sum with map-side combination: a hot host costs no more than a rare one;
    the table of hosts is written once and what passes the driver is one number a level.
    """
    known = outcomes.filter(F.col("host").isNotNull() & F.col("bad").isNotNull())
    domain, suffix = host_levels(F.col("host"))
    hosts = known.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    hosts = materialize(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = materialize(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    mean = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("m")).first()["m"]
    shrunk = lambda weight, prior: (F.col("bad") + weight * prior) / (F.col("n") + weight)
    w0 = _precision(suffixes, F.lit(mean))
    suffixes = suffixes.select("suffix", shrunk(w0, mean).alias("m1"))
    domains = domains.join(suffixes, "suffix")
    w1 = _precision(domains, F.col("m1"))
    domains = materialize(domains.select("domain", shrunk(w1, F.col("m1")).alias("m2")), "domains")
    w2 = _precision(hosts.join(domains, "domain"), F.col("m2"))
    return Levels(hosts.select("host", "n", "bad"), domains, suffixes, mean, w2)


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, settings: Reputation = Reputation()) -> DataFrame:
    """Judge every url: the longest rule that fits, else the reputation of its host.

    ``pages``: page_id, url; ``outcomes``: host, bad. Returns page_id, host, path, rule, verdict, bad_rate and bad_bound
    (posterior mean and lower bound, 6 places), one row per input row. Null urls and urls without '://' have
    empty host and path and are judged as the host ''. A host without outcomes takes its domain's posterior as prior, else
    the suffix's, else the corpus's. A page whose bound equals the limit is allowed; repeated pages have a row each; no pages give no rows; other columns
    of ``pages`` are not read.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = host_reputation(outcomes)
    domain, suffix = host_levels(F.col("host"))
    distinct = urls.groupBy("host").agg(F.count(F.lit(1)).alias("rows")).withColumns({"domain": domain, "suffix": suffix})
    prior = F.coalesce(F.col("d.m2"), F.col("s.m1"), F.lit(known.mean))
    n, bad = F.coalesce(F.col("h.n"), F.lit(0)), F.coalesce(F.col("h.bad"), F.lit(0))
    a, b = bad + known.weight * prior, n - bad + known.weight * (1 - prior)
    judged = (
        distinct.alias("u")
        .join(known.hosts.alias("h"), F.col("u.host") == F.col("h.host"), "left")
        .join(known.domains.alias("d"), F.col("u.domain") == F.col("d.domain"), "left")
        .join(known.suffixes.alias("s"), F.col("u.suffix") == F.col("s.suffix"), "left")
        .select(F.col("u.host").alias("host"), "rows", (a / (a + b)).alias("mean"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("sd"))
        .select(F.col("host").alias("__host"), "rows", F.round("mean", 6).alias("bad_rate"), F.round(F.col("mean") - settings.z * F.col("sd"), 6).alias("bad_bound"))
    )
    judged = materialize(judged, "judged")
    total = judged.agg(F.sum("rows")).first()[0] or 0
    # at most FREQUENT hosts have so many rows: they are broadcast, and their urls spread over all tasks of the join
    frequent = judged.filter(F.col("rows") * FREQUENT >= total).select("__host", F.col("bad_rate").alias("__rate"), F.col("bad_bound").alias("__bound"))
    ruled = urls.withColumn("__rule", rule_for(F.col("host"), F.col("path"), rules))
    ruled = ruled.join(F.broadcast(frequent), F.col("host") == F.col("__host"), "left").drop("__host")
    ruled = ruled.withColumn("__key", F.when(F.col("__bound").isNull(), F.col("host")).otherwise(F.concat(F.lit("\0"), F.xxhash64("page_id", "path").cast("string"))))
    rest = judged.join(frequent.select("__host"), "__host", "left_anti").select("__host", F.col("bad_rate").alias("__rate2"), F.col("bad_bound").alias("__bound2"))
    ruled = ruled.join(rest, F.col("__key") == F.col("__host"), "left").withColumns({"bad_rate": F.coalesce("__rate", "__rate2"), "bad_bound": F.coalesce("__bound", "__bound2")})
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("bad_bound") > settings.limit, "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), "bad_rate", "bad_bound")


def outcomes_from_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of the pages whose path names a labelled document, as in /en/4711; bad is quality 0."""
    doc = F.regexp_extract(path_of(F.col("url")), r"^/[a-z]+/(\d{1,18})(?:\D|$)", 1)
    named = pages.select(host_of(F.col("url")).alias("host"), F.nullif(doc, F.lit("")).cast("long").alias("doc_id"))
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return named.join(marks, "doc_id").select("host", (1 - F.col("quality")).cast("long").alias("bad"))


def oracle_sql(rules=RULES, settings: Reputation = Reputation()) -> str:
    """The same verdicts in DuckDB SQL over ``pages`` and ``labels``."""
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}|{v}'"
        for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    )
    rate = lambda m: f"least(greatest(coalesce((sum(n * pow(bad / n - {m}, 2) / ({m} * (1 - {m}))) - count(*)) / greatest(sum(n - 1), 1), 0.01), 0.001), 0.99)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{upper}', '{lower}') AS host,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
o AS (SELECT host, (1 - quality)::DOUBLE AS bad FROM (SELECT host, try_cast(nullif(regexp_extract(path, '^/[a-z]+/(\d{{1,18}})(?:\D|$)', 1), '') AS BIGINT) AS doc_id FROM u) JOIN q USING (doc_id)),
h AS (SELECT host, count(*)::DOUBLE AS n, sum(bad) AS bad, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS dom, string_split(host, '.')[-1] AS suf FROM o GROUP BY host),
d AS (SELECT dom, suf, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2),
s AS (SELECT suf, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY 1),
c AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS m0 FROM s),
w0 AS (SELECT 1 / {rate('m0')} - 1 AS w0 FROM s, c),
s1 AS (SELECT suf, (bad + w0 * m0) / (n + w0) AS m1 FROM s, c, w0),
d1 AS (SELECT dom, n, bad, m1 FROM d JOIN s1 USING (suf)),
w1 AS (SELECT 1 / {rate('m1')} - 1 AS w1 FROM d1),
d2 AS (SELECT dom, (bad + w1 * m1) / (n + w1) AS m2 FROM d1, w1),
h2 AS (SELECT host, n, bad, m2 FROM h JOIN d2 USING (dom)),
w2 AS (SELECT 1 / {rate('m2')} - 1 AS w2 FROM h2),
x AS (SELECT u.page_id, u.host, u.path, coalesce(h2.bad, 0) + w2 * coalesce(d2.m2, s1.m1, m0) AS a,
             coalesce(h2.n - h2.bad, 0) + w2 * (1 - coalesce(d2.m2, s1.m1, m0)) AS b
      FROM u CROSS JOIN c CROSS JOIN w2 LEFT JOIN h2 ON u.host = h2.host
      LEFT JOIN d2 ON array_to_string(list_slice(string_split(u.host, '.'), -2, -1), '.') = d2.dom LEFT JOIN s1 ON string_split(u.host, '.')[-1] = s1.suf),
y AS (SELECT page_id, host, path, CASE {fits} END AS hit, round(a / (a + b), 6) AS bad_rate,
             round(a / (a + b) - {settings.z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6) AS bad_bound FROM x)
SELECT page_id, host, path, string_split(hit, '|')[1] AS rule,
       coalesce(string_split(hit, '|')[2], CASE WHEN bad_bound > {settings.limit} THEN 'block' ELSE 'allow' END) AS verdict, bad_rate, bad_bound FROM y"""
