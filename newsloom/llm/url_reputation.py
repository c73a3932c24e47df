"""URL filters: path rules, and an empirical-Bayes reputation of hosts. DataFrame operations only.

Labelled page outcomes (bad 0/1) are counted by host, registered domain and public suffix. Each level's rate is
shrunk towards its parent's by a beta prior: Beta(k m, k (1 - m)), where m is the parent's shrunk rate and the
strength k comes from the counts themselves (moments of the beta-binomial over the level's groups). A page is
blocked when the lower bound of its host's posterior, mean - z sd, exceeds `threshold`; hosts without labels take
their nearest labelled ancestor's rate, spread as widely as the host prior.

The public suffix is the last label, or the last two where a generic second level stands below a two-letter country
code (co.uk, com.au, gov.uk). The registered domain is one label more. An IPv4 host is its own domain, below the
suffix "ip"; user info and port don't count for either.

Defined cases: null or scheme-less urls have empty host and path, fit no rule and are judged by the overall rate;
null outcomes aren't counted; without any labels every page is allowed; where the moments say nothing of a level's
spread (all outcomes alike, one group, one page a group) its prior is as strong as priors may be, so its groups take
their parent's rate; repeated rows count as often as they stand; an empty table gives an empty one; columns of pages
named host, path, rule, verdict or bad_bound are replaced by the results, all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
THRESHOLD, Z = 0.5, 1.64
#: Second levels that are generic below a country code; parameter of the operator.
GENERIC = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "ltd", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch")
#: The hosts' table is broadcast up to so many rows; beyond it only hosts with more than a `HEAVY`-th of all pages are.
BROADCAST_HOSTS, HEAVY = 200_000, 1000
MIN_K, MAX_K = 1.0, 1000.0


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), common.UPPER, common.LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict): the longest rule whose host is the url's or a parent of it and whose path starts the url's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def levels_of(host: Column, generic=GENERIC) -> tuple[Column, Column]:
    """(registered domain, public suffix) of a host without its user info and port."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":[0-9]*$", "")
    ip = name.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    last, two = F.substring_index(name, ".", -1), F.substring_index(name, ".", -2)
    long = (F.length(last) == 2) & F.substring_index(two, ".", 1).isin(*generic) & (two != last)
    suffix = F.when(ip, "ip").when(long, two).otherwise(last)
    return F.when(ip, name).when(long, F.substring_index(name, ".", -3)).otherwise(two), suffix


def strength(groups: DataFrame) -> Column:
    """k of a beta prior over groups with columns n and bad, by the beta-binomial's moments; an aggregate column."""
    n, bad, k = F.sum("n"), F.sum("bad"), F.count(F.lit(1))
    rate = bad / n
    # sum of n (p - rate)^2 = sum of bad^2 / n - bad^2 / n over all
    spread = F.sum(F.col("bad") * F.col("bad") / F.col("n")) - bad * bad / n
    noise = rate * (1 - rate)
    within = F.try_divide(spread - noise * (k - 1), noise * (n - F.sum(F.col("n") * F.col("n")) / n - (k - 1)))
    raw = F.when(within > 0, 1 / within - 1)
    return F.greatest(F.lit(MIN_K), F.least(F.lit(MAX_K), F.coalesce(raw, F.lit(MAX_K))))


def reputations(labelled: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """From rows (host, bad): tables of hosts, domains, suffixes (key, rate, k) and the overall row (rate, k_s, k_d, k_h).

    Counting by host combines before the shuffle, and the upper levels are sums of the host counts: one pass over pages.
    """
    domain, suffix = levels_of(F.col("host"))
    hosts = labelled.filter(F.col("bad").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("bad").cast("double")).alias("bad"))
    hosts = common.settle(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = suffixes.agg((F.sum("bad") / F.sum("n")).alias("rate"), strength(suffixes).alias("k_s"))
    overall = overall.crossJoin(F.broadcast(domains.agg(strength(domains).alias("k_d")))).crossJoin(F.broadcast(hosts.agg(strength(hosts).alias("k_h"))))
    overall = common.settle(overall.withColumn("rate", F.coalesce("rate", F.lit(0.0))))  # one row
    one = F.broadcast(overall)
    s = suffixes.crossJoin(one).select("suffix", ((F.col("bad") + F.col("k_s") * F.col("rate")) / (F.col("n") + F.col("k_s"))).alias("s_rate"))
    d = domains.join(s, "suffix").crossJoin(one.select("k_d")).select("domain", ((F.col("bad") + F.col("k_d") * F.col("s_rate")) / (F.col("n") + F.col("k_d"))).alias("d_rate"))
    h = hosts.join(d, "domain").crossJoin(one.select("k_h")).select("host", (F.col("bad") + F.col("k_h") * F.col("d_rate")).alias("a"), (F.col("n") - F.col("bad") + F.col("k_h") * (1 - F.col("d_rate"))).alias("b"))
    return common.settle(h), common.settle(d), common.settle(s), overall


def judge(pages: DataFrame, labelled: DataFrame, *, url: str = "url", rules=RULES, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """pages with host, path, rule, verdict and bad_bound (the posterior's lower bound). labelled: (host, bad)."""
    hosts, domains, suffixes, overall = reputations(labelled)
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("_page"), host_of(F.col(url)).alias("_host"), path_of(F.col(url)).alias("_path"))
    domain, suffix = levels_of(F.col("host"))
    seen = rows.groupBy(F.col("_host").alias("host")).agg(F.count(F.lit(1)).alias("pages")).select("host", "pages", domain.alias("domain"), suffix.alias("suffix"))
    known = seen.join(hosts, "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left").crossJoin(F.broadcast(overall))
    up = F.coalesce("d_rate", "s_rate", "rate")
    a, b = F.coalesce("a", F.col("k_h") * up), F.coalesce("b", F.col("k_h") * (1 - up))
    mean = a / (a + b)
    bound = mean - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    scored = common.settle(known.select(F.col("host").alias("_h"), "pages", F.coalesce(bound, F.lit(0.0)).alias("_bound")))
    out = _with_bounds(rows, scored)
    rule, said = rule_of(F.col("_host"), F.col("_path"), rules)
    verdict = F.coalesce(said, F.when(F.col("_bound") > threshold, "block").otherwise("allow"))
    kept = [F.col(f"_page.`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict", "bad_bound")]
    return out.select(*kept, F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"), verdict.alias("verdict"), F.col("_bound").alias("bad_bound"))


def _with_bounds(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """rows and their host's bound. Few hosts are broadcast; of many, the hot ones are (at most `HEAVY` can have more
    than that share of the pages), so that no host's pages meet in one task, and the others join by key."""
    size = scored.agg(F.count(F.lit(1)), F.sum("pages")).first()
    if size[0] <= BROADCAST_HOSTS:
        return rows.join(F.broadcast(scored), rows["_host"] == scored["_h"])
    hot = F.broadcast(scored.filter(F.col("pages") * HEAVY > size[1]))
    rest = scored.filter(F.col("pages") * HEAVY <= size[1])
    there = F.col("_host") == F.col("_h")
    return rows.join(hot, there).unionByName(rows.join(hot, there, "left_anti").join(rest, there))


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every url of `pages`. Outcomes: row p of `labels` marks page p; quality 0 is a bad outcome."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    labels = common.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    labelled = pages.join(labels, "page_id").select(host_of(F.col("url")).alias("host"), "bad")
    return judge(pages, labelled).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = f"""
WITH p AS (SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{common.UPPER}', '{common.LOWER}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
q AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM p),
r AS (SELECT *, string_split(name, '.') AS parts FROM q),
l2 AS (SELECT *, regexp_matches(name, '^[0-9]+(\\.[0-9]+){{3}}$') AS ip, CASE WHEN len(parts) >= 2 THEN parts[len(parts) - 1] || '.' || parts[len(parts)] ELSE name END AS two,
    len(parts) >= 2 AND length(parts[len(parts)]) = 2 AND list_contains({list(GENERIC)}, parts[len(parts) - 1]) AS long FROM r),
l AS (SELECT page_id, host, path,
    CASE WHEN ip THEN name WHEN long AND len(parts) >= 3 THEN parts[len(parts) - 2] || '.' || two ELSE two END AS domain,
    CASE WHEN ip THEN 'ip' WHEN long THEN two ELSE parts[len(parts)] END AS suffix FROM l2),
h AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(1 - quality)::DOUBLE AS bad FROM l JOIN labels ON page_id = doc_id WHERE quality IS NOT NULL GROUP BY 1, 2, 3),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY 1),
m AS (SELECT lvl, sum(n) AS n, sum(bad) AS bad, count(*) AS k, sum(n * n) AS nn, sum(bad * bad / n) - sum(bad) * sum(bad) / sum(n) AS spread FROM
    (SELECT 'h' AS lvl, n, bad FROM h UNION ALL SELECT 'd', n, bad FROM d UNION ALL SELECT 's', n, bad FROM s) GROUP BY lvl),
w AS (SELECT lvl, (spread - bad / n * (1 - bad / n) * (k - 1)) / nullif(bad / n * (1 - bad / n) * (n - nn / n - (k - 1)), 0) AS within FROM m),
ks AS (SELECT lvl, greatest({MIN_K}, least({MAX_K}, coalesce(CASE WHEN within > 0 THEN 1 / within - 1 END, {MAX_K}))) AS k FROM w),
o AS (SELECT coalesce(sum(bad) / sum(n), 0) AS rate, (SELECT k FROM ks WHERE lvl = 's') AS k_s, (SELECT k FROM ks WHERE lvl = 'd') AS k_d, (SELECT k FROM ks WHERE lvl = 'h') AS k_h FROM s),
sr AS (SELECT suffix, (bad + k_s * rate) / (n + k_s) AS s_rate FROM s, o),
dr AS (SELECT domain, (bad + k_d * s_rate) / (n + k_d) AS d_rate FROM d JOIN sr USING (suffix), o),
hr AS (SELECT host, bad + k_h * d_rate AS a, n - bad + k_h * (1 - d_rate) AS b FROM h JOIN dr USING (domain), o),
ab AS (SELECT page_id, l.host, l.path, coalesce(a, k_h * coalesce(d_rate, s_rate, rate)) AS a, coalesce(b, k_h * (1 - coalesce(d_rate, s_rate, rate))) AS b
    FROM l LEFT JOIN hr ON l.host = hr.host LEFT JOIN dr ON l.domain = dr.domain LEFT JOIN sr ON l.suffix = sr.suffix, o),
ru AS (SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM ab)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN coalesce(a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0) > {THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict FROM ru
"""
