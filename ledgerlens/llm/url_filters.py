"""URL filter: explicit rules, then empirical-Bayes host reputation.

Labelled outcomes (1 good, 0 bad) are counted by host. Beta-binomial priors
shrink them down a chain: all hosts, public suffix, registered domain, host.
The strength of each level's prior is fitted by the method of moments over that
level's groups. A host is blocked if the lower bound of its posterior bad rate
lies above ``max_bad``; a host without labels inherits its domain's posterior.

DataFrame expressions only. Hosts are counted before they are shuffled, and the
join back to the urls is a plain equi-join, which adaptive execution splits for
hot hosts; rules are joined with each host once, by its suffixes. Only four numbers
reach the driver.

Defined cases: a null url, or one without ``://``, has empty host and path and
is judged by the overall rate; labels of null outcome or null id count for
nothing; of several labels for one id the worst counts; repeated urls are judged
alike, each row once; no labels at all: everything is allowed but for rules; of
rules of one length a blocking one wins; extra columns, whatever their names, are
left out; long urls are judged whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, LOWER, lower_az, materialize, table

#: Fixed rules of the query: action, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Labels under which domains are registered below country codes, and
#: hosts whose subdomains belong to different owners.
SECOND_LABELS = "ac co com edu gob gov ltd mil ne net nom or org plc sch".split()
SHARED_HOSTS = "appspot.com blogspot.com github.io gitlab.io herokuapp.com netlify.app pages.dev tumblr.com vercel.app web.app weebly.com wixsite.com wordpress.com".split()


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    return lower_az(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rules(hosts: DataFrame, rules) -> DataFrame:
    """hosts(host), each once: (host, fits), the rules of the host and of all that it
    is below, as (length, blocks, rule, path, action). Any number of rules."""
    parts = [F.struct(F.lit(a).alias("action"), F.lit(h).alias("suffix"), F.lit(p).alias("path")) for a, h, p in rules]
    table = hosts.sparkSession.range(1).select(F.explode(F.array(*parts)).alias("r")).select("r.*") if parts else None
    if table is None:
        return hosts.select("host", F.array().cast("array<struct<length:int,blocks:boolean,rule:string,path:string,action:string>>").alias("fits"))
    labels = F.split("host", r"\.")
    below = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = hosts.select("host", F.explode(below).alias("suffix")).join(table, "suffix")
    rule = F.concat("suffix", "path")
    return found.groupBy("host").agg(F.collect_list(F.struct(F.length(rule).alias("length"), (F.col("action") == "block").alias("blocks"), rule.alias("rule"), "path", "action")).alias("fits"))


def registered(host: Column) -> Column:
    """The part of a host that was registered: below a suffix of one label, or of two
    under a country code, or below a shared host."""
    two, last = F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)
    long = (F.length(last) == 2) & F.substring_index(two, ".", 1).isin(*SECOND_LABELS) | two.isin(*SHARED_HOSTS)
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(two)


def suffix_of(domain: Column) -> Column:
    at = F.locate(".", domain)
    return F.when(at > 0, domain.substr(at + 1, F.length(domain))).otherwise(domain)


def _strength(groups: DataFrame, p: float, low: float = 2.0, high: float = 1000.0) -> float:
    """Prior strength of a level from the spread of its groups' rates."""
    n, k = F.col("n").cast("double"), F.col("k")
    r = groups.where("n > 0").agg(
        F.sum(n * F.pow(k / n - p, 2)).alias("s"), F.sum(n).alias("t"), F.sum(n * n).alias("q"), F.count("*").alias("g")
    ).first()
    if not r["g"] or r["g"] < 2:
        return high
    v = p * (1 - p)
    rho = (r["s"] - v * (r["g"] - 1)) / (v * (r["t"] - r["q"] / r["t"] - (r["g"] - 1)) or 1.0)
    return min(high, max(low, 1 / rho - 1)) if rho > 0 else high


def reputation(hosts: DataFrame, z: float = 2.0) -> DataFrame:
    """hosts(host, n, k bad): posterior mean and lower bound of the bad rate."""
    h = hosts.withColumn("domain", registered(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    domains = h.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    p = (total["k"] + 0.5) / (total["n"] + 1.0) if total["n"] else 0.0
    s_suffix, s_domain, s_host = (_strength(x, p) for x in (suffixes, domains, h))

    def shrunk(prior: Column, s: float) -> Column:
        return (F.col("k") + prior * s) / (F.col("n") + s)

    by_suffix = suffixes.select("suffix", shrunk(F.lit(p), s_suffix).alias("m_suffix"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", shrunk(F.col("m_suffix"), s_domain).alias("m_domain"))
    mean = shrunk(F.col("m_domain"), s_host)
    sd = F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("n") + s_host + 1))
    return h.join(by_domain, "domain").withColumn("bad_rate", mean).select("host", "n", "k", "bad_rate", (F.col("bad_rate") - z * sd).alias("bad_low"))


def judge(urls: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = 0.2, z: float = 2.0) -> DataFrame:
    """urls(page_id, url) and outcomes(page_id, good): host, path, rule, verdict."""
    host, path = host_and_path(F.col("url"))
    parsed = urls.select("page_id", host.alias("host"), path.alias("path"))
    worst = outcomes.where("page_id IS NOT NULL AND good IS NOT NULL").groupBy("page_id").agg(F.min("good").alias("good"))
    hosts = materialize(
        parsed.select("page_id", "host").join(worst, "page_id", "left").groupBy("host")
        .agg(F.count("good").alias("n"), F.coalesce(F.sum(F.when(F.col("good") == 0, 1).otherwise(0)), F.lit(0)).alias("k"))
    )
    blocked = reputation(hosts, z).where(F.col("bad_low") > max_bad).select("host", F.lit("block").alias("_method"))
    known = hosts.select("host").join(blocked, "host", "left").join(fitting_rules(hosts.select("host"), rules), "host", "left").where("_method IS NOT NULL OR fits IS NOT NULL")
    known = materialize(known)  # of a known size, so that urls are shuffled only if it is large
    longest = F.array_max(F.filter("fits", lambda r: F.startswith(F.col("path"), r["path"])))
    return parsed.join(known, "host", "left").withColumn("_rule", longest).select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.action", "_method", F.lit("allow")).alias("verdict")
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: labels.quality of the document with the page's id."""
    good = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), good)


def _case(column: str) -> str:
    out = []
    for act, h, p in sorted(RULES, key=lambda r: -(len(r[1]) + len(r[2]))):
        value = h + p if column == "rule" else act
        out.append(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value}'")
    return "CASE " + " ".join(out) + " END"


def _strength_sql(level: str) -> str:
    v = "(p * (1 - p))"
    return f"""(SELECT CASE WHEN g < 2 THEN 1000.0 WHEN rho > 0 THEN least(1000.0, greatest(2.0, 1 / rho - 1)) ELSE 1000.0 END FROM (
      SELECT count(*) AS g, (sum(n * pow(k / n - p, 2)) - max{v} * (count(*) - 1))
        / (max{v} * (sum(n) - sum(n * n) / sum(n) - (count(*) - 1))) AS rho
      FROM (SELECT CAST(n AS DOUBLE) AS n, k, p FROM {level}, total WHERE n > 0)))"""


_LABELS, _HOSTS = (", ".join(f"'{s}'" for s in x) for x in (SECOND_LABELS, SHARED_HOSTS))
ORACLE_SQL = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
worst AS (SELECT doc_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h0 AS (
  SELECT host, count(good) AS n, coalesce(sum(CASE WHEN good = 0 THEN 1 ELSE 0 END), 0) AS k, string_split(host, '.') AS w
  FROM parsed LEFT JOIN worst ON page_id = doc_id GROUP BY host),
h1 AS (SELECT *, array_to_string(w[greatest(1, len(w) - 1):], '.') AS two, array_to_string(w[greatest(1, len(w) - 2):], '.') AS three FROM h0),
h2 AS (SELECT host, n, k, CASE WHEN length(w[len(w)]) = 2 AND w[greatest(1, len(w) - 1)] IN ({_LABELS}) OR two IN ({_HOSTS}) THEN three ELSE two END AS domain FROM h1),
h AS (SELECT *, CASE WHEN strpos(domain, '.') > 0 THEN substr(domain, strpos(domain, '.') + 1) ELSE domain END AS suffix FROM h2),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
total AS (SELECT (sum(k) + 0.5) / (sum(n) + 1.0) AS p FROM suffixes),
s AS (SELECT {_strength_sql("suffixes")} AS s1, {_strength_sql("domains")} AS s2, {_strength_sql("h")} AS s3, p FROM total),
m1 AS (SELECT suffix, (k + p * s1) / (n + s1) AS m FROM suffixes, s),
m2 AS (SELECT domain, (k + m * s2) / (n + s2) AS m FROM domains JOIN m1 USING (suffix), s),
m3 AS (SELECT host, n + s3 AS t, (k + m * s3) / (n + s3) AS m FROM h JOIN m2 USING (domain), s),
judged AS (SELECT host, m - 2.0 * sqrt(m * (1 - m) / (t + 1)) > 0.2 AS bad FROM m3)
SELECT page_id, host, path, {_case("rule")} AS rule, coalesce({_case("verdict")}, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed JOIN judged USING (host)
"""
