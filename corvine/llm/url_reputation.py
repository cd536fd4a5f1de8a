"""URL filters: explicit rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted per host, registered domain and
public suffix. Each level's rate is shrunk towards the level above through a
beta-binomial prior whose strength is estimated from the spread between groups
(method of moments), down to a beta posterior per host. A host is blocked when the
lower bound of its posterior bad rate, mean minus ``z`` standard deviations,
exceeds ``threshold``.

Defined results: a null or malformed URL has an empty host and path and is judged
like a host of that (empty) name; user, port and a trailing dot do not count in a host's
domain and suffix, and an address is a domain of its own; a page without label counts for nothing; a label
with both outcomes null is no label; repeated pages and labels count each time; a
null page_id passes through. With no labels at all every prior is 1/2 and nothing
exceeds the default threshold. Other columns are ignored. Host tables are joined by
Spark's own choice of join, so a hot host is split by adaptive execution or meets a
broadcast table that Spark has measured.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.llm.common import shared_dir, table, written

# Second-level labels under which many countries register names, and the countries that do.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
COUNTRIES = tuple("ar au bd br cn co cr eg gh hk id il in jp ke kr lk mx my ng np nz pe ph pk sa sg th tr tw tz ua ug uk uy ve vn za zm zw".split())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Blocks or allows a host with its subdomains below a path; written ``host/path``."""

    verdict: str
    text: str

    def fits(self, host: Column, path: Column) -> Column:
        name, _, rest = self.text.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")


@dataclass(frozen=True)
class Reputation:
    rules: tuple[Rule, ...] = ()
    threshold: float = 0.5
    z: float = 1.64
    #: Bounds of a prior's strength, in pseudo-observations.
    weakest: float = 2.0
    strongest: float = 1000.0
    second_level: tuple[str, ...] = SECOND_LEVEL
    countries: tuple[str, ...] = COUNTRIES


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user, port and trailing dot, as the levels above it see it."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def levels(host: Column, settings: Reputation) -> dict[str, Column]:
    """Registered domain and public suffix; an address (digits and dots, or in brackets) is its own domain under no suffix."""
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    long_ = F.substring_index(two, ".", 1).isin(*settings.second_level) & F.substring_index(name, ".", -1).isin(*settings.countries)
    address = name.rlike(r"^[0-9.]+$|^\[")
    return {
        "domain": F.when(address, name).when(long_, F.substring_index(name, ".", -3)).otherwise(two),
        "suffix": F.when(address, F.lit("")).when(long_, two).otherwise(F.substring_index(name, ".", -1)),
    }


def strength(groups: DataFrame, lowest: float, highest: float) -> float:
    """Pseudo-observations of the beta prior over the groups' rates (n, bad), by the method of moments."""
    part = groups.filter("n > 0")
    total = part.agg(F.sum("n"), F.sum("bad"), F.count("*"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n"))).first()
    n, bad, k, squares, explained = (float(x or 0) for x in total)
    if k < 2 or not 0 < bad < n or n * n <= squares:
        return highest
    p = bad / n
    between = explained - n * p * p
    room = n - squares / n
    rho = (between - p * (1 - p) * (k - 1)) / (p * (1 - p) * (room - (k - 1))) if room > k - 1 else 0.0
    return min(highest, max(lowest, 1 / rho - 1)) if rho > 0 else highest


def judged(pages: DataFrame, labels: DataFrame, settings: Reputation) -> DataFrame:
    """page_id, host, path, rule, verdict, host_labelled and host_bad of each row of ``pages``.

    ``labels`` has (page_id, bad boolean); null ``bad`` is no label.
    """
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    outcome = labels.filter("bad is not null and page_id is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = (
        split.select("page_id", "host").join(outcome, "page_id", "left").groupBy("host")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumns(levels(F.col("host"), settings))
    )
    # One row a host, written once: the levels above, the priors and the verdicts are all made of it.
    hosts = written(hosts, shared_dir(pages.sparkSession), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    k_host, k_domain, k_suffix = (strength(x, settings.weakest, settings.strongest) for x in (hosts, domains, suffixes))
    n, bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    top = ((bad or 0) + 1) / ((n or 0) + 2)

    suffix_rate = suffixes.select("suffix", ((F.col("bad") + k_suffix * top) / (F.col("n") + k_suffix)).alias("suffix_rate"))
    domain_rate = domains.join(suffix_rate, "suffix").select("domain", ((F.col("bad") + k_domain * F.col("suffix_rate")) / (F.col("n") + k_domain)).alias("domain_rate"))
    a, b = F.col("bad") + k_host * F.col("domain_rate"), F.col("n") - F.col("bad") + k_host * (1 - F.col("domain_rate"))
    mean = a / (a + b)
    bound = mean - settings.z * F.sqrt(mean * (1 - mean) / (a + b + 1))
    verdicts = hosts.join(domain_rate, "domain").select("host", F.col("n").alias("host_labelled"), F.col("bad").alias("host_bad"), (bound > settings.threshold).alias("bad_host"))

    rule = verdict = None
    host, path = F.col("host"), F.col("path")
    for r in sorted(settings.rules, key=lambda r: (-len(r.text), r.text)):
        fits = r.fits(host, path)
        rule, verdict = (F.when(fits, r.text), F.when(fits, r.verdict)) if rule is None else (rule.when(fits, r.text), verdict.when(fits, r.verdict))
    own = F.when(F.col("bad_host"), "block").otherwise("allow")
    return split.join(verdicts, "host", "left").select(
        "page_id", "host", "path",
        (F.lit(None).cast("string") if rule is None else rule).alias("rule"),
        (own if verdict is None else verdict.otherwise(own)).alias("verdict"),
        "host_labelled", "host_bad",
    )


PRODUCTION = Reputation(rules=(Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/")))


def page_labels(labels: DataFrame) -> DataFrame:
    """A page's outcome is its document's label (page_id = doc_id): bad if toxic or of low quality."""
    return labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))


def query(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), page_labels(table(spark, sf_dir, "labels")), PRODUCTION)


def _listed(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{x}'" for x in names)


_LEVEL = """
    SELECT CASE WHEN k < 2 OR bad <= 0 OR bad >= n OR n * n <= squares OR rho IS NULL OR rho <= 0 THEN 1000.0
                ELSE least(1000.0, greatest(2.0, 1 / rho - 1)) END AS k
    FROM (SELECT *, CASE WHEN n - squares / n > k - 1 THEN
              (explained - n * (bad / n) * (bad / n) - (bad / n) * (1 - bad / n) * (k - 1))
              / ((bad / n) * (1 - bad / n) * (n - squares / n - (k - 1))) END AS rho
          FROM (SELECT sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, count(*)::DOUBLE AS k,
                       sum(n * n)::DOUBLE AS squares, sum(bad::DOUBLE * bad / n) AS explained FROM {0} WHERE n > 0))
"""
SQL = f"""
WITH split AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
outcome AS (
  SELECT doc_id AS page_id, count(*) AS n, sum((quality = 0 OR toxic = 1)::BIGINT) AS bad
  FROM labels WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY 1),
counted AS (
  SELECT host, coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(bad), 0)::BIGINT AS bad
  FROM split LEFT JOIN outcome USING (page_id) GROUP BY 1),
named AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS name FROM counted),
cut AS (SELECT *, string_split(name, '.') AS s, regexp_matches(name, '^[0-9.]+$|^\\[') AS address FROM named),
hosts AS (
  SELECT host, n, bad, CASE WHEN address THEN name WHEN long_ THEN array_to_string(s[-3:], '.') ELSE array_to_string(s[-2:], '.') END AS domain,
         CASE WHEN address THEN '' WHEN long_ THEN array_to_string(s[-2:], '.') ELSE s[-1] END AS suffix
  FROM (SELECT *, s[-2:][1] IN ({_listed(SECOND_LEVEL)}) AND s[-1] IN ({_listed(COUNTRIES)}) AS long_ FROM cut)),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domains GROUP BY 1),
kh AS ({_LEVEL.format("hosts")}), kd AS ({_LEVEL.format("domains")}), ks AS ({_LEVEL.format("suffixes")}),
top AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS p FROM suffixes),
sr AS (SELECT suffix, (bad + (SELECT k FROM ks) * (SELECT p FROM top)) / (n + (SELECT k FROM ks)) AS r FROM suffixes),
dr AS (SELECT domain, (d.bad + (SELECT k FROM kd) * r) / (d.n + (SELECT k FROM kd)) AS r FROM domains d JOIN sr USING (suffix)),
post AS (
  SELECT host, n, bad, bad + (SELECT k FROM kh) * r AS a, n - bad + (SELECT k FROM kh) * (1 - r) AS b
  FROM hosts JOIN dr USING (domain)),
verdicts AS (
  SELECT host, n, bad, a / (a + b) - 1.64 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) > 0.5 AS bad_host FROM post),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM split LEFT JOIN verdicts USING (host))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN bad_host THEN 'block' ELSE 'allow' END AS verdict,
       n AS host_labelled, bad AS host_bad
FROM ruled
"""
