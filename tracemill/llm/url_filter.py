"""URL filter: explicit host rules first, then empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are counted by host. Each host's rate is shrunk through beta
priors fitted from the data: the whole table informs the public suffix, the suffix informs the
registered domain, the domain informs the host. A page passes if the lower bound of its host's
posterior reaches ``floor``.

Everything is DataFrame expressions. A hot host costs nothing extra: counting is partial before the
shuffle, and hosts with a thousandth or more of the rows (a thousand hosts at most, whatever the
table's size) are joined by broadcast while every other host has too few rows to make a task uneven.

Defined results: a null url or one without ``://`` has an empty host and path and is judged as the
empty host is; repeated rows are judged each; without labelled outcomes every host has the prior's
mean; an empty table gives an empty result; extra columns of the input are kept out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, table, written

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Kinds of organisation that registries of countries put before the country's label: a suffix of two labels is one of
#: these and a label of two letters (co.uk, com.br, go.jp). Any other suffix is the last label.
KINDS = ("ac", "co", "com", "edu", "gob", "gov", "go", "mil", "ne", "net", "nom", "or", "org", "sch")
_TWO_LABELS = rf"(?:^|\.)(?:{'|'.join(KINDS)})\.[a-z]{{2}}\z"
HOT_SHARE = 1000


def host_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, ascii_lower(F.regexp_extract(rest, r"\A[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)).otherwise("")


def suffix_of(host: Column) -> Column:
    return F.when(host.rlike(_TWO_LABELS), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The public suffix and one label more; the host itself where it has no more."""
    return F.when(host.rlike(_TWO_LABELS), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in reversed(order):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _prior_weight(child: DataFrame, mean: str) -> float:
    """The weight of a beta prior with the parent's mean, from one row of sums.

    By the method of moments: how far children of one parent differ beyond what binomial noise explains,
    pooled over all parents.
    """
    n, m, p = F.col("n"), F.col(mean), F.col("good") / F.col("n")
    s, b, v = child.where("n > 0").agg(F.sum(n * (p - m) * (p - m)), F.sum(m * (1 - m)), F.sum(n * m * (1 - m))).first()
    rho = (s - b) / (v - b) if v is not None and v > b else 0.001
    return 1 / max(min(rho, 0.5), 0.001) - 1


def _shrunk(mean: str, k: float) -> Column:
    return (F.col("good") + k * F.col(mean)) / (F.col("n") + k)


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """host, n_pages, n, good, mean and sd of the posterior, from (host, n_pages, n, good) a host."""
    good, n = outcomes.agg(F.sum("good"), F.sum("n")).first()
    base = outcomes.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = base.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("m0", F.lit(((good or 0) + 1) / ((n or 0) + 2)))
    domains = domains.join(suffixes.select("suffix", _shrunk("m0", _prior_weight(suffixes, "m0")).alias("m1")), "suffix")
    hosts = base.join(domains.select("domain", _shrunk("m1", _prior_weight(domains, "m1")).alias("m2")), "domain")
    k = _prior_weight(hosts, "m2")
    mean = _shrunk("m2", k)
    return hosts.select("host", "n_pages", "n", "good", mean.alias("mean"), F.sqrt(mean * (1 - mean) / (F.col("n") + k + 1)).alias("sd"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, id_col="page_id", url_col="url", rules=RULES, floor=0.5, z=1.645) -> DataFrame:
    """page id, host, path, rule, verdict, posterior lower bound.

    outcomes: (id, good boolean), at most one row an id; ids without a row are pages without a label.
    """
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    p = p.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labelled = p.select("page_id", "host").join(outcomes.select(F.col(outcomes.columns[0]).alias("page_id"), F.col("good")), "page_id", "left")
    counts = labelled.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_pages"), F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("good")
    )
    counts = written(counts, "host-counts")  # a row a host, read many times below; the pages are not read again for it
    pages_in_all = counts.agg(F.sum("n_pages")).first()[0] or 0
    rep = host_reputation(counts).select("host", (F.col("mean") - z * F.col("sd")).alias("lower"), (F.col("n_pages") * HOT_SHARE >= pages_in_all).alias("hot"))
    hot = rep.where("hot").select("host", F.col("lower").alias("hot_lower"))
    cold = rep.where("NOT hot").select(F.concat(F.lit("h"), "host").alias("key"), F.col("lower").alias("cold_lower"))
    p = p.join(F.broadcast(hot), "host", "left")
    # Rows that are already judged get keys of their own, so they spread evenly and match nothing.
    p = p.withColumn("key", F.when(F.col("hot_lower").isNull(), F.concat(F.lit("h"), "host")).otherwise(F.concat(F.lit("p"), F.xxhash64("page_id", "path").cast("string"))))
    p = p.join(cold, "key", "left").withColumn("lower", F.coalesce("hot_lower", "cold_lower"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("lower") >= floor, "allow").otherwise("block")
    return p.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("lower").alias("lower_bound"))


def op10(spark, sf_dir):
    """Outcomes: pages take the label of the document with their id; good is quality without toxicity."""
    labels = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL")
    good = labels.groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return judge_urls(table(spark, sf_dir, "pages"), good).select("page_id", "host", "path", "rule", "verdict")


_PRIOR = """greatest(least(coalesce(CASE WHEN sum(n * {m} * (1 - {m})) > sum({m} * (1 - {m})) THEN
  (sum(n * (good / n - {m}) * (good / n - {m})) - sum({m} * (1 - {m}))) / (sum(n * {m} * (1 - {m})) - sum({m} * (1 - {m}))) END, 0.001), 0.5), 0.001)"""
OP10_SQL = f"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '\\A[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '\\A[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), o AS (SELECT doc_id, min(CAST(quality = 1 AND toxic = 0 AS INT)) AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
c AS (SELECT host, count(good) AS n, CAST(coalesce(sum(good), 0) AS DOUBLE) AS good FROM p LEFT JOIN o ON page_id = doc_id GROUP BY 1),
b AS (SELECT *, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS two, regexp_matches(host, '{_TWO_LABELS}') AS pair FROM c),
b2 AS (SELECT host, n, good, CASE WHEN pair THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') ELSE two END AS domain,
   CASE WHEN pair THEN two ELSE string_split(host, '.')[-1] END AS suffix FROM b),
d AS (SELECT suffix, domain, sum(n) AS n, sum(good) AS good FROM b2 GROUP BY 1, 2),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM b2) AS m0 FROM d GROUP BY 1),
k1 AS (SELECT 1 / {_PRIOR.format(m="m0")} - 1 AS k FROM s WHERE n > 0),
s1 AS (SELECT suffix, (good + k * m0) / (n + k) AS m1 FROM s, k1),
d1 AS (SELECT d.*, m1 FROM d JOIN s1 USING (suffix)),
k2 AS (SELECT 1 / {_PRIOR.format(m="m1")} - 1 AS k FROM d1 WHERE n > 0),
d2 AS (SELECT domain, (good + k * m1) / (n + k) AS m2 FROM d1, k2),
h1 AS (SELECT b2.*, m2 FROM b2 JOIN d2 USING (domain)),
k3 AS (SELECT 1 / {_PRIOR.format(m="m2")} - 1 AS k FROM h1 WHERE n > 0),
h2 AS (SELECT host, n + k AS a, (good + k * m2) / (n + k) AS m3 FROM h1, k3),
r AS (SELECT page_id, p.host, path, m3 - 1.645 * sqrt(m3 * (1 - m3) / (a + 1)) AS lower_bound, list_filter([
   {", ".join(f"CASE WHEN (p.host = '{h}' OR ends_with(p.host, '.{h}')) AND starts_with(path, '{q}') THEN '{k} {h}{q}' END" for k, h, q in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r)))}
   ], lambda x: x IS NOT NULL)[1] AS hit FROM p JOIN h2 USING (host))
SELECT page_id, host, path, split_part(hit, ' ', 2) AS rule, coalesce(split_part(hit, ' ', 1), CASE WHEN lower_bound >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict FROM r
"""
