"""URL filters: fixed rules first, then empirical-Bayes host reputation.

Labelled page outcomes are counted by host, registered domain and suffix. Each level's bad rate is shrunk towards its
parent's by a beta prior whose strength is estimated from the spread between the children (method of moments); a page is
blocked if the lower posterior bound of its host's bad rate exceeds `max_bad`. Hosts without labels have their prior as
posterior. Counts and posteriors are tables, one row for each host, domain or suffix.

Edge cases: a null url, or one without "://", has an empty host and path, fits no rule and is judged by the overall
rate; null or repeated page ids and ties pass through, one output row for each input row; empty labels allow all that
no rule blocks. Counts are pre-aggregated by host, so that a hot host is one row per task in the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklore.llm.common import ascii_lower, table, written

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
LEVELS = ("suffix", "domain", "host")
Z, MAX_BAD = 1.645, 0.5
LEAST, MOST = 2.0, 1000.0


def url_parts(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, pattern, 1)), F.regexp_extract(u, pattern, 2)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    which = verdict = F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(slash + rest))
        which, verdict = F.when(fits, F.lit(rule)).otherwise(which), F.when(fits, F.lit(action)).otherwise(verdict)
    return which, verdict


#: Well-known public suffixes of two labels. Other suffixes are the last label.
SUFFIXES = (
    "ac.at", "ac.il", "ac.jp", "ac.kr", "ac.nz", "ac.uk", "ac.za", "asn.au", "co.at", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk", "com.pl", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn",
    "edu.au", "edu.cn", "edu.hk", "edu.tr", "edu.tw", "go.jp", "go.kr", "go.th", "gob.ar", "gob.mx", "gov.au", "gov.br", "gov.cn", "gov.il", "gov.in", "gov.tr", "gov.uk", "gov.za",
    "ne.jp", "net.au", "net.br", "net.cn", "net.in", "net.nz", "net.uk", "nhs.uk", "or.at", "or.jp", "or.kr", "org.ar", "org.au", "org.br", "org.cn", "org.il", "org.in", "org.mx", "org.nz", "org.tr", "org.tw", "org.uk", "org.za", "sch.uk",
)
ADDRESS = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$|^\["


def _levels(df: DataFrame) -> DataFrame:
    """Registered domain and suffix of each host, its port and user left out. An address is a domain of its own; all
    addresses have one suffix."""
    bare = F.regexp_replace(F.substring_index("host", "@", -1), r":[0-9]*$", "")
    two = F.substring_index("bare", ".", -2)
    known = two.isin(*SUFFIXES)
    suffix = F.when(F.col("bare").rlike(ADDRESS), F.lit("[address]")).when(known, two).otherwise(F.substring_index("bare", ".", -1))
    domain = F.when(F.col("bare").rlike(ADDRESS), F.col("bare")).when(known, F.substring_index("bare", ".", -3)).otherwise(two)
    return df.withColumn("bare", bare).withColumn("domain", domain).withColumn("suffix", suffix).drop("bare")


def _strength(groups: DataFrame) -> float:
    """Beta prior strength for children of one level from one row of sums."""
    n, bad, g, ss = groups.agg(F.sum("n"), F.sum("bad"), F.count("*"), F.sum(F.col("bad") * F.col("bad") / F.col("n"))).first()
    if not n or g < 2 or n <= g:
        return MOST
    m = bad / n
    if m <= 0 or m >= 1:
        return MOST
    within, noise = (ss - n * m * m) / n, (g - 1) / n
    rho = (within / (m * (1 - m)) - noise) / (1 - noise)
    return min(MOST, max(LEAST, 1 / rho - 1)) if rho > 0 else MOST


def host_reputation(hosts: DataFrame, z: float = Z) -> DataFrame:
    """hosts(host, n, bad), n being 0 for hosts without labels -> (host, bad_bound): the lower posterior bound. Each
    level's prior is its parent's posterior mean, at the strength estimated for that level."""
    hosts = _levels(hosts)
    n, bad = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    above, mean, parent = None, F.lit((bad + 1) / (n + 2)), None
    for level in LEVELS:
        own = hosts.groupBy(level, *([parent] if parent else [])).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        k = _strength(own.where("n > 0"))
        if above is not None:
            own = own.join(above.select(parent, F.col("mean").alias("up")), parent)
            mean = F.col("up")
        a, b = mean * k + F.col("bad"), (1 - mean) * k + F.col("n") - F.col("bad")
        above, parent = written(own.select(level, (a / (a + b)).alias("mean"), a.alias("a"), b.alias("b")), level), level
    a, b = F.col("a"), F.col("b")
    return above.select("host", (a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("bad_bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, url_col: str = "url", rules=RULES, z: float = Z, max_bad: float = MAX_BAD) -> DataFrame:
    """Add host, path, rule, bad_bound and verdict to pages. outcomes(url, bad): labelled pages."""
    host, path = url_parts(F.col(url_col))
    labelled = outcomes.where(F.col("bad").isNotNull()).select(host.alias("host"), F.lit(1).alias("n"), F.col("bad").cast("int").alias("bad"))
    zero = F.lit(0)
    every = labelled.unionByName(pages.select(host.alias("host"), zero.alias("n"), zero.alias("bad")))
    hosts = written(every.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "hosts")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    drop = [c for c in ("host", "path", "rule", "verdict", "bad_bound") if c in pages.columns]
    judged = pages.drop(*drop).withColumn("host", host).withColumn("path", path).join(host_reputation(hosts, z), "host", "left").withColumn("rule", rule)
    return judged.withColumn("verdict", F.coalesce(verdict, F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes come from `labels`, whose ids name pages here: bad if toxic or of low quality."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0).alias("bad"))
    out = filter_urls(pages, pages.join(labels, "page_id").select("url", "bad"))
    return out.select("page_id", "host", "path", "rule", "verdict")
