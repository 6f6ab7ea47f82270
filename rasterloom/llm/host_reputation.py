"""URL filters: rules, and empirical-Bayes host reputation for what no rule decides.

Rules label pages: a rule fits its host and all subdomains where the path starts with its path,
and the longest wins. Labelled outcomes (blocked or allowed) are counted by host and shrunk
through beta-binomial priors from suffix to registered domain to host. A level's prior strength
is the method-of-moments estimate over its units; its mean is the parent's posterior mean. A
page without a rule is blocked when the lower bound of its host's posterior blocked share (the
mean less Z standard deviations) is over THRESHOLD.

Outcomes are the pages' rule verdicts unless a labelled table is given; from rules alone the
reputation learns no more than where the rules fire. All counts pre-aggregate by host into a written
table; the levels above are sums of hosts, and only six numbers reach the driver, so the pages are
read twice: for the hosts, and for the result.

Null urls and urls without :// have empty host and path; a host without labels takes its parent's
posterior. A null page_id stays. Repeated rows count each; an empty table gives no rows. A tie of a
bound with the threshold allows; rules of one length go by code points. Urls of any length are read
whole. Only page_id and url are read, so further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace

#: (verdict, rule): fixed values.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Public suffixes of two labels: fixed values, a parameter of the operator.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "co.za")
Z, THRESHOLD = 1.645, 0.5
WEAKEST, STRONGEST = 1.0, 1000.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def levels(host: Column, two_label: tuple[str, ...]) -> tuple[Column, Column]:
    """Registered domain and suffix."""
    two = F.substring_index(host, ".", -2)
    wide = two.isin(*two_label)
    return F.when(wide, F.substring_index(host, ".", -3)).otherwise(two), F.when(wide, two).otherwise(F.substring_index(host, ".", -1))


def judged(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def strength(units: DataFrame) -> float:
    """Beta-binomial prior strength of units(n, bad) with n > 0, by the method of moments."""
    n, bad = F.col("n"), F.col("bad")
    k, total, blocked, squares, spread = units.where("n > 0").agg(F.count("*"), F.sum("n"), F.sum("bad"), F.sum(n.cast("double") * n), F.sum(bad.cast("double") * bad / n)).first()
    if not total:
        return WEAKEST
    p = blocked / total
    scatter = spread - total * p * p
    room = total - squares / total
    variance = (scatter - (k - 1) * p * (1 - p)) / room if room > 0 else 0.0
    return min(STRONGEST, max(WEAKEST, p * (1 - p) / variance - 1)) if variance > 0 else STRONGEST


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages(page_id, url).

    labels: outcomes (url, verdict: block or allow) to learn from in the place of the rules' verdicts.
    """
    host, path = url_parts(F.col("url"))
    rule, verdict = judged(F.col("host"), F.col("path"), rules)
    ruled = pages.select("page_id", host.alias("host"), path.alias("path")).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    outcomes = ruled.select("host", F.col("ruled").alias("says"))
    if labels is not None:
        outcomes = outcomes.select("host", F.lit(None).cast("string").alias("says")).union(labels.select(host.alias("host"), F.col("verdict").alias("says")))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domain, suffix = levels(F.col("host"), two_label)
    hosts = outcomes.groupBy("host").agg(F.count("says").alias("n"), F.count(F.when(F.col("says") == "block", 1)).alias("bad")).select("*", domain.alias("domain"), suffix.alias("suffix"))
    hosts = Workspace(pages.sparkSession, "host-reputation").save(hosts, "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    k_host, k_domain, k_suffix = strength(hosts), strength(domains), strength(suffixes)
    n, bad = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    prior = (bad + 1) / (n + 2)
    at_suffix = suffixes.select("suffix", ((F.col("bad") + k_suffix * prior) / (F.col("n") + k_suffix)).alias("mean_suffix"))
    at_domain = domains.join(at_suffix, "suffix").select("domain", ((F.col("bad") + k_domain * F.col("mean_suffix")) / (F.col("n") + k_domain)).alias("mean_domain"))
    mean = (F.col("bad") + k_host * F.col("mean_domain")) / (F.col("n") + k_host)
    bound = mean - Z * F.sqrt(mean * (1 - mean) / (F.col("n") + k_host + 1))
    known = hosts.join(at_domain, "domain").select("host", F.when(bound > THRESHOLD, "block").otherwise("allow").alias("reputation"))
    return ruled.join(known, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "reputation").alias("verdict"))


def oracle() -> str:
    """The same in DuckDB SQL."""
    rule, verdict = "NULL", "NULL"
    for says, text in sorted(RULES, key=lambda r: (len(r[1]), r[1])):
        name, slash, prefix = text.partition("/")
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + prefix}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{says}' ELSE {verdict} END"
    wide = "array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') IN (" + ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES) + ")"
    tail = lambda k: f"array_to_string(list_slice(string_split(host, '.'), -{k}, -1), '.')"

    def moments(units: str) -> str:
        return f"""(SELECT CASE WHEN coalesce(sum(n), 0) = 0 THEN {WEAKEST} WHEN v > 0 THEN least({STRONGEST}, greatest({WEAKEST}, p * (1 - p) / v - 1)) ELSE {STRONGEST} END
            FROM (SELECT sum(n) n, any_value(p) p, CASE WHEN sum(n) - sum(n * n::DOUBLE) / sum(n) > 0 THEN (sum(bad * bad::DOUBLE / n) - sum(n) * any_value(p) * any_value(p) - (count(*) - 1) * any_value(p) * (1 - any_value(p))) / (sum(n) - sum(n * n::DOUBLE) / sum(n)) ELSE 0 END v
                  FROM {units}, (SELECT sum(bad) / sum(n)::DOUBLE p FROM {units}) WHERE n > 0) GROUP BY n, p, v)"""

    return f"""
    WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END rest FROM pages),
    split AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path FROM cut),
    ruled AS (SELECT *, {rule} AS rule, {verdict} AS ruled FROM split),
    hosts AS (SELECT host, count(ruled) n, count(*) FILTER (ruled = 'block') bad, CASE WHEN {wide} THEN {tail(3)} ELSE {tail(2)} END AS domain, CASE WHEN {wide} THEN {tail(2)} ELSE {tail(1)} END AS suffix FROM ruled GROUP BY host),
    domains AS (SELECT domain, suffix, sum(n)::BIGINT n, sum(bad)::BIGINT bad FROM hosts GROUP BY ALL),
    suffixes AS (SELECT suffix, sum(n)::BIGINT n, sum(bad)::BIGINT bad FROM domains GROUP BY ALL),
    k AS (SELECT {moments("hosts")} kh, {moments("domains")} kd, {moments("suffixes")} ks, (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2)::DOUBLE FROM hosts) prior),
    s AS (SELECT suffix, (bad + ks * prior) / (n + ks) ms FROM suffixes, k),
    d AS (SELECT domain, (bad + kd * ms) / (n + kd) md FROM domains JOIN s USING (suffix), k),
    m AS (SELECT host, n, kh, (bad + kh * md) / (n + kh) mean FROM hosts JOIN d USING (domain), k),
    r AS (SELECT host, CASE WHEN mean - {Z} * sqrt(mean * (1 - mean) / (n + kh + 1)) > {THRESHOLD} THEN 'block' ELSE 'allow' END reputation FROM m)
    SELECT page_id, host, path, rule, coalesce(ruled, reputation) AS verdict FROM ruled LEFT JOIN r USING (host)"""
