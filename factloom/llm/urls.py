"""URL filters: explicit rules first, then empirical-Bayes host reputation, in DataFrame operations only.

Labelled page outcomes (poor or not) are pooled from host to registered domain to suffix to all pages.
Each level's prior is a beta distribution around its parent's posterior mean; its strength comes from
the level's own overdispersion (method of moments on the beta-binomial). A host is blocked if a lower
bound of its posterior for poor pages exceeds ``cut``; hosts with few labels stay near their parent.

The tables joined by host hold one row per host and are built by partial aggregation; a host with a third of the
pages adds one row to them. Only three counts per level reach the driver.

Defined cases: a null url, or one without ``://``, has empty host and path, matches no rule and is judged as the
host ''; a page labelled twice is poor if any label says so; without labels nothing is blocked but by rule;
repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from factloom.operators.staging import Staging

#: (verdict, host and path) of the explicit rules of op4.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Suffixes of two labels; all others count as one label.
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz")

#: The share of poor pages assumed before any label is seen, and the labelled pages that this counts as.
BASE_RATE, BASE_PAGES = 0.1, 20


def split_url(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    at = F.instr(F.col(url_col), "://")
    rest = F.when(at > 0, F.substr(F.col(url_col), at + 3)).otherwise("")
    raw = F.regexp_extract("_rest", r"^[^/?#]*", 0)
    out = pages.withColumn("_rest", rest).withColumn("_raw", raw)
    host = F.translate("_raw", ascii_uppercase, ascii_lowercase)
    path = F.regexp_extract(F.substr(F.col("_rest"), F.length("_raw") + 1), r"^[^?#]*", 0)
    return out.withColumns({"host": host, "path": path}).drop("_rest", "_raw")


def rule_of(rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits ``host`` and ``path``, else null."""
    out = None
    for action, rule in sorted(rules, key=lambda r: -len(r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(slash + path))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _names(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host without its port."""
    labels = F.split(F.regexp_replace(host, r":[0-9]*$", ""), r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    size = F.size(labels)
    long = two.isin(*SECOND_LEVEL) & (size >= 3)
    domain = F.when(long, F.array_join(F.slice(labels, -3, 3), ".")).when(size >= 2, two).otherwise(host)
    suffix = F.when(long, two).otherwise(F.element_at(labels, -1))
    return domain, suffix


def _strength(level: DataFrame, prior: Column) -> float:
    """Pseudo-counts of the prior, from the spread of the level's labelled groups around it."""
    spread = F.pow(F.col("x") - F.col("n") * prior, 2) / (F.col("n") * prior * (1 - prior))
    got = level.where("n > 0").agg(F.sum(spread).alias("s"), F.count("*").alias("g"), F.sum(F.col("n") - 1).alias("m")).first()
    rho = (got["s"] - got["g"]) / got["m"] if got["g"] and got["m"] else 0.0
    return 1 / min(0.5, max(1 / 1001, rho)) - 1


def reputation(pages: DataFrame, outcomes: DataFrame, staging: Staging, id_col: str = "page_id") -> DataFrame:
    """``(host, labelled, poor, mean, bound_sd)`` of every host: posterior mean and standard deviation.

    ``pages`` has ``host``; ``outcomes`` has ``(id_col, bad)`` with bad 0 or 1.
    """
    seen = pages.select(id_col, "host").join(outcomes, id_col, "left")
    domain, suffix = _names(F.col("host"))
    hosts = staging.write(seen.groupBy("host").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("x"), F.count("bad").alias("n")).withColumns({"domain": domain, "suffix": suffix}), "hosts")
    totals = hosts.agg(F.sum("x"), F.sum("n")).first()
    top = ((totals[0] or 0) + BASE_RATE * BASE_PAGES) / ((totals[1] or 0) + BASE_PAGES)
    sums = lambda by: hosts.groupBy(*by).agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    mean = lambda m, prior: (m * prior + F.col("x")) / (m + F.col("n"))

    suffixes = sums(["suffix"])
    suffixes = suffixes.select("suffix", mean(_strength(suffixes, F.lit(top)), F.lit(top)).alias("ps"))
    domains = sums(["suffix", "domain"]).join(suffixes, "suffix")
    domains = domains.select("domain", "suffix", mean(_strength(domains, F.col("ps")), F.col("ps")).alias("pd"))
    full = staging.write(hosts.join(domains, ["domain", "suffix"]), "hosts-domains")
    m = _strength(full, F.col("pd"))
    post = mean(m, F.col("pd"))
    return full.select("host", F.col("n").alias("labelled"), F.col("x").alias("poor"), post.alias("mean"), F.sqrt(post * (1 - post) / (m + F.col("n") + 1)).alias("sd"))


def filter_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", label_id: str = "doc_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, cut: float = 0.3, z: float = 1.645) -> DataFrame:
    """``(id, host, path, rule, verdict, poor_bound)`` for each page.

    A label names a page by its id; an outcome is poor if quality is 0 or toxic is 1.
    """
    staging = Staging(pages.sparkSession, "urls")
    split = split_url(pages.select(F.col(id_col), F.col(url_col).cast("string").alias("_url")), "_url").drop("_url")
    poor = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    outcomes = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias(id_col)).agg(F.max(poor).alias("bad"))
    known = reputation(split, outcomes, staging, id_col)
    bounds = known.select("host", (F.col("mean") - z * F.col("sd")).alias("poor_bound"))
    judged = split.withColumn("_r", rule_of(rules)).join(bounds, "host", "left")
    method = F.when(F.col("poor_bound") > cut, "block").otherwise("allow")
    return judged.select(id_col, "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(F.col("_r.verdict"), method).alias("verdict"), "poor_bound")
