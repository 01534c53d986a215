"""URL filter by host reputation: empirical-Bayes shrinkage of labelled page outcomes.

Outcomes of labelled pages are counted per host, registered domain and public
suffix.  Each level has a beta-binomial prior centred on the posterior mean of
the level above; how strongly it pulls is estimated from the data by the
method of moments, once per level.  A url is blocked when the lower posterior
bound of its host's share of bad pages is over ``max_bad``, unless a rule
decides.  Everything is DataFrame functions.

Defined results: host and path of NULL urls and of urls without ``://`` are
empty, so no rule fits and the corpus-wide rate decides; rows that repeat a
page_id are judged one by one; outcomes that repeat a page_id count one by
one; NULL outcomes and outcomes of unknown pages are ignored; without any
outcome nothing is blocked by the method.  Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.shuffle_tools import join_weighted, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values of the contract: (host, path) rules.
BLOCK_RULES = ("net/", "example.com/de/")
ALLOW_RULES = ("example.net/en/", "org/fr/")
#: Suffixes under which names are registered, besides the last label (fixed values).
LONG_SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp",
                 "co.nz", "co.za", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr")

#: A url is blocked when the share of bad pages is over this ...
MAX_BAD = 0.3
#: ... with this many posterior standard deviations to spare.
BOUND_Z = 1.645
#: Limits of the estimated prior strength (pseudo-counts).
STRENGTH = (1.0, 10_000.0)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest rule that fits (ties: the longer host, then the smaller string), else NULL.

    A rule is host and path in one string; it fits its host and all
    subdomains, where the path starts with the rule's.
    """
    order = sorted(set(rules), key=lambda r: (-len(r), -len(r.partition("/")[0]), r))

    def fits(rule: str) -> Column:
        name, slash, rest = rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
    cases = [F.when(fits(r), F.lit(r)) for r in order]
    return F.coalesce(*cases) if cases else F.lit(None).cast("string")


def domain_of(host: Column) -> Column:
    """Registered domain: the suffix and one label before it; user, port and a final dot go.
    Numeric addresses are their own domain."""
    bare = _bare(host)
    suffix = suffix_of(host)
    labels = F.split(bare, r"\.")
    take = F.least(F.size(labels), F.size(F.split(suffix, r"\.")) + 1)
    return F.when(_numeric(bare), bare).otherwise(F.array_join(F.slice(labels, F.size(labels) - take + 1, take), "."))


def suffix_of(host: Column) -> Column:
    bare = _bare(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(_numeric(bare), F.lit("")).when(two.isin(*LONG_SUFFIXES), two).otherwise(F.substring_index(bare, ".", -1))


def _bare(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$|\.$", "")


def _numeric(bare: Column) -> Column:
    return bare.rlike(r"^\d+\.\d+\.\d+\.\d+$|^\[")


def _shrink(child: DataFrame, name: str) -> DataFrame:
    """Posterior of ``bad`` of ``n`` under a prior with mean ``prior`` and one moment-estimated strength.

    Beta-binomial counts have variance n m (1 - m) (1 + (n - 1) r) around a
    prior mean m; solving the sums over all groups for r gives the strength
    1 / r - 1.
    """
    m, n = F.col("prior"), F.col("n")
    plain = n * m * (1 - m)
    sums = child.agg(F.sum(F.pow(F.col("bad") - n * m, 2) - plain).alias("extra"), F.sum(plain * (n - 1)).alias("scale"))
    rho = F.coalesce(F.when(F.col("scale") > 0, F.col("extra") / F.col("scale")), F.lit(1.0))
    low, high = 1 / (STRENGTH[1] + 1), 1 / (STRENGTH[0] + 1)
    sums = sums.select((1 / F.least(F.greatest(rho, F.lit(low)), F.lit(high)) - 1).alias("strength"))
    s = F.col("strength")
    # one row: the strength of the level
    return child.join(F.broadcast(sums)).withColumn("a", s * m + F.col("bad")).withColumn("b", s * (1 - m) + n - F.col("bad")) \
        .withColumn(name, F.col("a") / (F.col("a") + F.col("b")))


def host_reputation(counts: DataFrame) -> DataFrame:
    """``host, domain, suffix, pages, n, bad, mean, lower``: posterior share of bad pages per host.

    ``counts``: one row per host with its pages, labelled pages ``n`` and bad ones.
    """
    counts = counts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    # Jeffreys' half counts keep the corpus-wide rate inside (0, 1)
    total = counts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("prior"))
    sums = [F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.count("*").alias("w")]
    suffixes = counts.groupBy("suffix").agg(*sums).join(F.broadcast(total))
    suffixes = written(_shrink(suffixes, "mean").select("suffix", F.col("mean").alias("prior"), "w"), "url-suffixes")
    domains = join_weighted(counts.groupBy("domain", "suffix").agg(*sums).withColumnRenamed("w", "hosts"),
                            suffixes, ["suffix"], "w", "inner")
    domains = written(_shrink(domains, "mean").select("domain", "suffix", F.col("mean").alias("prior"), F.col("hosts").alias("w")), "url-domains")
    hosts = _shrink(join_weighted(counts, domains, ["domain", "suffix"], "w", "inner"), "mean")
    size = F.col("a") + F.col("b")
    spread = F.sqrt(F.col("a") * F.col("b") / (size * size * (size + 1)))
    return hosts.select("host", "domain", "suffix", "pages", "n", "bad", "mean",
                        F.greatest(F.lit(0.0), F.col("mean") - BOUND_Z * spread).alias("lower"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, block: tuple[str, ...] = BLOCK_RULES, allow: tuple[str, ...] = ALLOW_RULES,
               max_bad: float = MAX_BAD) -> DataFrame:
    """``page_id, host, path, rule, verdict, mean, lower`` for every row of ``pages`` (page_id, url).

    ``outcomes``: page_id and ``bad`` (boolean) of labelled pages.
    """
    if set(block) & set(allow):
        raise ValueError("a rule can't both block and allow")
    urls = written(pages.select(F.col("page_id"), host_of(F.col("url").cast("string")).alias("host"),
                                path_of(F.col("url").cast("string")).alias("path")), "url-parts")
    seen = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(
        F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    zero = F.lit(0).cast("long")
    # an outcome belongs to one page row: repeated page rows share it
    per_page = urls.groupBy("page_id", "host").agg(F.count("*").alias("pages")).join(seen, "page_id", "left")
    counts = per_page.groupBy("host").agg(F.sum("pages").alias("pages"), F.coalesce(F.sum("n"), zero).alias("n"),
                                          F.coalesce(F.sum("bad"), zero).alias("bad"))
    reputation = written(host_reputation(written(counts, "url-counts")), "url-hosts")
    judged = join_weighted(urls, reputation.select("host", "mean", "lower", "pages"), ["host"], "pages", "inner")
    rule = rule_of(F.col("host"), F.col("path"), [*block, *allow])
    method = F.when(F.col("lower") > max_bad, "block").otherwise("allow")
    by_rule = reduce(lambda c, r: c.when(F.col("rule") == r, "block"), block, F.when(F.lit(False), "")) \
        .when(F.col("rule").isNotNull(), "allow")
    return judged.withColumn("rule", rule).select(
        "page_id", "host", "path", "rule", by_rule.otherwise(method).alias("verdict"), "mean", "lower")
