"""URL filter: rules for hosts and paths, and empirical-Bayes reputation of hosts.

Labelled pages give counts of bad and all outcomes per host. A host's share of bad pages is shrunk
towards that of its registered domain, the domain's towards its suffix's and the suffix's towards
the whole table's. Each step is a beta prior with the parent's mean; its strength is estimated
from how far the children of that level scatter beyond chance. A host is blocked if its share is
above a limit with high posterior probability.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavespan.session import stored

#: rule -> verdict; a rule is a host, which covers its subdomains, and the start of a path.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block",
         "org/fr/": "allow"}

#: Second-level labels that form a suffix together with a country's two letters.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "ltd", "mil", "ne", "net", "nhs",
                "nom", "or", "org", "plc", "sch")

#: Further suffixes under which strangers register, in the notation of public suffix lists: a name,
#: ``*.name`` for every name below it, ``!name`` for one that is none after all.
SUFFIXES = ("appspot.com", "blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app",
            "pages.dev", "vercel.app", "wordpress.com", "*.ck", "!www.ck")
#: A list of suffixes has at most so many rules; they become part of the plan.
MOST_SUFFIXES = 50_000

PAIRS = "|".join(SECOND_LEVEL)
ADDRESS = r"^[\d.]*$|^\["

#: A host is blocked if P(share of bad pages > LIMIT) >= CONFIDENCE.
LIMIT = 0.5
CONFIDENCE = 0.9

#: Bounds of the estimated strength of a prior, in pages.
STRENGTH = (1.0, 1000.0)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def bare_name(name: Column) -> Column:
    """The host without user, port and final dot."""
    return F.regexp_replace(F.regexp_replace(name, r"^.*@", ""), r"(:\d*)?\.?(:\d*)?$", "")


def read_suffixes(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The rules of a public suffix list: a rule a line up to its first space, ``//`` comments."""
    rule = F.lower(F.regexp_extract("value", r"^(\S+)", 1))
    lines = spark.read.text(path).select(rule.alias("rule")).where(
        (F.col("rule") != "") & ~F.col("rule").startswith("//")).distinct()
    rules = [r["rule"] for r in lines.limit(MOST_SUFFIXES + 1).collect()]
    if len(rules) > MOST_SUFFIXES:
        raise ValueError(f"more than {MOST_SUFFIXES} rules of suffixes")
    return tuple(sorted(rules))


def parts(name: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """(suffix, domain) of a host.

    The suffix is what an exception leaves, else the longest name that a rule or ``SECOND_LEVEL``
    and a country make a suffix, else the last label; the domain has one label more, or is the
    whole host where there is none. Addresses have the suffix "".
    """
    bare = bare_name(name)
    labels = F.split(bare, r"\.", -1)
    # the host, the host without its first label, and so on
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)),
                        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    exact = [r for r in suffixes if r[0] not in "*!"]
    below = [r[2:] for r in suffixes if r.startswith("*.")]
    never = [r[1:] for r in suffixes if r.startswith("!")]

    def known(tail: Column) -> Column:
        upper = F.regexp_extract(tail, r"^[^.]+\.(.+)$", 1)
        return tail.isin(exact) | upper.isin(below) | tail.rlike(rf"^(?:{PAIRS})\.[a-z]{{2}}$")

    last = F.size(labels)
    first_known = F.array_position(F.transform(tails, known), True)
    first_never = F.array_position(F.transform(tails, lambda t: t.isin(never)), True)
    at = F.when(first_never > 0, F.least(first_never + 1, last)).when(
        first_known > 0, first_known).otherwise(last).cast("int")
    address = bare.rlike(ADDRESS)
    return F.struct(F.when(address, "").otherwise(F.element_at(tails, at)).alias("suffix"),
                    F.when(address, bare).otherwise(
                        F.element_at(tails, F.greatest(at - 1, F.lit(1)))).alias("domain"))


def suffix(name: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    return parts(name, suffixes)["suffix"]


def domain(name: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    return parts(name, suffixes)["domain"]


def fitting_rule(name: Column, where: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits host and path, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        of, _, start = rule.partition("/")
        fits = ((name == of) | name.endswith("." + of)) & where.startswith("/" + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def strength(children: DataFrame) -> float:
    """Strength, in pages, of the beta prior that children (n, bad, mean of their parent) share.

    By moments: the share of a child with n pages scatters around its parent's mean m by
    m (1 - m) / n from chance and by m (1 - m) / (strength + 1) beyond it.
    """
    m, n = F.col("mean"), F.col("n")
    chance = m * (1 - m)
    row = children.where(n > 1).select(
        F.sum(F.pow(F.col("bad") / n - m, 2) * n - chance).alias("beyond"),
        F.sum(chance * (n - 1)).alias("weight")).first()
    if not row["weight"]:
        return STRENGTH[1]
    beyond = row["beyond"] / row["weight"]
    found = 1 / beyond - 1 if beyond > 0 else STRENGTH[1]
    return round(min(max(found, STRENGTH[0]), STRENGTH[1]), 6)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function for x > 0: Stirling's series from x + 10 on, carried down."""
    y = x + 10
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    found = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series
    for i in range(10):
        found = found - np.log(x + i)
    return found


def upper_tail(a: np.ndarray, b: np.ndarray, x: float) -> np.ndarray:
    """P(share > x) under beta distributions, by the continued fraction of the integral."""
    a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b)
                   + a * math.log(x) + b * math.log1p(-x))
    swap = x > (a + 1) / (a + b + 2)
    p, q = np.where(swap, b, a), np.where(swap, a, b)
    z = np.where(swap, 1 - x, x)
    tiny = 1e-300
    c = np.ones_like(p)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    m, change = 0, np.zeros_like(p)
    while np.any(np.abs(change - 1) > 1e-13):  # about sqrt(max(a, b)) steps
        m += 1
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        change = np.ones_like(p)
        for step in (even, odd):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
            change = change * d * c
        if m > 100_000:
            raise ArithmeticError("the continued fraction does not converge")
    below = front * h / p
    return np.where(swap, below, 1 - below)


def p_above(bad: pd.Series, n: pd.Series, mean: pd.Series, k: pd.Series,
            limit: pd.Series) -> pd.Series:
    """P(share > limit) after ``bad`` of ``n`` under a beta prior of that mean and strength."""
    if not len(n):
        return pd.Series([], dtype=float)
    tail = upper_tail(k * mean + bad, k * (1 - mean) + n - bad, float(limit.iloc[0]))
    return pd.Series(np.round(np.clip(tail, 0, 1), 9))


def reputation(pages: DataFrame, outcomes: DataFrame, limit: float = LIMIT,
               suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """A row per host of ``pages`` (page_id, host): n, bad, prior_mean and p_bad, the posterior
    probability that its share of bad pages is above ``limit``.

    ``outcomes`` (page_id, bad 0 or 1): labelled pages; those that are null or name no page are
    left out, and a page labelled twice counts twice. Hosts without a labelled page keep their
    domain's expectation. Without any outcome every host keeps the prior of one bad page in two,
    of strength 2.
    """
    named = pages.select("page_id", F.coalesce("host", F.lit("")).alias("host"))
    hosts = named.select("host").distinct()
    seen = named.join(outcomes.where("bad is not null").select("page_id", "bad"), "page_id")
    counts = seen.groupBy("host").agg(F.count("*").alias("n"),
                                      F.sum(F.col("bad").cast("long")).alias("bad"))
    # distinct hosts and their counts: small beside the pages, read at every level
    hosts = stored(hosts.join(counts, "host", "left").na.fill(0, ["n", "bad"])
                   .withColumn("__parts", parts(F.col("host"), suffixes))
                   .select("host", "n", "bad", "__parts.domain", "__parts.suffix"))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    every = hosts.agg(*sums).first()
    bad, n = (every["bad"] or 0) + 1, (every["n"] or 0) + 2
    parents = hosts.groupBy("suffix").agg(*sums).withColumn("mean", F.lit(bad / n))
    for level, child in (("suffix", "domain"), ("domain", "host")):
        k = strength(parents)
        posterior = (F.col("bad") + k * F.col("mean")) / (F.col("n") + k)
        above = parents.select(level, posterior.alias("mean"))
        below = (hosts.groupBy("domain", "suffix").agg(*sums) if child == "domain"
                 else hosts.select("host", "domain", "n", "bad"))
        parents = below.join(above, level)
        if child == "domain":  # a domain has one suffix
            parents = parents.drop("suffix")
    k = strength(parents) if n > 2 else 2.0
    above_limit = F.pandas_udf(p_above, "double")
    return parents.select("host", "n", "bad", F.col("mean").alias("prior_mean"),
                          above_limit("bad", "n", "mean", F.lit(k), F.lit(limit)).alias("p_bad"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: dict[str, str] = RULES,
          limit: float = LIMIT, confidence: float = CONFIDENCE,
          suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Every row of ``pages`` (page_id, url and any others) with host, path, rule, p_bad, verdict.

    The longest rule that fits decides; else a host goes if its share of bad pages is above
    ``limit`` with probability ``confidence``. ``suffixes`` say under which names strangers
    register (``read_suffixes`` takes them from a list). A null url, or one without ``://``, has an empty
    host and path and is judged as a host of that name. Repeated rows stay;
    columns of the names that are added are replaced.
    """
    pages = pages.drop("host", "path", "rule", "p_bad", "verdict")
    named = (pages.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
             .withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules)))
    known = reputation(named, outcomes, limit, suffixes).select("host", "p_bad")
    verdict = F.when(F.col("p_bad") >= confidence, "block").otherwise("allow")
    for rule, says in rules.items():
        verdict = F.when(F.col("rule") == rule, says).otherwise(verdict)
    return named.join(known, "host").withColumn("verdict", verdict)
