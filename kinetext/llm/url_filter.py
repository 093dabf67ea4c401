"""URL filtering: rules are indexed by their rarest literal token, tokens of a
URL fetch candidate rules, and only those run their regular expression.

DataFrame functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class Rule:
    """A pattern over host and path. ``base`` rules decide first, the longest of them; then the longest of the others."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]  # whole tokens that any URL it fits must have
    base: bool = False


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host with all its subdomains and a path prefix."""
    whole = re.findall(r"[0-9a-z]+(?=[^0-9a-zA-Z])", path)  # the last token of a prefix may go on, so it does not count
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(re.findall(r"[0-9a-z]+", host)) + tuple(x for x in whole), True)


#: Rules of the production query: host, path, verdict.
BASE_RULES = [host_rule(*x) for x in (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))]
#: What the filter adds: words of hosts and addresses that a crawl for training text leaves out.
WORD_RULES = [
    Rule("spam-host", "block", r"^[^/]*\bspam\b", ("spam",)),
    Rule("pill-shop", "block", r"^[^/]*\bcheap-pills\b", ("pills",)),
    Rule("casino-host", "block", r"^[^/]*\bcasino\b", ("casino",)),
    Rule("adult-host", "block", r"^[^/]*\bxxx\b", ("xxx",)),
    Rule("login-page", "block", r"/login(?:[/.]|$)", ("login",)),
    Rule("signin-page", "block", r"/signin(?:[/.]|$)", ("signin",)),
]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty if there is none."""
    return F.coalesce(C.lower_az(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_index(spark: SparkSession, addresses: DataFrame, rules: list[Rule]) -> DataFrame:
    """Columns token, no, regex: each rule under its token that the fewest addresses (column tokens) have, rules without a token under ''. A larger no decides first."""
    regexes = spark.createDataFrame([(no, r.regex) for no, r in enumerate(rules)], "no int, regex string")
    held = spark.createDataFrame([(no, t) for no, r in enumerate(rules) for t in r.tokens], "no int, token string")
    wanted = held.select("token").distinct()
    counts = addresses.select(F.explode("tokens").alias("token")).join(C.sized_broadcast(wanted, F.length("token")), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = held.join(counts, "token", "left").groupBy("no").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token"))["token"].alias("token"))
    return C.materialize(regexes.join(rarest, "no", "left").select(F.coalesce("token", F.lit("")).alias("token"), "no", "regex"), "rules")


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the base rule that decided, else null), ``method_rule`` (the added rule that decided, else null) and ``verdict``.

    A null URL, or one without ://, has an empty host and path, fits no rule
    and gets the default. Repeated rows are judged each. Rules that tie in
    length are decided by name. Columns of ``pages`` named like a new one are
    replaced; its columns must be of types that can be grouped (no maps), and
    may have any names.
    """
    rules = sorted(BASE_RULES + WORD_RULES if rules is None else rules, key=lambda r: (r.base, len(r.name), r.name))
    spark, url = pages.sparkSession, F.col(f"`{url_col}`").cast("string")
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "method_rule", "verdict")]
    row = C.free_name(pages, "__row")
    # The caller's columns travel as one struct, so that their names meet no others.
    own = F.struct(F.monotonically_increasing_id().alias(row), *(F.col(f"`{c}`") for c in kept))
    split = pages.select(own.alias("own"), host_of(url).alias("host"), path_of(url).alias("path"))
    words = F.split(C.lower_az(F.concat("host", "path")), "[^0-9a-z]+")
    split = split.withColumn("tokens", F.array_append(F.array_distinct(F.filter(words, lambda t: t != "")), F.lit("")))
    index = C.sized_broadcast(rule_index(spark, split.select("tokens"), rules), F.length("token") + F.length("regex"))
    # All tokens of a row are in one task, so the partial aggregate leaves one record of it to shuffle.
    hits = split.select("own", "host", "path", F.explode("tokens").alias("token")).join(index, "token", "left")
    fits = F.expr("concat(host, path) rlike regex")
    best = hits.groupBy("own", "host", "path").agg(F.max(F.when(fits, F.col("no"))).alias("best"))
    names = spark.createDataFrame([(no, r.name if r.base else None, None if r.base else r.name, r.verdict) for no, r in enumerate(rules)], "best int, rule string, method_rule string, said string")
    done = best.join(C.sized_broadcast(names, F.lit(200)), "best", "left")
    return done.select(*(F.col(f"own.`{c}`") for c in kept), "host", "path", "rule", "method_rule", F.coalesce("said", F.lit(default)).alias("verdict"))
