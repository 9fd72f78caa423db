"""Operator 1: URL filters by host-suffix and path-prefix expressions.

A rule is a host and a path prefix. It fits a URL if the URL's host is the rule's or a subdomain of it and the URL's
path starts with the rule's. Every URL is expanded into the (host suffix, path prefix) expressions that some rule
could equal, expressions meet rules by an equi-join on a short prefix of their SHA-256, and the whole digest confirms.

Null, empty or malformed URLs have an empty host and path, fit no rule and get the default verdict. URLs of any length
are read whole; repeated rows are judged alike. An empty table gives an empty result, no rules the default verdict. Rules with a null host,
path or verdict are ignored; of equal rules that disagree, block wins. Ties in length go to the longer host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_back, settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8
#: Rules up to this count (about 100 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def digest_of(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def expressions(labels: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Array of struct(host suffix, path prefix): one for each (labels, path length) shape that the URL can fill. The
    shapes are one constant, so the plan doesn't grow with them."""
    every = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(length).alias("length")) for n, length in shapes))
    fitting = F.filter(every, lambda s: (F.size(labels) >= s["n"]) & (F.length(path) >= s["length"]))

    def made(s: Column) -> Column:
        host = F.array_join(F.slice(labels, F.size(labels) - s["n"] + 1, s["n"]), ".")
        return F.struct(host.alias("host"), F.substring(path, F.lit(1), s["length"]).alias("path"))

    return F.transform(fitting, made)


def judge_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of those names in ``pages`` are replaced.

    ``rules`` has host, path and verdict ('allow' or 'block'). One row comes out for each row of ``pages``.
    The shapes (label count, path length) of all rules are read to the driver: their number is bounded by the longest
    host times the longest path, however many rules there are.
    """
    rules = (
        rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
        .na.drop()
        .groupBy("r_host", "r_path")
        .agg(F.max("r_verdict").alias("r_verdict"))  # 'block' > 'allow'
        .withColumn("labels", F.size(F.split("r_host", r"\.", -1)))
        .withColumn("digest", digest_of(F.col("r_host"), F.col("r_path")))
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    )
    shapes = sorted((r[0], r[1]) for r in rules.select("labels", F.length("r_path")).distinct().collect())
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not shapes:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    # Distinct targets first: a host or page that holds a third of all rows is expanded once, and met by broadcast.
    targets = settle(pages.groupBy("host", "path").agg(F.count("*").alias("_n")))
    hits = (
        targets.withColumn("labels", F.split("host", r"\.", -1))
        .select("host", "path", F.explode(expressions(F.col("labels"), F.col("path"), shapes)).alias("e"))
        .withColumn("e_digest", digest_of(F.col("e.host"), F.col("e.path")))
        .withColumn("short", F.substring("e_digest", 1, PREFIX_HEX))
        .join(F.broadcast(rules) if small else rules, "short")
        .filter("e_digest = digest")
    )
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"))
    best = hits.groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), rank).alias("best")
    )
    judged = settle(targets.join(best, ["host", "path"], "left").select("host", "path", "_n", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
    own = [c for c in pages.columns if c not in ("host", "path")]
    return join_back(pages, judged, ["host", "path"], "_n").select(*own, "host", "path", "rule", "verdict")
