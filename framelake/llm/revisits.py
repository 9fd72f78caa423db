"""Operator 2: resolution of not-modified revisits in web archives.

A revisit record (a 304 without a body) refers to the latest earlier full response of its canonical URL: an as-of join,
strictly before the revisit's time. Its validators are checked (entity tags, compared weakly, or else Last-Modified),
and the headers that a 304 may update replace the stored ones; all others, the body's length and type among them, stay.

Statuses: full; resolved; mismatch (there is an earlier response but no validator confirms it); orphan (none, or a null
URL or time). Of full responses of one URL and time the smallest record id counts. Header names are case-folded; of
names that then clash the one that sorts last counts. Rows are never dropped, repeated rows are resolved alike, and extra
columns are kept; those named like results are replaced. Null headers are none. URLs of any length are read whole and
compared as they are. An empty table gives an empty result.

The as-of join is two-level, so that no URL's records meet in one task: equal (url, time) pairs are merged first, times
are cut into ranges by quantiles (more of them, the more records there are), windows run within (url, range), and the last response before each range is carried
in from a small table of range ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .url_filter import host_of, path_of

#: What a 304 response may update (HTTP caching rules): fixed values.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"
#: Ranges at least and at most, and records in a range, about.
RANGES, MOST_RANGES, RANGE_ROWS = 64, 1024, 2_000_000


def canonical_url(url: Column) -> Column:
    """Host without port and leading www., path without trailing slash, sorted query without tracking; no scheme and
    no fragment. Null if there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), ":[0-9]*$", ""), r"^www\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    params = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(params != "", F.concat(F.lit("?"), params)).otherwise("")))


def folded(headers: Column) -> Column:
    """Headers with lower-case names; of names that clash the one that sorts last stays, whatever the map's order."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    last = F.filter(entries, lambda e: ~F.exists(entries, lambda o: (F.lower(o["key"]) == F.lower(e["key"])) & (o["key"] > e["key"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def merged(stored: Column, update: Column) -> Column:
    """Stored headers with what the revisit may change."""
    allowed = F.map_filter(update, lambda k, v: k.isin(PERMITTED) & v.isNotNull())
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)


def _tag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], "^W/", "")


def confirms(stored: Column, update: Column) -> Column:
    """Whether the revisit's validators fit the stored response: entity tags if both have one, else Last-Modified."""
    a, b = _tag(stored), _tag(update)
    dates = F.coalesce(stored["last-modified"] == update["last-modified"], F.lit(False))
    return F.when(a.isNotNull() & b.isNotNull(), a == b).otherwise(dates)


def resolve_revisits(records: DataFrame, *, ranges: int | None = None) -> DataFrame:
    """``records``: record_id long, url string, ts long, full boolean, headers map<string,string>. Gives them with
    canonical, status, refers_to and merged (the headers that stand after resolution)."""
    records = records.drop("canonical", "status", "refers_to", "merged", "_h", "_ref").withColumns({"canonical": canonical_url(F.col("url")), "_h": folded(F.col("headers"))})
    usable = records.filter("canonical IS NOT NULL AND ts IS NOT NULL")
    n, fine = usable.agg(F.count("*"), F.percentile_approx("ts", [(i + 1) / MOST_RANGES for i in range(MOST_RANGES - 1)], 10_000)).first()
    ranges = ranges or min(MOST_RANGES, max(RANGES, 1 << (n // RANGE_ROWS).bit_length()))
    step = max(1, MOST_RANGES // ranges)
    cuts = sorted(set((fine or [])[step - 1 :: step]))
    at = F.size(F.filter(F.lit(cuts), lambda cut: F.col("ts") > cut)) if cuts else F.lit(0)
    own = F.when(F.col("full"), F.struct("record_id", F.col("_h").alias("headers")))
    moments = usable.groupBy("canonical", "ts").agg(F.min_by(own, F.when(F.col("full"), F.col("record_id"))).alias("ref")).withColumn("range", at)
    ends = moments.filter("ref IS NOT NULL").groupBy("canonical", "range").agg(F.max_by("ref", "ts").alias("end"))
    grid = moments.select("canonical", "range").distinct().join(ends, ["canonical", "range"], "left")
    carried = grid.withColumn("carry", F.expr("last(end, true) OVER (PARTITION BY canonical ORDER BY range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")).drop("end")
    within = moments.withColumn("here", F.expr("last(ref, true) OVER (PARTITION BY canonical, range ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
    found = within.join(carried, ["canonical", "range"]).select("canonical", "ts", F.coalesce("here", "carry").alias("_ref")).filter("_ref IS NOT NULL")
    # Records without a URL or a time refer to nothing and don't go through the join.
    alone = records.filter("canonical IS NULL OR ts IS NULL").withColumn("_ref", F.lit(None).cast(found.schema["_ref"].dataType))
    joined = usable.join(found, ["canonical", "ts"], "left").unionByName(alone)
    good = F.col("_ref").isNotNull() & confirms(F.col("_ref.headers"), F.col("_h"))
    full = F.coalesce(F.col("full"), F.lit(False))
    status = F.when(full, "full").when(good, "resolved").when(F.col("_ref").isNotNull(), "mismatch").otherwise("orphan")
    return joined.withColumn("status", status).withColumns(
        {
            "refers_to": F.when(F.col("status") == "resolved", F.col("_ref.record_id")),
            "merged": F.when(F.col("status") == "resolved", merged(F.col("_ref.headers"), F.col("_h"))).otherwise(F.col("_h")),
        }
    ).drop("_h", "_ref")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A capture stream for ``pages``: each page's full response, a revisit by entity tag (a stale tag where page_id is
    divisible by 4) and one by Last-Modified, under differently written URLs."""
    tag = F.substring(F.md5("html"), 1, 16)
    stamp = F.concat(F.lit("day "), (F.col("page_id") % 7).cast("string"))
    base = F.col("page_id") * 10

    def headers(**pairs) -> Column:
        return F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k.replace("_", "-")), F.coalesce(v, F.lit("")).cast("string"))))

    def record(k: int, url: Column, full: bool, **pairs) -> Column:
        return F.struct((base + k).alias("record_id"), url.alias("url"), (base + k).alias("ts"), F.lit(full).alias("full"), headers(date=base + k, **pairs).alias("headers"))

    size = F.octet_length("html")
    rows = F.array(
        record(0, F.col("url"), True, ETag=F.concat(F.lit("W/"), tag), Last_Modified=stamp, Content_Length=size, Cache_Control=F.lit("max-age=60")),
        record(3, F.concat("url", F.lit("#again")), False, ETag=F.when(F.col("page_id") % 4 == 0, F.lit("stale")).otherwise(tag), Content_Length=F.lit(0), Cache_Control=F.lit("max-age=90")),
        record(6, F.col("url"), False, Last_Modified=stamp, Content_Length=F.lit(0)),
    )
    return pages.select("page_id", F.explode(rows).alias("r")).select("page_id", "r.*")
