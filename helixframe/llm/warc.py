"""Not-modified revisits in a web archive: each takes its content from the latest earlier full response of the same URL.

The as-of join works on (URL, time slice): a window finds the latest response within the slice, a second one, over one row
for each URL and slice, carries the latest response of earlier slices in.  A URL with very many captures is so dealt over as
many tasks as it has slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a not-modified response may update in the stored one.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not change the resource.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid)="


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without trailing slashes, query sorted without tracking
    parameters; no scheme and no fragment.  Null stays null; a text without "://" counts as host and path."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(bare, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def resolve(captures: DataFrame, slices: int | None = None) -> DataFrame:
    """captures (record_id, url, ts BIGINT, status INT, etag, last_modified, headers MAP, payload) to one row for each
    status-304 capture: record_id, canonical_url, ts, target_id, outcome, headers, payload.

    target_id is the status-200 capture of the same canonical URL with the largest ts below the revisit's own (of equal
    ones the largest record_id).  outcome: resolved, where the revisit's etag equals the target's, or, if it has none, its
    last_modified does; changed, where the validators differ or are missing; orphan without a target, also where url or ts
    is null.  Only resolved rows have headers (the target's, updated by the revisit's PERMITTED fields) and payload.
    """
    slices = slices or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = captures.where("status in (200, 304)").select("record_id", canonical_url(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"), "status", "etag", "last_modified", "headers", "payload")
    bounds = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    lo, hi = (bounds["lo"] or 0, bounds["hi"] or 0) if bounds else (0, 0)
    width = max(1, -(-(hi - lo + 1) // slices))
    rows = rows.withColumn("slice", F.floor((F.col("ts") - F.lit(lo)) / F.lit(width)))
    usable = rows.where("canonical_url is not null and ts is not null")
    response = F.struct("ts", "record_id", "etag", "last_modified", "headers", "payload")
    full = F.when(F.col("status") == 200, response)
    own = usable.withColumn("near", F.last(full, ignorenulls=True).over(Window.partitionBy("canonical_url", "slice").orderBy("ts", F.col("status").desc(), "record_id").rowsBetween(Window.unboundedPreceding, 0)))
    ends = usable.where("status = 200").groupBy("canonical_url", "slice").agg(F.max_by(response, F.struct("ts", "record_id")).alias("last"))
    needed = usable.select("canonical_url", "slice").distinct().join(ends, ["canonical_url", "slice"], "left")
    carried = needed.withColumn("before", F.last("last", ignorenulls=True).over(Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    revisits = own.where("status = 304").join(carried, ["canonical_url", "slice"], "left").withColumn("target", F.coalesce("near", "before")).drop("near", "before")
    unusable = rows.where("status = 304 and (canonical_url is null or ts is null)")
    revisits = revisits.unionByName(unusable, allowMissingColumns=True)
    same = F.when(F.col("etag").isNotNull(), F.col("etag") == F.col("target.etag")).otherwise(F.col("last_modified") == F.col("target.last_modified"))
    outcome = F.when(F.col("target").isNull(), "orphan").when(F.coalesce(same, F.lit(False)), "resolved").otherwise("changed")
    allowed = F.map_filter(F.coalesce("headers", F.expr("map()").cast("map<string,string>")), lambda k, _: F.lower(k).isin(*PERMITTED))
    stale = F.map_filter(F.coalesce("target.headers", F.expr("map()").cast("map<string,string>")), lambda k, _: ~F.array_contains(F.transform(F.map_keys(allowed), F.lower), F.lower(k)))
    done = F.col("outcome") == "resolved"
    return revisits.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "ts", F.col("target.record_id").alias("target_id"), "outcome", F.when(done, F.map_concat(stale, allowed)).alias("headers"), F.when(done, F.col("target.payload")).alias("payload")
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures that follow from a table of pages: for each page a full response at ts = 10 page_id, and a revisit 50,005
    later under another spelling of its URL.  The first digit of the page's MD5 decides the revisit's validators: 0-3 an
    outdated etag, 4-7 only a Last-Modified date, 8-f the page's own etag.  The payload is the page's html."""
    md5 = F.md5(F.coalesce("html", F.lit("")))
    digit = F.substr(md5, F.lit(1), F.lit(1))
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), md5.alias("md5"), digit.alias("digit"), F.length(F.coalesce("html", F.lit(""))).cast("string").alias("size"))
    day = F.concat(F.lit("day-"), F.substr("md5", F.lit(2), F.lit(6)))
    full = base.select(
        F.concat(F.lit("r"), F.col("page_id")).alias("record_id"), "url", (F.col("page_id") * 10).alias("ts"), F.lit(200).alias("status"), F.col("md5").alias("etag"), day.alias("last_modified"),
        F.create_map(F.lit("content-length"), "size", F.lit("content-type"), F.lit("text/html"), F.lit("etag"), "md5", F.lit("last-modified"), day).alias("headers"), F.col("html").alias("payload"),
    )
    tag = F.when(F.col("digit") < "4", "old").when(F.col("digit") >= "8", F.col("md5"))
    spelled = F.regexp_replace(F.concat(F.regexp_replace("url", "^https?://(www[.])?", "HTTP://WWW."), F.lit("#again")), "^(HTTP://WWW[.][^/]*)/", "$1:80/")
    again = base.select(
        F.concat(F.lit("v"), F.col("page_id")).alias("record_id"), spelled.alias("url"), (F.col("page_id") * 10 + 50005).alias("ts"), F.lit(304).alias("status"), tag.alias("etag"), day.alias("last_modified"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), (F.col("page_id") * 10 + 50005).cast("string"), F.lit("set-cookie"), F.lit("a=1")).alias("headers"), F.lit(None).cast("string").alias("payload"),
    )
    return full.union(again)
