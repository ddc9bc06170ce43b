"""WARC: resolve not-modified revisit records to the response they stand for.

Method.  A revisit is joined as of its date to the latest strictly earlier full response of the
same canonical URL.  It is resolved if the validators agree (the ETag by weak comparison, else
Last-Modified); then the response's headers are merged with those of the revisit that a
304 answer may update.  Otherwise the outcome says why not.

The as-of join needs no task that holds a whole URL: dates are cut into slices, the last response
inside a slice comes from a window over (url, slice), and what precedes a slice comes from one row
per (url, slice).

Records: record_id, type ('response' or 'revisit'), uri, date, status, headers (map with
lower-case names), payload.  A full response has status 200 and a payload.  Rows: a null or blank
URI, a null date or a null type match nothing (outcome ``no_response``); null headers are no
headers; several responses of one second: the largest record id counts as the latest; repeated
revisits each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICE_SECONDS = 3600
#: Header fields of a 304 answer that update a stored response (fixed values).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(uri: Column) -> Column:
    """Host and path without scheme, user, ``www``, default port, fragment, tracking parameters and final slash.

    Host in lower case; parameters sorted.  Null and blank URIs give null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(uri), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    head = F.regexp_extract(bare, r"^([^/?]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(head, r"^[^@]*@", "")), r"^www[0-9]*\.|:(80|443)$", "")
    host = F.regexp_replace(host, r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^utm_")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, tail))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Per revisit: record_id, url, date, refers_to, outcome, headers, payload.

    ``outcome`` is resolved, changed (validators differ), unverified (nothing to compare) or
    no_response; headers and payload are null unless resolved, refers_to is the response looked at.
    """
    full = (F.col("type") == "response") & (F.col("status") == 200) & F.col("payload").isNotNull()
    told = F.struct("record_id", "headers", "payload")
    rows = records.select(
        "record_id", F.col("date"), F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>")).alias("headers"),
        "payload", canonical_url(F.col("uri")).alias("url"), F.coalesce(full, F.lit(False)).alias("_full"),
        F.coalesce(F.col("type") == "revisit", F.lit(False)).alias("_revisit"),
    ).where("_full OR _revisit")
    # rows that can match nothing get keys of their own instead of one null key
    lone = F.col("url").isNull() | F.col("date").isNull()
    rows = rows.withColumn("_key", F.when(lone, F.concat(F.lit("\x00"), F.xxhash64("record_id").cast("string"))).otherwise(F.col("url")))
    rows = rows.withColumn("_response", F.when(F.col("_full") & ~lone, told))
    seconds = F.col("date").cast("timestamp").cast("double")
    rows = rows.withColumn("_slice", F.floor(seconds / slice_seconds))
    in_slice = W.partitionBy("_key", "_slice").orderBy("date", "_full", "record_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_near", F.last("_response", ignorenulls=True).over(in_slice))
    slices = rows.groupBy("_key", "_slice").agg(
        F.max_by("_response", F.when(F.col("_response").isNotNull(), F.struct("date", "record_id"))).alias("_last")
    )
    earlier = W.partitionBy("_key").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = slices.withColumn("_far", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
    joined = (
        rows.where("_revisit").alias("r")
        .join(carried.alias("c"), (F.col("r._key") == F.col("c._key")) & F.col("r._slice").eqNullSafe(F.col("c._slice")), "left")
        .select("r.*", F.when(~F.col("r.url").isNull() & F.col("r.date").isNotNull(), F.coalesce("r._near", "c._far")).alias("_found"))
    )
    tag, old_tag = F.col("headers")["etag"], F.col("_found.headers")["etag"]
    day, old_day = F.col("headers")["last-modified"], F.col("_found.headers")["last-modified"]
    agrees = F.when(tag.isNotNull() & old_tag.isNotNull(), _weak(tag) == _weak(old_tag)).when(
        day.isNotNull() & old_day.isNotNull(), F.trim(day) == F.trim(old_day)
    )
    outcome = (
        F.when(F.col("_found").isNull(), "no_response").when(agrees.isNull(), "unverified")
        .when(agrees, "resolved").otherwise("changed")
    )
    new = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    old = F.map_filter(F.col("_found.headers"), lambda k, _: ~F.array_contains(F.map_keys(new), k))
    good = F.col("outcome") == "resolved"
    return joined.withColumn("outcome", outcome).select(
        "record_id", "url", "date", F.col("_found.record_id").alias("refers_to"), "outcome",
        F.when(good, F.map_concat(old, new)).alias("headers"), F.when(good, F.col("_found.payload")).alias("payload"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Crawl records for a table of pages (page_id, url, html): 2 to 4 captures of most pages, 40 of one in 101.

    Every third capture is a full response, the others are revisits.  Dates, URL variants and validators follow from the
    page id and the capture: content changes with every fourth capture, some revisits precede their response, some
    carry a stale or weak tag, and some only a date.
    """
    n = F.coalesce(F.col("page_id").cast("long"), F.lit(0))
    times = F.when(F.pmod(n, F.lit(101)) == 0, 40).otherwise(2 + F.pmod(n, F.lit(3)))
    html = F.col("html").cast("binary")
    rows = pages.select(
        n.alias("n"), "url", F.md5(html).alias("md5"), F.sha2(html, 256).alias("sha"), F.octet_length("html").cast("string").alias("size"), times.alias("times"),
    ).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("k"))
    n, k = F.col("n"), F.col("k")
    version = F.floor(k / 4)
    tag = F.concat(F.lit('"'), F.col("md5"), F.lit("-"), version.cast("string"), F.lit('"'))
    day = F.concat(F.lit("day "), F.pmod(n + version, F.lit(97)).cast("string"))
    early = F.when((F.pmod(n, F.lit(11)) == 0) & (k == 1), -5000).otherwise(0)
    at = F.lit(1_700_000_000) + F.pmod(n * 7919, F.lit(864_000)) + k * 2700 + early
    kind = F.pmod(n + k, F.lit(7))
    sent = F.when(kind == 3, F.lit('"stale"')).when(kind == 5, F.concat(F.lit("W/"), tag)).when(kind == 6, F.lit(None).cast("string")).otherwise(tag)
    full = k % 3 == 0
    of_response = F.create_map(
        F.lit("etag"), tag, F.lit("last-modified"), day, F.lit("content-type"), F.lit("text/html"),
        F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), F.col("size"),
    )
    of_revisit = F.create_map(
        F.lit("etag"), sent, F.lit("last-modified"), day, F.lit("cache-control"), F.concat(F.lit("max-age="), kind.cast("string")),
        F.lit("content-length"), F.lit("0"), F.lit("set-cookie"), F.lit("a=b"),
    )
    return rows.select(
        (n * 64 + k).alias("record_id"), F.when(full, "response").otherwise("revisit").alias("type"),
        F.when(full, F.col("url")).otherwise(F.concat(F.col("url"), F.lit("#again"))).alias("uri"), F.timestamp_seconds(at).alias("date"),
        F.when(full, 200).otherwise(304).alias("status"),
        F.when(full, of_response).otherwise(F.map_filter(of_revisit, lambda _, v: v.isNotNull())).alias("headers"),
        F.when(full, F.concat("sha", F.lit("-"), version.cast("string"))).alias("payload"),
    )
