"""Web archive revisits: what a not-modified answer stands for.

A capture of kind `revisit` says that the server answered 304. It is resolved
to the latest strictly earlier full response with the same canonical URL: if
their validators agree, the page is that response, with its headers updated by
those that a not-modified answer may carry.

The lookup is an as-of join without pairs: inside buckets of a URL's captures a
running last value, across buckets the last response of each. A URL with a
third of all captures is spread over many buckets.

Result per revisit: status `resolved`, `mismatch` (validators differ),
`unverified` (none in common), or `no_response` (none earlier); the response's
id where there is one, and the merged headers where resolved.

Defined cases: a revisit with a null URL or time has no response. Responses of
the same URL and time count by the larger id. Of header names that differ in
case only the first counts. Null headers are no headers, a null value is left
out. Repeated revisits are each resolved. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.shared import bucket_of, order_buckets

# Headers that a not-modified answer updates (fixed values, RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case; without fragment, user, default port; a path at least `/`."""
    clean = F.regexp_replace(F.btrim(url), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(clean, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    place = F.lower(F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)", 1))
    rest = F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$", 1)
    place = F.when(scheme == "http", F.regexp_replace(place, ":80$", "")).when(
        scheme == "https", F.regexp_replace(place, ":443$", "")
    ).otherwise(place)
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(scheme == "", clean).otherwise(F.concat(scheme, F.lit("://"), place, path))


def lower_names(headers: Column) -> Column:
    """Headers with lower-case names; the first of names that differ in case only."""
    entries = F.transform(
        F.map_entries(headers), lambda e: F.named_struct(F.lit("key"), F.lower(e["key"]), F.lit("value"), e["value"])
    )
    names = F.transform(entries, lambda e: e["key"])
    first = F.filter(entries, lambda e, i: e["value"].isNotNull() & (F.array_position(names, e["key"]) == i + 1))
    return F.coalesce(F.map_from_entries(first), F.create_map().cast("map<string,string>"))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers, updated and extended by the permitted ones of the fresh answer."""
    allowed = F.map_filter(fresh, lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k))
    return F.map_concat(kept, allowed)


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(
    captures: DataFrame, *, key: str = "record_id", url: str = "url", time: str = "ts", kind: str = "kind",
    headers: str = "headers",
) -> DataFrame:
    """record_id, canonical_url, ts, status, response_id, headers; one row per revisit.

    kind is `response` or `revisit`, others are left out; ts is an integer;
    headers a map of strings.
    """
    rows = captures.where(F.col(kind).isin("response", "revisit")).select(
        F.col(key).alias("record_id"), canonical_url(F.col(url).cast("string")).alias("canonical_url"),
        F.col(time).cast("long").alias("ts"), F.col(kind).alias("kind"), lower_names(F.col(headers)).alias("headers"),
    )
    usable = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    known = rows.where(usable)
    widths = order_buckets(known, "canonical_url", "ts")
    known = known.join(widths, F.col("canonical_url") == F.col("_group")).withColumn("bucket", bucket_of("ts"))
    is_response = F.col("kind") == "response"
    answer = F.when(is_response, F.struct("ts", "record_id", "headers"))
    # A revisit comes before responses of its own time: they are not earlier.
    inside = (
        Window.partitionBy("canonical_url", "bucket").orderBy("ts", is_response.cast("int"), "record_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    across = Window.partitionBy("of_url").orderBy("of_bucket").rowsBetween(Window.unboundedPreceding, -1)
    lasts = known.groupBy(F.col("canonical_url").alias("of_url"), F.col("bucket").alias("of_bucket")).agg(
        F.max_by(answer, F.when(is_response, F.struct("ts", "record_id"))).alias("answer")
    )
    lasts = lasts.select("of_url", "of_bucket", F.last("answer", ignorenulls=True).over(across).alias("before"))
    found = known.select(
        "*", F.last(answer, ignorenulls=True).over(inside).alias("here")
    ).where(~is_response).join(
        lasts, (F.col("canonical_url") == F.col("of_url")) & (F.col("bucket") == F.col("of_bucket"))
    ).select("record_id", "canonical_url", "ts", "headers", F.coalesce("here", "before").alias("answer"))
    lost = rows.where(~usable & ~is_response).select(
        "record_id", "canonical_url", "ts", "headers", F.lit(None).cast(found.schema["answer"].dataType).alias("answer")
    )
    every = found.union(lost)
    stored = F.col("answer.headers")
    fresh_tag, fresh_date, tag, date = (
        m.getItem(name) for m in (F.col("headers"), stored) for name in ("etag", "last-modified")
    )
    both_tags, both_dates = fresh_tag.isNotNull() & tag.isNotNull(), fresh_date.isNotNull() & date.isNotNull()
    agree = F.when(both_tags, _strong(fresh_tag) == _strong(tag)).when(both_dates, fresh_date == date)
    status = (
        F.when(F.col("answer").isNull(), "no_response").when(agree.isNull(), "unverified")
        .when(agree, "resolved").otherwise("mismatch")
    )
    return every.select("*", status.alias("status")).select(
        "record_id", "canonical_url", "ts", "status", F.col("answer.record_id").alias("response_id"),
        F.when(F.col("status") == "resolved", merged_headers(stored, F.col("headers"))).alias("headers"),
    )
