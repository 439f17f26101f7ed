"""WARC revisits: a not-modified capture gets the latest earlier full response of its URL.

Records have record_id, record_type (`response`, `revisit`, others pass), url, ts, headers
(map of lower-case names) and payload. URLs are compared in canonical form. The as-of join
is two windows: within a canonical URL and an hour (grain), then over the hours' last responses,
so a hot URL is split by time and only one row an hour of it meets in one task. Only ids,
times and validators go through the windows; headers and payload are joined by id.

A revisit is resolved if its validators agree: its ETag (weak comparison) with the
response's, or without an ETag its Last-Modified. Then its payload is the response's, and
its headers are the response's with those that a 304 may update taken from the revisit
(RFC 9110, 15.4.5). Otherwise payload and headers stay and `outcome` says why:
no_earlier_response, no_validator, etag_differs, last_modified_differs.

Cases: earlier means a smaller ts; of responses at one ts the largest record_id counts. A
null url or ts never finds a response. Null headers are empty. Repeated rows are resolved
each; if a record_id is repeated among responses, one of its rows (the first by payload)
is used. Records other than response and revisit have a null outcome. Columns beyond the
six pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muxlake.llm.common import cut, free_name

#: Headers of a 304 response that update the stored ones.
UPDATED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
ORIGIN = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"


def canonical_url(url) -> Column:
    """Host without www., user and default port, path without a last slash, query without tracking, sorted; no scheme, no fragment."""
    url = F.regexp_replace(url, "#.*$", "")
    host = F.lower(F.regexp_extract(url, ORIGIN, 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), ":(80|443)$", ""), r"^www\.", "")
    rest = F.regexp_replace(url, ORIGIN, "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^?]*", 0), "/+$", "")
    params = F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")
    params = F.array_join(F.array_sort(F.filter(params, lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    return F.concat(host, path, F.when(params != "", F.concat(F.lit("?"), params)).otherwise(""))


def weak(etag) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame, grain: str = "hour") -> DataFrame:
    """The columns of records with headers and payload resolved, and a struct `revisit` (canonical_url, refers_to, outcome) as last column."""
    header = lambda name: F.element_at(F.col("headers"), name)
    is_response = F.col("record_type") == "response"
    rows = records.select(F.struct(*[records[c] for c in records.columns]).alias("row"), *[records[c].alias(c) for c in ("record_id", "record_type", "ts", "headers")], canonical_url(records["url"]).alias("canonical"))
    keys = rows.where("record_type IN ('response', 'revisit') AND canonical IS NOT NULL AND ts IS NOT NULL").select(
        "canonical", "ts", F.date_trunc(grain, "ts").alias("hour"), "record_id", is_response.alias("full"),
        F.when(is_response, F.struct("ts", "record_id", weak(header("etag")).alias("etag"), header("last-modified").alias("modified"))).alias("own"),
    )
    # Strictly earlier: up to the previous ts.
    w = Window.partitionBy("canonical", "hour").orderBy(F.unix_micros("ts")).rangeBetween(Window.unboundedPreceding, -1)
    near = keys.withColumn("near", F.max("own").over(w))
    hours = keys.groupBy("canonical", "hour").agg(F.max("own").alias("last"))
    w = Window.partitionBy("canonical").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("canonical", "hour", F.max("last").over(w).alias("far"))
    found = near.where(~F.col("full")).join(hours, ["canonical", "hour"]).select(F.col("record_id").alias("__id"), F.col("canonical").alias("__url"), F.col("ts").alias("__ts"), F.coalesce("near", "far").alias("found"))
    found = found.where("found IS NOT NULL").distinct()
    etag, modified = weak(header("etag")), header("last-modified")
    outcome = (
        F.when(F.col("found").isNull(), "no_earlier_response")
        .when(etag.isNotNull(), F.when(etag.eqNullSafe(F.col("found.etag")), "resolved").otherwise("etag_differs"))
        .when(modified.isNotNull(), F.when(modified.eqNullSafe(F.col("found.modified")), "resolved").otherwise("last_modified_differs"))
        .otherwise("no_validator")
    )
    # Revisits are small rows: they are judged first, then only the resolved ones meet the responses, whose payloads are shuffled once.
    is_revisit = F.col("record_type") == "revisit"
    judged = rows.where(is_revisit).join(found, (F.col("record_id") == F.col("__id")) & (F.col("canonical") == F.col("__url")) & (F.col("ts") == F.col("__ts")), "left").withColumn("outcome", outcome)
    judged = cut(judged.select("row", "headers", "canonical", F.when(F.col("outcome") == "resolved", F.col("found.record_id")).alias("refers_to"), "outcome"))
    stored = rows.where(is_response).groupBy(F.col("record_id").alias("stored_id")).agg(F.min_by(F.struct(F.col("headers").alias("h"), F.col("row.payload").alias("p")), F.coalesce("row.payload", F.lit(""))).alias("stored"))
    resolved = judged.where("refers_to IS NOT NULL").join(stored, F.col("refers_to") == F.col("stored_id"))
    none = F.from_json(F.lit("{}"), "map<string,string>")
    fresh = F.map_filter(F.coalesce("headers", none), lambda k, v: k.isin(UPDATED))
    kept = F.map_filter(F.coalesce("stored.h", none), lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    name = free_name(records, "revisit")

    def columns(refers_to: Column, outcome: Column, **cells: Column) -> list[Column]:
        return [*(cells[c].alias(c) if c in cells else F.col("row").getField(c).alias(c) for c in records.columns), F.struct(F.col("canonical").alias("canonical_url"), refers_to.alias("refers_to"), outcome.alias("outcome")).alias(name)]

    nothing = F.lit(None).cast(records.schema["record_id"].dataType)
    done = resolved.select(*columns(F.col("refers_to"), F.col("outcome"), headers=F.map_concat(kept, fresh), payload=F.col("stored.p")))
    open_ = judged.where("refers_to IS NULL").select(*columns(nothing, F.col("outcome")))
    rest = rows.where(~F.coalesce(is_revisit, F.lit(False))).select(*columns(nothing, F.when(is_response, "full")))
    return rest.unionByName(open_).unionByName(done)
