"""WARC revisits: 304 answers resolved to the response that they stand for, with DataFrame functions.

A revisit takes the latest earlier full response of the same canonical URL: an
as-of join (see asof). Its validators decide what it is worth: entity tags are
compared weakly where both sides have one, else the dates of last change, else
the payload digests; 'unchecked' where none is on both sides. Headers merge as
a cache would: those that a 304 may update come from the revisit, all others
from the response.

Defined results: a null or blank URL, or a null time, resolves to nothing; a
revisit without an earlier response is an 'orphan'; of responses at one time
the larger record id counts; revisits at the same time as a response are not
later than it; null headers are no headers, and header names are compared in
lower case, the alphabetically last value counting where names clash; of repeated responses
the least payload counts, and payload columns of an output's name replace it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import asof
from .common import OWN

#: Header fields that a 304 response updates.
UPDATED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that don't tell pages apart.
TRACKING = "^(utm_[a-z]*|ref|fbclid|gclid|sessionid)="


def canonical_url(url: Column) -> Column:
    """host/path?query without scheme, www. or m., default port, fragment, tracking parameters and trailing slash or index page."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), "^(www|m)[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/(index[.]html?)?$", "")
    params = F.filter(F.split(F.regexp_extract(rest, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.sort_array(params), "&")
    out = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.trim(url) != "", out)


def lowered(headers: Column) -> Column:
    """A header map with lower-case names; sorted, the last of a name counts."""
    entries = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    last = F.filter(entries, lambda e, i: (i == F.size(entries) - 1) | (e["key"] != F.coalesce(F.try_element_at(entries, i + 2)["key"], F.lit(""))))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def merged_headers(full: Column, revisit: Column) -> Column:
    """The headers of the resolved answer, both maps lowered."""
    names = F.array(*map(F.lit, UPDATED))
    update = F.map_filter(revisit, lambda k, v: F.array_contains(names, k) & v.isNotNull())
    keep = F.map_filter(full, lambda k, v: ~F.map_contains_key(update, k))
    return F.map_concat(keep, update)


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.try_element_at(headers, F.lit("etag")), "^W/", "")


def resolve_revisits(records: DataFrame, payload_cols: tuple[str, ...] = ()) -> DataFrame:
    """A row for each revisit: record_id, ts, url_key, full_id, full_ts, verdict, headers and payload columns.

    records has record_id, ts (whole numbers), url, kind ('response' or
    'revisit'), status, headers (map) and digest; a full response is one of
    kind 'response' with status 200. payload_cols of the full response are
    joined to the answers whose validators hold or aren't there.
    """
    r = records.select(
        F.col("record_id"), F.col("ts").cast("long").alias("ts"), canonical_url(F.col("url")).alias("url_key"), F.col("kind"), F.col("status"), lowered(F.col("headers")).alias("headers"), F.col("digest")
    )
    lost = r.where("kind = 'revisit' and (url_key is null or ts is null)").withColumn("full", F.lit(None).cast(f"struct<ts:bigint,record_id:{records.schema['record_id'].dataType.simpleString()},headers:map<string,string>,digest:string>"))
    r = r.where("url_key is not null and ts is not null")
    # Maps don't order; the offer is the time and id, its headers and digest come along as JSON.
    offer = F.when((F.col("kind") == "response") & (F.col("status") == 200), F.struct("ts", "record_id", F.to_json("headers").alias("headers"), "digest"))
    found = asof.latest_earlier(r, ["url_key"], "ts", offer, F.col("kind") == "revisit", "full")
    found = found.withColumn(
        "full", F.when(F.col("full").isNotNull(), F.struct(F.col("full.ts").alias("ts"), F.col("full.record_id").alias("record_id"), F.from_json("full.headers", "map<string,string>").alias("headers"), F.col("full.digest").alias("digest")))
    )
    out = found.unionByName(lost)
    full = F.coalesce(F.col("full.headers"), F.create_map().cast("map<string,string>"))
    tag, full_tag = _tag(F.col("headers")), _tag(full)
    date, full_date = (F.try_element_at(h, F.lit("last-modified")) for h in (F.col("headers"), full))
    same = F.coalesce(tag == full_tag, date == full_date, F.col("digest") == F.col("full.digest"))
    verdict = F.when(F.col("full").isNull(), "orphan").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("changed")
    out = out.select(
        "record_id", "ts", "url_key", F.col("full.record_id").alias("full_id"), F.col("full.ts").alias("full_ts"), verdict.alias("verdict"),
        F.when(verdict.isin("resolved", "unchecked"), merged_headers(full, F.col("headers"))).alias("headers"), F.col("full.digest").alias("digest"),
    )
    if payload_cols:
        # One payload of each record, the least of repeated ones; a payload column wins over an output of its name.
        own = {c: f"{OWN}payload_{i}" for i, c in enumerate(payload_cols)}
        payload = records.where("kind = 'response' and status = 200").groupBy(F.col("record_id").alias("full_id")).agg(F.min(F.struct(*(F.col(c).alias(own[c]) for c in payload_cols))).alias(OWN + "payload"))
        holds = F.col("verdict").isin("resolved", "unchecked")
        out = out.join(payload, "full_id", "left").withColumns({c: F.when(holds, F.col(f"{OWN}payload.{own[c]}")) for c in payload_cols}).drop(OWN + "payload")
    return out


def capture_stream(pages: DataFrame, later: int = 1000) -> DataFrame:
    """pages as the record stream of a crawler that asks for each page again `later` pages on, and is told 304.

    Page p is captured in full at time 2 p, with its md5 as entity tag, and
    revisited at 2 (p + later) + 1 with that tag, unless the page's URL was
    captured anew meanwhile.
    """
    digest = F.md5(F.coalesce("html", F.lit("")))
    tag = F.concat(F.lit('"'), digest, F.lit('"'))
    day = F.concat(F.lit("day "), (F.col("page_id") % 7).cast("string"))
    full = pages.select(
        (2 * F.col("page_id")).alias("record_id"), (2 * F.col("page_id")).alias("ts"), "url", F.lit("response").alias("kind"), F.lit(200).alias("status"),
        F.create_map(F.lit("ETag"), tag, F.lit("Content-Length"), F.length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("Date"), day).alias("headers"), digest.alias("digest"),
    )
    again = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"), (2 * (F.col("page_id") + later) + 1).alias("ts"), "url", F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("Content-Length"), F.lit("0"), F.lit("Date"), F.concat(F.lit("later "), day)).alias("headers"), F.lit(None).cast("string").alias("digest"),
    )
    return full.unionByName(again)
