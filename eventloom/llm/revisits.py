"""Resolution of not-modified revisit records in web archives.

A revisit names a page that had not changed. It is joined, by canonical URL, to the latest full response before it; if
their validators agree, the revisit takes that response's payload and headers, updated by those headers that a
not-modified answer may carry.

The as-of join looks at each time of a URL once, whatever the number of records at that time, and runs in two steps, so that
a URL with very many captures is not one task: within slices of time of a URL by a window, and across its slices over one
row a slice. Slices hold about equal numbers of times, by quantiles.

Defined cases: a null URL stays null and joins nothing; a record without a time joins nothing; among responses of equal
time the larger record id is the later, and a response without an id is not found; a revisit at the same time as a response
does not see it; record ids may repeat across URLs and times, as a response is known by all three; an entity tag decides
where both sides have one, else Last-Modified does, and without a validator on both sides the status is 'no_validator';
weak tags compare by their opaque part; header names are compared in lower case, and of repeated names the last counts;
a revisit that is repeated gives repeated results, and of responses of one URL, time and record id one counts (by a hash of
what it holds).
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import table

#: Headers that a not-modified answer may update (fixed values).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Times of a URL in a slice, about, and most slices.
SLICE_TIMES, MOST_SLICES = 200_000, 4096


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host without the scheme's default port, path without trailing slash, sorted query without tracking keys, no fragment."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[^:/?#]+://([^/?#]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(u, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^utm_[a-z]+="))), "&")
    return F.when(scheme == "", u).otherwise(F.concat(scheme, F.lit("://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def lower_keys(headers: Column) -> Column:
    """Header names in lower case; of equal names the last counts."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), F.lower(e["key"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def latest_before(records: DataFrame, slices: int | None = None) -> DataFrame:
    """url, at, found_at, found for the times of revisits in records (record_id, url, at, kind): time and id of the latest earlier response, or null."""
    kind = lambda k: F.max(F.when(F.col("kind") == k, F.col("record_id")))
    times = records.filter("url is not null and at is not null").groupBy("url", "at").agg(kind("response").alias("response"), kind("revisit").alias("revisit"))
    if slices is None:
        slices = min(MOST_SLICES, 1 + times.count() // SLICE_TIMES)
    cuts = times.agg(F.percentile_approx("at", [k / slices for k in range(1, slices)], 10 * slices)).first()[0] if slices > 1 else []
    edges = [float("-inf"), *map(float, sorted(set(cuts or []))), float("inf")]
    times = Bucketizer(splits=edges, inputCol="when", outputCol="slice").transform(times.withColumn("when", F.col("at").cast("double"))) if len(edges) > 2 else times.withColumn("slice", F.lit(0.0))
    full = F.when(F.col("response").isNotNull(), F.struct("at", F.col("response").alias("record_id")))
    inside = Window.partitionBy("url", "slice").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    seen = times.withColumn("here", F.max(full).over(inside)).filter("revisit is not null").select("url", "at", "slice", "here")
    ends = times.groupBy("url", "slice").agg(F.max(full).alias("end"))
    before = F.max("end").over(Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    out = seen.join(ends.withColumn("before", before).drop("end"), ["url", "slice"])
    seen = F.coalesce("here", "before")
    return out.select("url", "at", seen["at"].alias("found_at"), seen["record_id"].alias("found"))


def resolve(records: DataFrame, slices: int | None = None) -> DataFrame:
    """One row a revisit: record_id, url, status, response_id, headers, payload.

    records: record_id, url, at (seconds), kind ('response' or 'revisit'), headers (map), payload.
    """
    named = records.select("record_id", canonical_url(F.col("url")).alias("url"), "at", "kind", lower_keys(F.col("headers")).alias("headers"), "payload")
    found = latest_before(named.select("record_id", "url", "at", "kind"), slices)
    revisits = named.filter("kind = 'revisit'").join(found, ["url", "at"], "left")
    content = F.struct(F.col("headers").alias("old"), F.col("payload").alias("old_payload"))
    responses = named.filter("kind = 'response' AND record_id IS NOT NULL").groupBy("url", F.col("at").alias("found_at"), F.col("record_id").alias("found")).agg(
        F.max_by(content, F.xxhash64("payload", F.to_json("headers"))).alias("c")).select("url", "found_at", "found", "c.*")
    both = revisits.drop("payload").join(responses, ["url", "found_at", "found"], "left")
    tag = lambda c: F.regexp_replace(F.col(c)["etag"], "^W/", "")
    date = lambda c: F.col(c)["last-modified"]
    agree = F.when(tag("headers").isNotNull() & tag("old").isNotNull(), tag("headers") == tag("old")).otherwise(date("headers") == date("old"))
    status = F.when(F.col("found").isNull(), "unmatched").when(agree.isNull(), "no_validator").when(agree, "resolved").otherwise("mismatch")
    allowed = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("old", lambda k, v: ~F.array_contains(F.map_keys(allowed), k)), allowed)
    ok = F.col("status") == "resolved"
    return both.withColumn("status", status).select(
        "record_id", "url", "status", F.when(ok, F.col("found")).alias("response_id"),
        F.when(ok, merged).otherwise(F.col("headers")).alias("headers"), F.when(ok, F.col("old_payload")).alias("payload"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A capture history from pages: of each a response and a revisit, later mostly; some revisits carry another entity tag,
    some none, and some come before the response."""
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    at = F.col("page_id") * 60
    responses = pages.select(
        (2 * F.col("page_id")).alias("record_id"), "url", at.alias("at"), F.lit("response").alias("kind"),
        F.create_map(F.lit("ETag"), tag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), at.cast("string"), F.lit("Last-Modified"), (at - 5).cast("string")).alias("headers"),
        F.col("html").alias("payload"))
    k = F.pmod(F.col("page_id"), F.lit(8))
    own = F.when(k == 0, F.lit('"changed"')).when(k != 1, F.concat(F.when(k == 2, "W/").otherwise(""), tag))
    later = at + F.when(k == 7, -30).otherwise(3600)
    revisits = pages.select(
        (2 * F.col("page_id") + 1).alias("record_id"), "url", later.alias("at"), F.lit("revisit").alias("kind"),
        F.map_filter(F.create_map(F.lit("etag"), own, F.lit("date"), later.cast("string"), F.lit("content-length"), F.lit("0"),
                                  F.lit("last-modified"), F.when(k == 1, (at - 5).cast("string"))), lambda k, v: v.isNotNull()).alias("headers"),
        F.lit(None).cast("string").alias("payload"))
    return responses.unionByName(revisits)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(records_of_pages(table(spark, sf_dir, "pages").filter("page_id is not null")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return out.select("record_id", "url", "status", "response_id", lines.alias("headers"), F.sha2("payload", 256).alias("payload_sha256"))


ORACLE = r"""
WITH p AS (SELECT page_id, html, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, page_id * 60 AS ts, page_id % 8 AS k, trim(url) AS u FROM pages WHERE page_id IS NOT NULL),
c AS (SELECT *, CASE WHEN regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) = '' THEN u ELSE
  lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_replace(lower(regexp_extract(u, '^[^:/?#]+://([^/?#]*)', 1)), CASE lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE '^$' END, '')
  || regexp_replace(regexp_extract(u, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '')
  || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^utm_[a-z]+='))), '&'), ''), '') END AS url FROM p),
v AS (SELECT page_id, url, ts + CASE WHEN k = 7 THEN -30 ELSE 3600 END AS ts, k, tag, ts AS own,
             CASE WHEN k = 0 THEN '"changed"' WHEN k <> 1 THEN tag END AS bare, CASE WHEN k = 2 THEN 'W/' || tag WHEN k = 0 THEN '"changed"' WHEN k <> 1 THEN tag END AS etag FROM c),
j AS (SELECT v.*, r.page_id AS rid, r.ts AS rat, r.tag AS rtag, r.html AS rhtml, row_number() OVER (PARTITION BY v.page_id ORDER BY r.ts DESC, r.page_id DESC) AS n
      FROM v LEFT JOIN c r ON r.url = v.url AND r.ts < v.ts),
s AS (SELECT *, CASE WHEN rid IS NULL THEN 'unmatched' WHEN (CASE WHEN bare IS NOT NULL THEN bare = rtag ELSE own - 5 = rat - 5 END) THEN 'resolved' ELSE 'mismatch' END AS status FROM j WHERE n = 1)
SELECT 2 * page_id + 1 AS record_id, url, status, CASE WHEN status = 'resolved' THEN 2 * rid END AS response_id,
  CASE WHEN status = 'resolved' THEN 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || coalesce(etag, rtag) || chr(10) || 'last-modified: ' || coalesce(CASE WHEN k = 1 THEN own - 5 END, rat - 5)
       ELSE 'content-length: 0' || chr(10) || 'date: ' || ts || coalesce(chr(10) || 'etag: ' || etag, '') || coalesce(chr(10) || 'last-modified: ' || CASE WHEN k = 1 THEN own - 5 END, '') END AS headers,
  CASE WHEN status = 'resolved' THEN sha256(rhtml) END AS payload_sha256
FROM s
"""
