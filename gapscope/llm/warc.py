"""Resolution of not-modified revisits in web archive records.

A revisit record (status 304) stands for the latest earlier full response (status
200) of the same canonical URL; earlier means by (time, record id).  Its validators are
checked against that response: the entity tag by weak comparison if the revisit
carries one, else the modification time.  A resolved revisit gets the response's
payload and its headers, updated by those headers of the revisit that a 304 may update.

The as-of join is a window over (URL, time slot): within a slot the last full response
before a revisit, and for revisits without one the last of the slots before, found by a
window over one row per URL and slot.  So a URL that holds a third of all
records is spread over its slots, and no task orders more than a slot of a URL.

A revisit without id comes before all responses of its second; of responses that share time and record id the one of greatest content digest
counts, whatever the order of the rows; null URLs, records without time and revisits before any response are
``no_earlier_response``; a revisit without validators is ``no_validator``; repeated
records are resolved one by one; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_SECONDS = 3600
# Headers that a not-modified response does not update (RFC 9111, 3.2).
NOT_UPDATED = ("connection", "proxy-connection", "keep-alive", "te", "trailer", "transfer-encoding", "upgrade", "proxy-authenticate",
               "proxy-authentication-info", "proxy-authorization", "content-length", "content-encoding", "content-type", "content-range")
# Query parameters that name a visit, not a resource.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host without www and default port, path without end slash, sorted query without tracking; scheme and fragment go.

    A URI without ``scheme://`` (``urn:``, ``dns:``, relative ones) has no such parts and stays as it is, but for blanks at its ends.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[A-Za-z]+://([^/?]*)", 1)), "^www\\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[A-Za-z]+://[^/?]*([^?]*)", 1), "/+$", "")
    kept = F.filter(F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    parsed = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(bare.rlike("^[A-Za-z]+://"), parsed).otherwise(F.trim(url))


def _tag(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def merged_headers(full: Column, update: Column) -> Column:
    """The stored headers (lower-case names), updated by the permitted ones."""
    allowed = F.map_filter(update, lambda k, v: ~k.isin(*NOT_UPDATED))
    return F.map_concat(F.map_filter(full, lambda k, v: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def header_text(headers: Column) -> Column:
    """``name: value`` lines in name order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def resolve_revisits(records: DataFrame, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """One row per revisit: record_id, url, target_id, state, headers (map), payload.

    ``records`` has record_id long, uri, at (seconds, long), status int, etag, last_modified,
    headers map<string, string> and payload (any type).
    """
    known = records.select("record_id", canonical_url(F.col("uri")).alias("url"), "at", "status", "etag", "last_modified", "headers", "payload")
    full = F.struct("at", "record_id", "etag", "last_modified", "headers", "payload")
    timed = (F.col("status") == 200) & F.col("at").isNotNull() & F.col("record_id").isNotNull()
    # a total order: of equal (at, record_id) revisits come first, then responses by their content
    tie = F.when(timed, F.md5(F.to_json(F.struct("etag", "last_modified", "headers", "payload"))))
    marked = known.where(F.col("url").isNotNull() & F.col("status").isin(200, 304)).select(
        "*", F.floor(F.col("at") / slot_seconds).alias("slot"), F.when(timed, full).alias("full"), tie.alias("tie"))
    before = Window.partitionBy("url", "slot").orderBy("at", "record_id", F.col("status").desc(), "tie").rowsBetween(Window.unboundedPreceding, -1)
    within = marked.withColumn("near", F.last("full", ignorenulls=True).over(before)).where("status = 304")
    # repeated records share (at, record_id): a response is earlier only by a smaller pair
    slots = marked.where("full is not null").groupBy("url", "slot").agg(F.max_by("full", F.struct("at", "record_id", "tie")).alias("last"))
    every = slots.unionByName(within.where("near is null").select("url", "slot").distinct().withColumn("last", F.lit(None).cast(slots.schema["last"].dataType)))
    every = every.groupBy("url", "slot").agg(F.max_by("last", F.col("last").isNotNull()).alias("last"))
    past = Window.partitionBy("url").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("url", "slot", F.last("last", ignorenulls=True).over(past).alias("carried"))
    found = within.join(carried, ["url", "slot"], "left").withColumn("target", F.when(F.col("at").isNotNull(), F.coalesce("near", "carried")))
    lost = known.where(F.col("url").isNull() & (F.col("status") == 304)).withColumn("target", F.lit(None).cast(found.schema["target"].dataType))
    columns = ["record_id", "url", "etag", "last_modified", "headers", "target"]
    found = found.select(columns).unionByName(lost.select(columns))
    same = F.when(F.col("etag").isNotNull(), F.coalesce(_tag(F.col("etag")) == _tag(F.col("target.etag")), F.lit(False))).otherwise(
        F.coalesce(F.col("last_modified") == F.col("target.last_modified"), F.lit(False)))
    state = (F.when(F.col("target").isNull(), "no_earlier_response").when(F.col("etag").isNull() & F.col("last_modified").isNull(), "no_validator")
             .when(same, "resolved").otherwise("validator_mismatch"))
    resolved = F.col("state") == "resolved"
    return found.withColumn("state", state).select(
        "record_id", "url", F.col("target.record_id").alias("target_id"), "state",
        F.when(resolved, merged_headers(F.coalesce("target.headers", F.create_map().cast("map<string,string>")), F.coalesce("headers", F.create_map().cast("map<string,string>")))).alias("headers"),
        F.when(resolved, F.col("target.payload")).alias("payload"))


def _headers(**values: Column) -> Column:
    pairs = F.array(*[F.struct(F.lit(k.replace("_", "-")).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


COMMON_URL = "https://www.common.example.org/index/"


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Archive records made from pages by integer rules.

    Each page is a response of its URL; two pages of three are visited again under another
    spelling of the URL (every fifth of them changed, every eleventh page before its own
    response, every thirteenth with a date instead of a tag); a third of the pages
    give a revisit of one common URL, every fiftieth a response of it.
    """
    p = F.col("page_id")
    at = p * 7919 % 1000003
    digest = F.md5(F.col("html").cast("binary"))
    n = F.length("html")
    base = pages.select(p, F.col("url").cast("string").alias("url"), at.alias("at"), digest.alias("digest"), n.alias("n"))
    tag = F.concat(F.lit('"'), F.col("digest"), F.lit('"'))
    payload = F.struct(F.col("digest").alias("digest"), F.col("n").cast("long").alias("n_chars"))
    full_headers = _headers(content_type=F.lit("text/html; charset=utf-8"), content_length=F.col("n"), etag=tag, last_modified=F.col("at"),
                            cache_control=F.concat(F.lit("max-age="), (p % 7).cast("string")), date=F.col("at"), server=F.lit("origin"))
    later = F.when(p % 11 == 0, F.col("at") - 1).otherwise(F.col("at") + 500 + p % 1000)
    seen = F.when(p % 5 == 0, F.concat(F.lit('"'), F.reverse("digest"), F.lit('"'))).otherwise(F.concat(F.lit("W/"), tag))
    seen = F.when(p % 13 != 0, seen)
    dated = F.when(p % 13 == 0, (F.col("at") - F.when(p % 2 == 0, 0).otherwise(1)).cast("string"))
    spelling = F.regexp_replace(F.regexp_replace("url", "^https://", "HTTPS://WWW."), "^http://", "https://")
    again_headers = lambda etag, when: _headers(etag=etag, date=when, age=p % 9, cache_control=F.concat(F.lit("max-age="), (p % 5).cast("string")),
                                                content_length=F.lit("0"), content_type=F.lit("none"), connection=F.lit("close"))
    none = F.lit(None).cast(base.select(payload.alias("x")).schema["x"].dataType)
    record = lambda k, uri, when, status, etag, changed, headers, body: F.struct(
        (p * 4 + k).alias("record_id"), uri.alias("uri"), when.cast("long").alias("at"), F.lit(status).alias("status"), etag.alias("etag"),
        changed.cast("string").alias("last_modified"), headers.alias("headers"), body.alias("payload"))
    common = F.lit(COMMON_URL)
    made = F.array_compact(F.array(
        record(0, F.col("url"), F.col("at"), 200, tag, F.col("at"), full_headers, payload),
        F.when(p % 3 != 0, record(1, F.concat(spelling, F.lit("#again")), later, 304, seen, dated, again_headers(seen, later), none)),
        F.when(p % 3 == 1, record(2, F.lit("http://common.example.org/index?utm_source=x"), F.col("at") + 7, 304, F.lit(None).cast("string"),
                                  F.lit("1"), again_headers(F.lit(None), F.col("at") + 7), none)),
        F.when(p % 50 == 0, record(3, common, F.col("at"), 200, tag, F.when(p % 100 == 0, F.lit(1)).otherwise(2), full_headers, payload))))
    return base.select(F.inline(made))


#: The same rules and the as-of join for DuckDB.
ORACLE = r"""
WITH base AS (
  SELECT page_id AS p, url, (page_id * 7919) % 1000003 AS ts, md5(html) AS digest, length(html) AS n FROM pages
), records AS (
  SELECT p * 4 AS record_id, url AS uri, ts, 200 AS status, '"' || digest || '"' AS etag, CAST(ts AS VARCHAR) AS last_modified,
         p, digest, n, ts AS full_at FROM base
  UNION ALL
  SELECT p * 4 + 1, regexp_replace(regexp_replace(url, '^https://', 'HTTPS://WWW.'), '^http://', 'https://') || '#again',
         CASE WHEN p % 11 = 0 THEN ts - 1 ELSE ts + 500 + p % 1000 END, 304,
         CASE WHEN p % 13 <> 0 THEN CASE WHEN p % 5 = 0 THEN '"' || reverse(digest) || '"' ELSE 'W/"' || digest || '"' END END,
         CASE WHEN p % 13 = 0 THEN CAST(ts - CASE WHEN p % 2 = 0 THEN 0 ELSE 1 END AS VARCHAR) END, p, NULL, NULL, NULL FROM base WHERE p % 3 <> 0
  UNION ALL
  SELECT p * 4 + 2, 'http://common.example.org/index?utm_source=x', ts + 7, 304, NULL, '1', p, NULL, NULL, NULL FROM base WHERE p % 3 = 1
  UNION ALL
  SELECT p * 4 + 3, 'https://www.common.example.org/index/', ts, 200, '"' || digest || '"', CASE WHEN p % 100 = 0 THEN '1' ELSE '2' END,
         p, digest, n, ts FROM base WHERE p % 50 = 0
), bare AS (
  SELECT *, regexp_replace(trim(uri), '#.*$', '') AS b FROM records
), cut AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^[A-Za-z]+://([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(b, '^[A-Za-z]+://[^/?]*([^?]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))), '&') AS query FROM bare
), known AS (
  SELECT *, CASE WHEN regexp_matches(b, '^[A-Za-z]+://') THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END ELSE trim(uri) END AS curl, ts * 4294967296 + record_id AS place FROM cut
), met AS (
  SELECT r.record_id, r.curl AS url, r.ts, r.p, r.etag, r.last_modified, f.record_id AS target_id, f.etag AS f_etag,
         f.last_modified AS f_modified, f.digest, f.n, f.full_at, f.p AS f_p
  FROM (SELECT * FROM known WHERE status = 304) r
  ASOF LEFT JOIN (SELECT * FROM known WHERE status = 200) f ON r.curl = f.curl AND r.place > f.place
), judged AS (
  SELECT *, CASE WHEN target_id IS NULL THEN 'no_earlier_response' WHEN etag IS NULL AND last_modified IS NULL THEN 'no_validator'
    WHEN CASE WHEN etag IS NOT NULL THEN coalesce(regexp_replace(etag, '^W/', '') = regexp_replace(f_etag, '^W/', ''), false)
              ELSE coalesce(last_modified = f_modified, false) END THEN 'resolved' ELSE 'validator_mismatch' END AS state FROM met
)
SELECT record_id, url, target_id, state,
  CASE WHEN state = 'resolved' THEN 'age: ' || (p % 9) || chr(10) || 'cache-control: max-age=' || (p % 5) || chr(10) || 'content-length: ' || n || chr(10)
    || 'content-type: text/html; charset=utf-8' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || coalesce(etag, f_etag) || chr(10)
    || 'last-modified: ' || full_at || chr(10) || 'server: origin' END AS headers,
  CASE WHEN state = 'resolved' THEN digest END AS payload_digest,
  CASE WHEN state = 'resolved' THEN CAST(n AS BIGINT) END AS payload_chars
FROM judged
"""
