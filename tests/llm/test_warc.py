"""Revisit resolution against a plain scan; the query against its SQL."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from gapscope.llm import catalog, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "record_id long, uri string, at long, status int, etag string, last_modified string, headers map<string,string>, payload string, url string, slot int"


def canonical(url):
    if url is None:
        return None
    bare = re.sub("#.*$", "", url.strip())
    m = re.match(r"[A-Za-z]+://([^/?]*)([^?]*)\??(.*)$", bare)
    if not m:
        return url.strip(" ")
    host = re.sub(r"^www\.|:(80|443)$", "", m[1].lower())
    query = "&".join(sorted(x for x in m[3].split("&") if x and not re.match(warc.TRACKING, x)))
    return host + re.sub("/+$", "", m[2]) + (f"?{query}" if query else "")


def brute(rows):
    out = []
    for i, uri, at, status, etag, changed, headers, _, *_ in rows:
        if status != 304:
            continue
        url = canonical(uri)
        earlier = [r for r in rows if r[3] == 200 and url is not None and canonical(r[1]) == url and None not in (r[2], at, r[0]) and (r[2], r[0]) < (at, -1 if i is None else i)]
        if not earlier:
            out.append((i, url, None, "no_earlier_response", None, None))
            continue
        t = max(earlier, key=lambda r: (r[2], r[0]))
        weak = lambda x: x and re.sub("^W/", "", x)
        same = weak(etag) == weak(t[4]) if etag is not None else changed == t[5]
        state = "no_validator" if etag is None and changed is None else "resolved" if same else "validator_mismatch"
        merged = None
        if state == "resolved":
            merged = {**(t[6] or {}), **{k: v for k, v in (headers or {}).items() if k not in warc.NOT_UPDATED}}
        out.append((i, url, t[0], state, None if merged is None else "\n".join(f"{k}: {merged[k]}" for k in sorted(merged)), t[7] if state == "resolved" else None))
    return sorted(out, key=str)


def test_resolution_matches_a_plain_scan(spark):
    r = random.Random(6)
    urls = ["http://a.org/x", "https://www.A.org/x/", "http://a.org:80/x?utm_source=1#f", "http://a.org/x?b=2&a=1", "https://a.org/x?a=1&b=2&ref=q", None, "", "no url", "http://b.org", "other.org/b", "urn:x:1", "urn:x:2", " dns:a.org"]
    tags = [None, '"1"', 'W/"1"', '"2"']
    rows = []
    for i in range(260):
        full = r.random() < 0.35
        rows.append((r.choice([None, 3, i]) if r.random() < .05 else i, r.choice(urls[:3] if r.random() < .5 else urls), r.choice([None, r.randint(0, 40), r.randint(0, 40_000)]),
                     200 if full else r.choice([304, 304, 304, 404, None]), r.choice(tags), r.choice([None, "m1", "m2"]),
                     r.choice([None, {}, {"etag": "e", "content-length": str(i), "date": str(i)}]), f"body{i}" if full else None, "clash", 1))
    ids = [x[0] for x in rows if x[3] == 200]
    rows = [x for x in rows if not (x[3] == 200 and ids.count(x[0]) > 1)]
    rows += [x for x in rows if x[3] == 304][:5]
    for slot in (7, 3600, 10**6):
        got = warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA).repartition(3), slot)
        got = got.select("record_id", "url", "target_id", "state", warc.header_text(F.col("headers")), "payload").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)
    assert {x[3] for x in brute(rows)} == {"no_earlier_response", "no_validator", "resolved", "validator_mismatch"}


def test_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    cur = con.execute(catalog.ORACLES["op9_revisit_asof"])
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall(), key=str)
    assert sorted(map(tuple, catalog.QUERIES["op9_revisit_asof"](spark, SF).select(names).collect()), key=str) == want and len(want) > 20


def test_empty_and_null_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.resolve_revisits(warc.records_of_pages(empty)).count() == 0
    odd = spark.createDataFrame([(None, None, None), (1, None, None), (2, "http://x", None)], "page_id long, url string, html string")
    assert {r.state for r in warc.resolve_revisits(warc.records_of_pages(odd)).collect()} <= {"no_earlier_response", "no_validator", "resolved", "validator_mismatch"}


def test_uris_without_authority_stay_apart_and_ties_do_not_depend_on_row_order(spark):
    rows = [(1, "http://example.org/a", 5, 200, '"1"', None, {}, "PA", "", 0), (2, "other.org/b", 9, 304, '"1"', None, {}, None, "", 0),
            (3, "urn:a", 5, 200, '"1"', None, {}, "PU", "", 0), (4, "urn:b", 9, 304, '"1"', None, {}, None, "", 0)]
    got = warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.record_id, r.state) for r in got} == {(2, "no_earlier_response"), (4, "no_earlier_response")}
    tied = [(1, "http://a/", 5, 200, '"1"', None, {}, "P1", "", 0), (1, "http://a/", 5, 200, '"2"', None, {}, "P2", "", 0),
            (1, "http://a/", 5, 304, '"1"', None, {}, None, "", 0), (7, "http://a/", 6, 304, '"1"', None, {}, None, "", 0)]
    seen = set()
    for order in ((0, 1, 2, 3), (1, 0, 3, 2), (3, 2, 1, 0)):
        df = spark.createDataFrame([tied[k] for k in order], SCHEMA).coalesce(1)
        seen.add(tuple(sorted((r.record_id, r.state, r.payload) for r in warc.resolve_revisits(df).collect())))
    assert len(seen) == 1 and (1, "no_earlier_response", None) in next(iter(seen))
