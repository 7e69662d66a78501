"""Not-modified revisits of a web archive resolved to the responses they stand for.

A revisit (a server's "not modified") has no payload.  It stands for the latest full response of the
same canonical url before it, if its validators agree with that response's; its headers then update the
stored ones as far as caches may take them over.

The as-of join is a union and two windows: all records are cut into blocks of time by quantiles, the last
response before a record is sought within (url, block), and where there is none the last one of the
earlier blocks is carried in, from one row for each url and block.  A url with a large share of all
records is so dealt over the blocks of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tastegrid.llm.common import query, shielded
from tastegrid.llm.url_filter import url_parts
from tastegrid.sources.tables import read_table

TIME_BLOCKS = 64
#: Query parameters that do not name another resource.
TRACKING = r"^(utm_[^=]*|fbclid|gclid|msclkid|mc_cid|mc_eid|ref)(=|$)"
#: Header fields of a not-modified response that never replace stored ones, besides those that its
#: Connection field names.
NOT_MERGED = ("connection", "proxy-connection", "keep-alive", "te", "transfer-encoding", "upgrade", "trailer",
              "proxy-authenticate", "proxy-authorization", "content-encoding", "content-type", "content-range",
              "content-length")


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without slash at its end, other than
    tracking parameters in order; null without ``://``.  Scheme and fragment do not count."""
    host, path = url_parts(url)
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(path, r"/+$", "")
    asked = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    parameters = F.array_sort(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(parameters) > 0, F.concat(F.lit("?"), F.array_join(parameters, "&"))).otherwise(F.lit(""))
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, tail))


def _opaque(etag: Column) -> Column:
    """The tag without its weakness mark: validators of a not-modified answer compare weakly."""
    return F.regexp_replace(F.trim(etag), r"^W/", "")


def _field(headers: Column, name: str) -> Column:
    return F.try_element_at(headers, F.lit(name))


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored fields with those of the update that may be taken over; names in lower case."""
    named = F.transform(F.split(F.coalesce(_field(update, "connection"), F.lit("")), ","), lambda x: F.lower(F.trim(x)))
    allowed = F.map_filter(update, lambda k, v: ~k.isin(*NOT_MERGED) & ~F.array_contains(named, k) & v.isNotNull())
    kept = F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k))
    return F.map_concat(kept, allowed)


def _lower_names(headers: Column) -> Column:
    """Names in lower case; of several that then agree the last in the order of the given names."""
    entries = F.array_sort(F.map_entries(headers))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    last = F.filter(F.transform(entries, lambda e, i: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"),
                                                             i.alias("i"))),
                    lambda e: ~F.array_contains(F.slice(names, e["i"] + 2, F.size(names) + 1), e["key"]))
    made = F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))
    return F.coalesce(made, F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")))


@shielded("record_id", "url", "time", "kind", "headers")
def resolve(records: DataFrame, record_id: str = "record_id", url: str = "url", time: str = "time",
            kind: str = "kind", headers: str = "headers") -> DataFrame:
    """One row for each revisit in ``records``, with all its columns and canonical_url, response_id, outcome, merged.

    ``kind`` is "response" or "revisit" (other rows are passed over), ``time`` a number, ``headers`` a map of
    names to values.  outcome is "resolved"; "no_response" (none of that url earlier; also for null urls and
    times); "mismatch" (an entity tag, or without one a date of change, that differs from the response's or that
    the response lacks); or "no_validator" (the revisit has neither).  Only a resolved one has response_id
    and merged.  Responses at the revisit's own time are not earlier; of several at one time the greatest id counts.
    Every revisit stays, repeated rows too; null headers are empty.  Columns of the added names are replaced, others are carried whatever their names;
    an empty table gives an empty table.
    """
    records = records.drop("canonical_url", "response_id", "outcome", "merged")
    names = records.columns
    rows = (records.where(F.col(kind).isin("response", "revisit"))
            .withColumns({"_u": canonical_url(F.col(url)), "_t": F.col(time).cast("long"),
                          "_h": _lower_names(F.col(headers)), "_is": (F.col(kind) == "response").cast("int")}))
    shares = [i / TIME_BLOCKS for i in range(1, TIME_BLOCKS)]
    bounds = rows.agg(F.percentile_approx("_t", shares, 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(b).cast("long") for b in sorted(set(bounds))]) if bounds else F.array().cast("array<bigint>")
    rows = rows.withColumn("_block", F.size(F.filter(bounds, lambda b: b <= F.col("_t"))))
    stored = F.when(F.col("_is") == 1, F.struct(F.col("_t").alias("t"), F.col(record_id).alias("id"), F.col("_h").alias("h")))
    rows = rows.withColumn("_r", F.when(F.col("_u").isNotNull() & F.col("_t").isNotNull(), stored))
    before = (Window.partitionBy("_u", "_block").orderBy("_t", "_is", record_id)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = rows.withColumn("_near", F.last("_r", ignorenulls=True).over(before)).where(F.col("_is") == 0)
    ends = (rows.where(F.col("_r").isNotNull()).groupBy("_u", "_block")
            .agg(F.max_by("_r", F.struct("_t", record_id)).alias("_end")))
    blocks = rows.where(F.col("_u").isNotNull()).select("_u", "_block").distinct()
    earlier = Window.partitionBy("_u").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (blocks.join(ends, ["_u", "_block"], "left")
               .withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
               .where(F.col("_carried").isNotNull()))
    found = near.join(carried, ["_u", "_block"], "left").withColumn("_f", F.coalesce("_near", "_carried"))
    found = found.withColumn("_f", F.when(F.col("_t").isNotNull(), F.col("_f")))
    tag, changed = _field(F.col("_h"), "etag"), _field(F.col("_h"), "last-modified")
    agrees = F.when(tag.isNotNull(), _opaque(tag) == _opaque(_field(F.col("_f.h"), "etag"))).otherwise(
        F.trim(changed) == F.trim(_field(F.col("_f.h"), "last-modified")))
    outcome = (F.when(F.col("_f").isNull(), "no_response").when(tag.isNull() & changed.isNull(), "no_validator")
               .when(F.coalesce(agrees, F.lit(False)), "resolved").otherwise("mismatch"))
    good = F.col("outcome") == "resolved"
    return (found.withColumn("outcome", outcome)
            .select(*names, F.col("_u").alias("canonical_url"), F.when(good, F.col("_f.id")).alias("response_id"),
                    "outcome", F.when(good, merged_headers(F.col("_f.h"), F.col("_h"))).alias("merged")))


def page_records(pages: DataFrame) -> DataFrame:
    """A crawl told from ``pages``: each page is a full response, and later a revisit with its validators.

    Times follow page_id; entity tags are digests of the html.  Some responses and revisits lack the one or
    other validator, as servers do, so that every outcome occurs.
    """
    p = F.col("page_id")
    digest = F.md5(F.coalesce("html", F.lit("")))
    strong = F.concat(F.lit('"'), digest, F.lit('"'))
    seen = p * 60
    day = (seen - F.pmod(seen, F.lit(86_400))).cast("string")
    response = F.create_map(
        F.lit("ETag"), F.when(F.pmod(p, F.lit(8)) == 0, None).when(F.pmod(p, F.lit(8)) == 1, F.concat(F.lit("W/"), strong)).otherwise(strong),
        F.lit("Last-Modified"), F.when(F.pmod(p, F.lit(5)) == 0, None).otherwise(day),
        F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.length("html").cast("string"),
        F.lit("Date"), seen.cast("string"), F.lit("Server"), F.lit("origin"))
    later = seen + 60 * (1 + F.pmod(p * 7_919, F.lit(20_000)))
    revisit = F.create_map(
        F.lit("ETag"), F.when(F.pmod(p, F.lit(3)) == 0, None).otherwise(strong),
        F.lit("Last-Modified"), F.when(F.pmod(p, F.lit(7)) == 0, None).otherwise(day),
        F.lit("Content-Length"), F.lit("0"), F.lit("Date"), later.cast("string"),
        F.lit("Cache-Control"), F.concat(F.lit("max-age="), F.pmod(p, F.lit(100)).cast("string")),
        F.lit("Connection"), F.lit("X-Hop"), F.lit("X-Hop"), F.lit("1"))
    filled = lambda m: F.map_filter(m, lambda k, v: v.isNotNull())
    one = lambda i, k, t, h: F.struct((p * 2 + i).alias("record_id"), F.lit(k).alias("kind"), t.alias("time"), filled(h).alias("headers"))
    both = F.explode(F.array(one(0, "response", seen, response), one(1, "revisit", later, revisit)))
    return pages.select("url", both.alias("r")).select("r.record_id", "url", "r.kind", "r.time", "r.headers")


_SQL = rf"""
WITH p AS (
  SELECT page_id, url, '"' || md5(coalesce(html, '')) || '"' AS tag, page_id * 60 AS seen,
         (page_id * 60 - (page_id * 60) % 86400)::VARCHAR AS day, length(html)::VARCHAR AS len,
         page_id * 60 + 60 * (1 + (page_id * 7919) % 20000) AS later,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
u AS (
  SELECT *, regexp_replace(regexp_replace(translate(regexp_extract(rest, '^([^/?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':(80|443)?$', ''), '^www[0-9]*\.', '')
            || regexp_replace(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '/+$', '') AS hp,
         list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
                   lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))) AS q FROM p),
c AS (SELECT *, hp || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS cu FROM u),
res AS (SELECT page_id * 2 AS id, cu, seen AS t, CASE page_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'W/' || tag ELSE tag END AS etag,
               CASE WHEN page_id % 5 = 0 THEN NULL ELSE day END AS lm, len FROM c),
rev AS (SELECT page_id * 2 + 1 AS id, cu, later AS t, CASE WHEN page_id % 3 = 0 THEN NULL ELSE tag END AS etag,
               CASE WHEN page_id % 7 = 0 THEN NULL ELSE day END AS lm, page_id % 100 AS age FROM c),
j AS (
  SELECT v.id, v.cu, v.t, v.etag, v.lm, v.age, r.id AS rid, r.etag AS retag, r.lm AS rlm, r.len,
         CASE WHEN r.id IS NULL THEN 'no_response' WHEN v.etag IS NULL AND v.lm IS NULL THEN 'no_validator'
              WHEN coalesce(CASE WHEN v.etag IS NOT NULL THEN v.etag = regexp_replace(r.etag, '^W/', '') ELSE v.lm = r.lm END, false)
              THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM rev v ASOF LEFT JOIN res r ON v.cu = r.cu AND v.t > r.t)
SELECT id AS record_id, cu AS canonical_url, outcome,
       CASE WHEN outcome = 'resolved' THEN rid ELSE -1 END AS response_id,
       CASE WHEN outcome = 'resolved' THEN coalesce(etag, retag) END AS etag,
       CASE WHEN outcome = 'resolved' THEN coalesce(lm, rlm) END AS last_modified,
       CASE WHEN outcome = 'resolved' THEN len END AS content_length,
       CASE WHEN outcome = 'resolved' THEN t::VARCHAR END AS date,
       CASE WHEN outcome = 'resolved' THEN 'max-age=' || age END AS cache_control,
       CASE WHEN outcome = 'resolved' THEN 'origin' END AS server,
       NULL::VARCHAR AS x_hop
FROM j"""


@query("op10_revisits", _SQL)
def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revisits of the crawl that the pages tell, resolved (response_id -1: not), with their merged headers' fields."""
    out = resolve(page_records(read_table(spark, sf_dir, "pages")))
    fields = ("etag", "last-modified", "content-length", "date", "cache-control", "server", "x-hop")
    return out.select("record_id", "canonical_url", "outcome", F.coalesce("response_id", F.lit(-1)).alias("response_id"),
                      *[_field(F.col("merged"), f).alias(f.replace("-", "_")) for f in fields])
