"""Resolution of not-modified revisit records of a web archive.

A revisit says that a page was asked for again and had not changed. It is joined, as of its time, with the latest
earlier full response of the same canonical URL; the validators (entity tag, else last-modified) are compared, and the
headers that a not-modified answer may update are merged into those of the response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a 304 answer does not update (hop-by-hop fields and those of the content itself).
NOT_MERGED = ["connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade", "content-length", "content-encoding", "content-type", "content-range", "content-md5"]

#: Header fields that hold lists, so that repeated ones may be joined by commas; of others the last one counts.
LISTS = ["accept-ranges", "access-control-allow-headers", "access-control-allow-methods", "access-control-expose-headers", "allow", "cache-control", "connection", "content-encoding", "content-language", "link", "pragma", "proxy-authenticate", "trailer", "transfer-encoding", "upgrade", "vary", "via", "warning", "www-authenticate"]


def canonical_url(url: Column) -> Column:
    """Host in lower case without www, no scheme, default port, fragment, trailing slash, empty or tracking (``ref``) parameters."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    rest = F.regexp_replace(u, r"^[^/?]*", "")
    query = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda x: ~x.startswith("ref=") & (x != ""))
    rest = F.concat(F.regexp_replace(rest, r"\?.*$", ""), F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))
    return F.concat(host, F.regexp_replace(rest, r"/$", ""))


def plain_tag(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def one_case(headers: Column) -> Column:
    """Header names in lower case. Of names that differ in case only, in order of the names: the values of a field that holds a list are joined by commas, of any other field the last one stays."""
    entries = F.array_sort(F.map_entries(headers))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    of = lambda n: F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == n), lambda e: F.coalesce(e["value"], F.lit("")))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.when(n.isin(*LISTS), F.array_join(of(n), ", ")).otherwise(F.element_at(of(n), -1))))


def resolve_revisits(records: DataFrame, bucket_seconds: int = 3_600) -> DataFrame:
    """Each revisit of ``records`` with the response it stands for.

    ``records``: record_id long, url, ts long (epoch seconds), kind ('response' or 'revisit'), etag, last_modified,
    headers map<string,string>. Returns for each revisit: record_id, canonical_url, ts, resolution, response_id, headers
    (merged; null unless resolved). resolution: 'resolved' (validators agree), 'mismatch' (they don't), 'unverified'
    (neither has one in common: response_id is given, headers are not merged) or 'missing' (no earlier full response).
    Earlier: smaller ts, or equal ts and smaller record_id. Other kinds are ignored. Revisits without url or ts are
    missing; repeated rows are resolved each. Header names are compared in lower case; see ``one_case`` for repeated ones,
    null values are empty; a null map has no headers. Rows without record_id come before others of their ts. An empty table gives no rows; other columns are ignored.

    The as-of join runs in two steps so that one very common URL is spread over its time buckets: the latest response
    inside the bucket, else the last one of the latest earlier bucket, from a table of one row per URL and bucket.
    """
    r = records.where(F.col("kind").isin("response", "revisit")).select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "kind", "etag", "last_modified", "headers")
    r = r.withColumn("bucket", F.floor(F.col("ts") / bucket_seconds))
    full = F.when((F.col("kind") == "response") & F.col("canonical_url").isNotNull() & F.col("ts").isNotNull(), F.struct("ts", "record_id", "etag", "last_modified", "headers"))
    r = r.withColumn("full", full)
    inside = Window.partitionBy("canonical_url", "bucket").orderBy("ts", "record_id", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = r.withColumn("near", F.last("full", True).over(inside)).where("kind = 'revisit'").drop("full")
    lasts = r.where("full is not null").groupBy("canonical_url", "bucket").agg(F.max_by("full", F.struct("ts", "record_id")).alias("last"))
    seen = lasts.select("canonical_url", "bucket", "last").unionByName(near.select("canonical_url", "bucket").distinct().withColumn("last", F.lit(None).cast(lasts.schema["last"].dataType)))
    seen = seen.groupBy("canonical_url", "bucket").agg(F.first("last", True).alias("last"))
    far = seen.withColumn("far", F.last("last", True).over(Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("canonical_url", "bucket", "far")
    out = near.join(far, ["canonical_url", "bucket"], "left").withColumn("to", F.coalesce("near", "far"))
    tags = F.col("etag").isNotNull() & F.col("to.etag").isNotNull()
    times = F.col("last_modified").isNotNull() & F.col("to.last_modified").isNotNull()
    same = F.when(tags, plain_tag(F.col("etag")) == plain_tag(F.col("to.etag"))).when(times, F.col("last_modified") == F.col("to.last_modified"))
    resolution = F.when(F.col("canonical_url").isNull() | F.col("ts").isNull() | F.col("to").isNull(), "missing").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    lower = lambda m: one_case(F.coalesce(m, F.create_map().cast("map<string,string>")))
    new = F.map_filter(lower(F.col("headers")), lambda k, v: ~k.isin(*NOT_MERGED))
    old = lower(F.col("to.headers"))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    out = out.withColumn("resolution", resolution)
    return out.select("record_id", "canonical_url", "ts", "resolution", F.when(F.col("resolution") != "missing", F.col("to.record_id")).alias("response_id"), F.when(F.col("resolution") == "resolved", merged).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """A stand-in for an archive: four captures of each of ``pages`` (page_id, url, html), a day apart, full and not modified."""
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    p = pages.select("page_id", "url", tag.alias("tag"), F.octet_length("html").cast("string").alias("size")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    changed = (F.col("page_id") % 3 == 0) & (F.col("k") >= 2)
    kind = F.when(((F.col("k") == 0) & (F.col("page_id") % 11 != 0)) | ((F.col("k") == 2) & (F.col("page_id") % 3 == 0)), "response").otherwise("revisit")
    p = p.withColumn("kind", kind).withColumn("ts", F.col("page_id") % 1000 * 60 + F.col("k") * 86_400)
    etag = F.when(changed, F.concat(F.lit("W/"), F.col("tag"), F.lit("-2"))).otherwise(F.col("tag"))
    etag = F.when((F.col("kind") == "revisit") & (F.col("k") == 3) & (F.col("page_id") % 5 == 0), F.lit('"stale"')).when((F.col("kind") == "revisit") & (F.col("page_id") % 7 == 0), F.lit(None)).otherwise(etag)
    p = p.withColumn("etag", etag).withColumn("last_modified", F.when(F.col("page_id") % 13 == 0, None).otherwise(F.concat_ws("-", F.col("page_id").cast("string"), F.when(changed, "2").otherwise("1"))))
    date = F.col("ts").cast("string")
    headers = F.when(F.col("kind") == "response", F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("size"), F.lit("Date"), date, F.lit("Server"), F.lit("a"))).otherwise(F.create_map(F.lit("Date"), date, F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=60")))
    return p.select((F.col("page_id") * 4 + F.col("k")).alias("record_id"), "url", "ts", "kind", "etag", "last_modified", headers.alias("headers"))
