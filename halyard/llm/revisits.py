"""Operator 1: resolution of not-modified revisits in web archives, with DataFrame functions only.

A revisit record says that a page was as it had been. It is joined as of its time to the latest earlier full response
for the same canonical URL; the validators that both carry are held against each other, and of the revisit's headers
those are merged into the response's that a not-modified answer may update.

The as-of join sorts no URL as a whole: rows are windowed by (URL, block of time), and what the last response before a
block was comes from a second window that has one row for each block of a URL. A URL with a third of all captures so
spreads over as many tasks as it has blocks.

Cases: a null URL has no canonical form and finds nothing, as does a null time; a response at the very time of a revisit
is not earlier; of responses at one time the one with the largest id counts; repeated rows are resolved each for
itself; null headers count as none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds of a block.
BLOCK = 86_400_000_000
#: Query parameters that only track, by the beginning of their names.
TRACKING = "utm_|fbclid|gclid|sessionid"
#: Headers of the stored response that a not-modified answer does not update (RFC 9111, 3.2).
KEPT_HEADERS = ["content-length", "content-encoding", "content-type", "content-range", "transfer-encoding", "connection", "keep-alive", "proxy-authenticate", "set-cookie", "te", "trailer", "upgrade"]
#: What a record has to have.
COLUMNS = ["record_id", "url", "at", "kind", "etag", "last_modified", "digest", "headers"]

RESOLVED, MISSING, CHANGED, UNCHECKED = "RESOLVED", "NO_EARLIER_RESPONSE", "VALIDATOR_MISMATCH", "NO_VALIDATOR"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, path without closing slashes, sorted query without tracking."""
    rest = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), ":(80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_replace(F.concat(F.lit("&"), F.regexp_extract(rest, r"\?(.*)$", 1)), f"&({TRACKING})[^&]*", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_replace(query, "&+", "&"), "^&", ""), "&$", "")
    query = F.array_join(F.array_sort(F.split(query, "&", -1)), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def latest_earlier(records: DataFrame, block: int = BLOCK) -> DataFrame:
    """The revisits among records, with `found`, the latest earlier response's (at, record_id, etag, last_modified, digest, headers)."""
    response = F.struct("at", "record_id", "etag", "last_modified", "digest", F.array_sort(F.map_entries("headers")).alias("headers"))
    rows = records.filter(F.col("canonical_url").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin("response", "revisit"))
    rows = rows.withColumn("block", F.floor(F.col("at") / block)).withColumn("response", F.when(F.col("kind") == "response", response))
    lasts = rows.filter("response is not null").groupBy("canonical_url", "block").agg(F.max("response").alias("last"))
    # For each block with a row: the last response of the blocks before it.
    blocks = rows.select("canonical_url", "block").distinct().join(lasts, ["canonical_url", "block"], "left")
    so_far = Window.partitionBy("canonical_url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("canonical_url", "block", F.max("last").over(so_far).alias("carried"))
    within = Window.partitionBy("canonical_url", "block").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("own", F.max("response").over(within)).filter(F.col("kind") == "revisit").drop("response")
    return own.join(carried, ["canonical_url", "block"], "left").withColumn("found", F.coalesce("own", "carried")).drop("own", "carried", "block")


def state(found: Column) -> Column:
    """What the validators say: an entity tag (weakly compared) before a date, and a payload digest whenever both have one."""
    bare = lambda tag: F.regexp_replace(tag, "^W/", "")
    tags, dates = F.col("etag").isNotNull() & found["etag"].isNotNull(), F.col("last_modified").isNotNull() & found["last_modified"].isNotNull()
    digests = F.col("digest").isNotNull() & found["digest"].isNotNull()
    return (
        F.when(found.isNull(), MISSING)
        .when(digests & (F.col("digest") != found["digest"]), CHANGED)
        .when(tags, F.when(bare(F.col("etag")) == bare(found["etag"]), RESOLVED).otherwise(CHANGED))
        .when(dates, F.when(F.col("last_modified") == found["last_modified"], RESOLVED).otherwise(CHANGED))
        .when(digests, RESOLVED)
        .otherwise(UNCHECKED)
    )


def resolve(records: DataFrame, block: int = BLOCK) -> DataFrame:
    """(record_id, url, canonical_url, at, response_id, response_at, state, headers) for every revisit.

    records: COLUMNS, at in microseconds, headers a map with names in lower case. headers of the result are the merged
    ones where the state is RESOLVED, else the revisit's own.
    """
    rows = records.select(*[c for c in COLUMNS if c != "headers"], F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"))
    canonical = rows.withColumn("canonical_url", canonical_url(F.col("url")))
    found = latest_earlier(canonical, block)
    lost = canonical.filter((F.col("kind") == "revisit") & (F.col("canonical_url").isNull() | F.col("at").isNull()))
    every = found.unionByName(lost, allowMissingColumns=True).withColumn("state", state(F.col("found")))
    sent = F.map_filter("headers", lambda k, v: ~k.isin(KEPT_HEADERS))
    stored = F.map_filter(F.map_from_entries("found.headers"), lambda k, v: ~F.map_contains_key(sent, k))
    merged = F.when(F.col("state") == RESOLVED, F.map_concat(stored, sent)).otherwise(F.col("headers"))
    return every.select("record_id", "url", "canonical_url", "at", F.col("found.record_id").alias("response_id"), F.col("found.at").alias("response_at"), "state", merged.alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Captures made by rule of a table of pages: each page's full response, and a revisit of it some hours later.

    Every fifth revisit names another entity tag, every seventh none but a date, every eleventh only a digest.
    """
    at, tag = F.col("page_id") * 600_000_000, F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 12), F.lit('"'))
    date, digest = F.concat(F.lit("day "), F.floor(F.col("page_id") / 144)), F.sha2(F.coalesce("html", F.lit("")), 256)
    size = F.length(F.coalesce("html", F.lit(""))).cast("string")
    nothing = F.lit(None).cast("string")
    response = F.struct(
        (2 * F.col("page_id")).alias("record_id"), F.col("url").alias("url"), at.alias("at"), F.lit("response").alias("kind"), tag.alias("etag"), date.alias("last_modified"), digest.alias("digest"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), size, F.lit("cache-control"), F.lit("max-age=60"), F.lit("etag"), tag).alias("headers"),
    )
    only_date, only_digest = F.col("page_id") % 7 == 3, F.col("page_id") % 11 == 5
    told = F.when(only_date | only_digest, nothing).when(F.col("page_id") % 5 == 2, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag))
    revisit = F.struct(
        (2 * F.col("page_id") + 1).alias("record_id"), F.concat(F.regexp_replace(F.col("url"), "#.*$", ""), F.lit("#again")).alias("url"), (at + 36_000_000_000).alias("at"), F.lit("revisit").alias("kind"),
        told.alias("etag"), F.when(only_digest, nothing).otherwise(date).alias("last_modified"), F.when(only_digest, digest).alias("digest"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=600"), F.lit("date"), F.concat(F.lit("at "), (at + 36_000_000_000).cast("string"))).alias("headers"),
    )
    return pages.select(F.explode(F.array(response, revisit)).alias("r")).select("r.*")


def digests(resolved: DataFrame) -> DataFrame:
    """The result with its headers as columns."""
    names = {"content-type": "content_type", "content-length": "content_length", "cache-control": "cache_control", "etag": "merged_etag", "date": "date_header"}
    kept = [F.col(c).alias("captured_at" if c == "at" else c) for c in resolved.columns if c not in ("headers", "url")]
    return resolved.select(*kept, *[F.col("headers")[h].alias(c) for h, c in names.items()])


ORACLE_SQL = f"""
WITH base AS (
  SELECT page_id, url, coalesce(html, '') AS html, page_id * 600000000 AS t,
         '"' || substr(md5(coalesce(html, '')), 1, 12) || '"' AS tag,
         'day ' || CAST(page_id // 144 AS VARCHAR) AS day, sha256(coalesce(html, '')) AS dig
  FROM pages),
records AS (
  SELECT 2 * page_id AS record_id, url, t AS captured_at, 'response' AS kind, tag AS etag, day AS last_modified, dig AS digest,
         CAST(length(html) AS VARCHAR) AS len FROM base
  UNION ALL
  SELECT 2 * page_id + 1, regexp_replace(url, '#.*$', '') || '#again', t + 36000000000, 'revisit',
         CASE WHEN page_id % 7 = 3 OR page_id % 11 = 5 THEN NULL WHEN page_id % 5 = 2 THEN '"other"' ELSE 'W/' || tag END,
         CASE WHEN page_id % 11 = 5 THEN NULL ELSE day END, CASE WHEN page_id % 11 = 5 THEN dig END, '0' FROM base),
cut AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM records),
parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www[0-9]*\\.', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace('&' || regexp_extract(rest, '\\?(.*)$', 1),
           '&({TRACKING})[^&]*', '', 'g'), '&+', '&', 'g'), '^&', ''), '&$', '') AS q FROM cut),
canon AS (
  SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END
            || CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(q, '&')), '&') END AS canonical_url FROM parts),
found AS (
  SELECT v.record_id, v.canonical_url, v.captured_at, v.etag, v.last_modified, v.digest,
         r.record_id AS response_id, r.captured_at AS response_at, r.etag AS r_etag, r.last_modified AS r_date, r.digest AS r_digest, r.len AS r_len,
         row_number() OVER (PARTITION BY v.record_id ORDER BY r.captured_at DESC, r.record_id DESC) AS place
  FROM canon v LEFT JOIN canon r ON r.kind = 'response' AND r.canonical_url = v.canonical_url AND r.captured_at < v.captured_at
  WHERE v.kind = 'revisit'),
said AS (
  SELECT *, CASE WHEN response_id IS NULL THEN '{MISSING}'
    WHEN digest IS NOT NULL AND digest <> r_digest THEN '{CHANGED}'
    WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = r_etag THEN '{RESOLVED}' ELSE '{CHANGED}' END
    WHEN last_modified IS NOT NULL THEN CASE WHEN last_modified = r_date THEN '{RESOLVED}' ELSE '{CHANGED}' END
    WHEN digest IS NOT NULL THEN '{RESOLVED}' ELSE '{UNCHECKED}' END AS state
  FROM found WHERE place = 1)
SELECT record_id, canonical_url, captured_at, response_id, response_at, state,
       CASE WHEN state = '{RESOLVED}' THEN 'text/html' END AS content_type,
       CASE WHEN state = '{RESOLVED}' THEN r_len ELSE '0' END AS content_length,
       'max-age=600' AS cache_control,
       CASE WHEN state = '{RESOLVED}' THEN r_etag END AS merged_etag,
       'at ' || CAST(captured_at AS VARCHAR) AS date_header
FROM said
"""
