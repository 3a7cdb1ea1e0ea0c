"""Not-modified revisit resolution: an as-of join of web captures.

A revisit is joined to the latest earlier full response with the same canonical URL, validators are checked, and the headers that
a not-modified answer may update are merged over the stored ones. Rows of one URL are spread over time slices: inside a slice a
running maximum finds the latest response, and one row per URL and slice carries it to later slices, so a URL with a third of
all captures is still worked on by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLICES = 64

# Fields that a not-modified response may update, in lower case.
PERMITTED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "via", "warning"]
# Query fields that do not select a page.
TRACKING = "utm_[a-z]+|fbclid|gclid|sessionid|sid"


def canonical(url: Column | str) -> Column:
    """Host in lower case without scheme, user, ``www.`` and the scheme's default port (80 without a scheme), path without index page
    and final slash, query fields sorted and without tracking, no fragment. Null where nothing is left."""
    url = F.col(url) if isinstance(url, str) else url
    port = F.when(F.trim(url).rlike("^[Hh][Tt][Tt][Pp][Ss]://"), ":443").otherwise(":80")
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/index\\.[a-z]+$", "/"), "/+$", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), "^[^@]*@", ""), ":$", ""), "^www\\.", "")
    host = F.when(F.endswith(host, port), F.left(host, F.length(host) - F.length(port))).otherwise(host)
    fields = F.array_sort(F.filter(F.split(F.regexp_extract(rest, "\\?(.*)$", 1), "&"), lambda f: (f != "") & ~f.rlike(f"^({TRACKING})(=|$)")))
    return F.nullif(F.concat(host, path, F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(F.lit(""))), F.lit(""))


def _lowered(headers: Column) -> Column:
    """Entries with names in lower case; of a repeated name the last counts."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    entries = F.transform(entries, lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    names = F.transform(entries, lambda e: e["key"])
    return F.filter(entries, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"]))


def _strong(tag: Column) -> Column:
    """An entity tag for the weak comparison that revalidation uses."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """One row per revisit: ``record_id``, ``url`` (canonical), ``target_id``, ``outcome``, ``matched_by``, ``headers``.

    ``records`` has ``record_id``, ``kind`` (response or revisit), ``status``, ``url``, ``at`` (integer time), ``etag``, ``last_modified``,
    ``digest``, ``headers`` (map). Full responses have status 200; a target must be strictly earlier, and of several at one
    time the greatest id counts. A revisit's first validator decides: entity tag, else modification date, else digest.
    Outcomes: resolved, mismatch (the target's validator differs or is missing), unvalidated (no validator), missing (no
    target). Revisits without a time or without a URL (null, empty, blank or nothing but a scheme) are missing and a response
    without URL is no target. Headers are merged only when resolved, else those of the revisit. Repeated revisits are rows of
    their own; an empty table gives none. The result doesn't depend on ``slices``.
    """
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("at").isNotNull()
    base = records.select(F.col("record_id").cast("long"), "kind", canonical("url").alias("url"), F.col("at").cast("long").alias("at"), "etag", "last_modified", "digest",
                          _lowered(F.col("headers")).alias("headers"), full.alias("full"))
    base = base.where((F.coalesce("full", F.lit(False)) & F.col("url").isNotNull()) | (F.col("kind") == "revisit"))
    nowhere = base.where((F.col("kind") == "revisit") & F.col("url").isNull())
    base = base.where(F.col("url").isNotNull())
    cuts = [c for c in (base.agg(F.percentile_approx("at", [k / slices for k in range(1, slices)], 1000)).first()[0] or []) if c is not None]
    place = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))]), lambda c: c <= F.col("at"))) if cuts else F.lit(0)
    base = base.withColumn("slice", place.cast("int"))
    stored = F.when(F.coalesce("full", F.lit(False)), F.struct("at", "record_id", "etag", "last_modified", "digest", "headers"))
    base = base.withColumn("stored", stored)
    inside = F.max("stored").over(Window.partitionBy("url", "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, -1))
    near = base.withColumn("near", inside).where("kind = 'revisit'").drop("stored", "full")
    per_slice = base.groupBy("url", "slice").agg(F.max("stored").alias("latest"))
    before = F.max("latest").over(Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    carried = per_slice.select("url", "slice", before.alias("carried")).where("carried is not null")
    df = near.join(carried, ["url", "slice"], "left").withColumn("target", F.when(F.col("at").isNotNull(), F.coalesce("near", "carried")))
    # Rows without URL have met no window: they would all have one key.
    df = df.unionByName(nowhere.withColumn("target", F.lit(None).cast(df.schema["target"].dataType)), allowMissingColumns=True)

    validators = [("etag", _strong(F.col("etag")), _strong(F.col("target.etag"))), ("last-modified", F.trim("last_modified"), F.trim("target.last_modified")), ("digest", F.col("digest"), F.col("target.digest"))]
    used = F.coalesce(*[F.when(mine.isNotNull(), F.lit(name)) for name, mine, _ in validators])
    same = F.coalesce(*[F.when(used == name, F.coalesce(mine == its, F.lit(False))) for name, mine, its in validators])
    outcome = (F.when(F.col("target").isNull(), "missing").when(used.isNull(), "unvalidated").when(same, "resolved").otherwise("mismatch"))
    df = df.withColumn("outcome", outcome).withColumn("matched_by", F.when(F.col("outcome") == "resolved", used))
    update = F.filter("headers", lambda e: e["key"].isin(PERMITTED))
    kept = F.filter("target.headers", lambda e: ~F.array_contains(F.transform(update, lambda u: u["key"]), e["key"]))
    merged = F.when(F.col("outcome") == "resolved", F.concat(kept, update)).otherwise(F.col("headers"))
    return df.select("record_id", "url", F.when(F.col("outcome") != "missing", F.col("target.record_id")).alias("target_id"), "outcome", "matched_by",
                     F.map_from_entries(F.sort_array(merged)).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of a page table: each page is a full response at its number, and is asked for again some time
    before or after under another spelling of its URL, with a matching tag, an old one, a date, a digest or nothing."""
    html, k = F.coalesce("html", F.lit("")), F.col("page_id")
    digest = F.md5(html)
    tag, date = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"')), F.concat(F.lit("day "), (k % 365).cast("string"))
    response = pages.select(
        (2 * k).alias("record_id"), F.lit("response").alias("kind"), F.when(k % 50 == 49, 404).otherwise(200).alias("status"), "url", (k * 10).alias("at"), tag.alias("etag"), date.alias("last_modified"),
        digest.alias("digest"), F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length(html).cast("string"), F.lit("ETag"), tag,
                                             F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Date"), (k * 10).cast("string")).alias("headers"))
    at = k * 10 + (k * 7919) % 200000 - 20000
    kind = k % 10
    again = pages.select(
        (2 * k + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), F.concat(F.regexp_replace("url", "^https?://(www\\.)?", "https://WWW."), F.lit("#again")).alias("url"), at.alias("at"),
        F.when(kind < 5, F.concat(F.lit("W/"), tag)).when(kind == 5, F.lit('"old"')).alias("etag"), F.when(kind == 6, date).alias("last_modified"),
        F.when(kind.isin(7, 8), digest).alias("digest"),
        F.create_map(F.lit("cache-control"), F.lit("max-age=600"), F.lit("date"), at.cast("string"), F.lit("content-length"), F.lit("0")).alias("headers"))
    return response.unionByName(again)
