"""Not-modified revisit resolution for web captures.

A capture record is either a full response (status 200) or a not-modified
revisit (304). A revisit is resolved by an as-of join to the latest full
response of the same canonical URL at a strictly earlier time (of several at
one time, the one with the largest record id). Its validators are checked (entity tag; where either side has none, the
last-modified date), and the headers that a 304 may update are merged into the
stored ones. Bodies are never moved: the result names the response record.

The join is a window of the metadata rows alone. One URL may hold a third of
all records, so time is cut into buckets at quantiles: the latest response is
first found within (URL, bucket), and a revisit without one takes the latest
response carried from an earlier bucket of its URL.

Defined results: records with a null URL, time or id, or of another status,
resolve to nothing (revisits) or are not offered (responses); without an
earlier response the status is ``no_response``; without a validator on both
sides ``unverified``; repeated response rows count once; repeated revisit rows
each get a row; null header maps are empty; header names are compared in lower case. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers of a not-modified answer that replace the stored ones (fixed values).
PERMITTED = ("age", "cache-control", "date", "expires", "vary")
TIME_BUCKETS = 256


def canonical_url(url: Column) -> Column:
    """Scheme, www./m. prefix, fragment, tracking parameters and trailing slash
    removed; host lower-cased. An index page stays: it is a URL of its own."""
    u = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    u = F.regexp_replace(u, r"#.*$", "")
    host = F.lower(F.regexp_extract(u, r"^[^/?]*", 0))
    rest = F.regexp_replace(u, r"^[^/?]*", "")
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www|m)\.", "")
    rest = F.regexp_replace(rest, r"([?&])(utm_[a-z]+|ref)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, r"&&+", "&"), r"\?&", "?")
    rest = F.regexp_replace(rest, r"[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, r"/+$", ""))


def lowered(headers: Column) -> Column:
    """Header names in lower case, sorted; of names that then agree the first stays."""
    pairs = F.transform(F.map_entries(F.coalesce(headers, F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<string>")))),
        lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(pairs, lambda e: e["key"])
    first = F.filter(pairs, lambda e, i: F.array_position(names, e["key"]) == i + 1)
    return F.map_from_entries(F.array_sort(first))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records``: record_id long, url string, ts long, status int, etag
    string, last_modified string, headers map<string,string>. One row per
    revisit: record_id, canonical, ts, response_id, response_ts, resolution,
    headers."""
    rows = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), "ts", "status", "etag",
        "last_modified", lowered(F.col("headers")).alias("headers"))
    usable = F.col("canonical").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    cuts = rows.filter(usable).agg(F.percentile_approx(
        "ts", [i / TIME_BUCKETS for i in range(1, TIME_BUCKETS)], 2000)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>"),
                             lambda c: c < F.col("ts")))
    response = F.struct("ts", "record_id", "etag", "last_modified", "headers")
    known = rows.filter(usable & F.col("status").isin(200, 304)).withColumn("bucket", bucket)
    offered = F.when(F.col("status") == 200, response)
    # revisits stand before responses of the same time: only strictly earlier ones serve them
    inside = Window.partitionBy("canonical", "bucket").orderBy(
        "ts", F.when(F.col("status") == 304, 0).otherwise(1), "record_id").rowsBetween(
        Window.unboundedPreceding, -1)
    here = known.withColumn("own", F.last(offered, ignorenulls=True).over(inside))
    # map-side combined: one row for each URL and bucket; maps can't be compared, the id finds the row
    latest = (known.filter("status = 200").groupBy("canonical", "bucket")
              .agg(F.max_by(response, F.struct("ts", "record_id")).alias("last")))
    carried = latest.withColumn("next_bucket", F.lead("bucket").over(
        Window.partitionBy("canonical").orderBy("bucket")))
    revisits = here.filter("status = 304")
    carried = carried.select(F.col("canonical").alias("_c"), F.col("bucket").alias("_from"),
                             F.coalesce("next_bucket", F.lit(TIME_BUCKETS + 1)).alias("_to"), "last")
    # every bucket after _from up to _to is served by that row: explode it, at most TIME_BUCKETS rows for a URL
    needed = revisits.filter("own IS NULL").select(F.col("canonical").alias("_n"), F.col("bucket").alias("_b")).distinct()
    served = (needed.join(carried, (F.col("_n") == F.col("_c")) & (F.col("_from") < F.col("_b"))
                          & (F.col("_b") <= F.col("_to")))
              .select(F.col("_n").alias("canonical"), F.col("_b").alias("bucket"), F.col("last").alias("carried")))
    found = (revisits.join(served, ["canonical", "bucket"], "left")
             .withColumn("r", F.coalesce("own", "carried")))
    lost = rows.filter(~usable & (F.col("status") == 304)).withColumn("r", F.lit(None).cast(
        found.schema["r"].dataType))
    columns = ["record_id", "canonical", "ts", "etag", "last_modified", "headers", "r"]
    both = found.select(*columns).unionByName(lost.select(*columns))
    same_tag = F.col("etag") == F.col("r.etag")
    same_date = F.col("last_modified") == F.col("r.last_modified")
    merged = F.map_filter(F.col("headers"), lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(F.col("r.headers"), lambda k, v: ~F.array_contains(F.map_keys(merged), k))
    resolution = (F.when(F.col("r").isNull(), "no_response")
                  .when(F.coalesce(same_tag, same_date).isNull(), "unverified")
                  .when(F.coalesce(same_tag, same_date), "resolved").otherwise("changed"))
    return both.select(
        "record_id", "canonical", "ts", F.col("r.record_id").alias("response_id"),
        F.col("r.ts").alias("response_ts"), resolution.alias("resolution"),
        F.when(resolution.isin("resolved", "unverified"), F.map_concat(kept, merged)).alias("headers"))
