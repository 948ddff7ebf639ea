"""Not-modified revisits of a crawl, resolved to the latest earlier full response of the same canonical URL.

The as-of join runs on small keys, never on payloads. Captures are range-partitioned by (canonical url, date,
id), which splits even one url that holds a third of all captures. Within each range a window carries the
last full response forward; the last full response of every (url, range) is carried across ranges by a second
window over as many rows as a url has ranges. The original's headers and digest are then joined by record id.

Validators decide: an entity tag of the revisit must equal the original's by weak comparison; without tags the
modification dates must agree; without either there is nothing to contradict, and the status says ``unchecked``.
Merged headers are the original's, where those a 304 may carry come from the revisit when it has them.

Defined results: full responses have status ``full``; a revisit without an earlier full response is an ``orphan``;
of equal dates the smaller record id is earlier; captures without a date or url are never used and never
resolved (``orphan``); null headers count as none; header names compare in lower case, the last of
several equal names holds; repeated rows are resolved alike; an empty table gives no rows; other columns, whatever
their names, are not read. Payloads are never read, only their digests, so their length does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import discard, stage

#: The header fields that a 304 response may update.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary", "age", "warning", "last-modified"]


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case without user, default port, trailing dot; no fragment; sorted parameters without trackers; a path."""
    low = F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1))
    port = F.regexp_extract(url, r"://(?:[^/?#@]*@)?(?:\[[^\]/?#]*\]|[^/?#:]*):(\d+)", 1)
    port = F.when((port == "") | ((low == "http") & (port == "80")) | ((low == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("(?i)^(utm_[a-z]+|fbclid|gclid)=")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    whole = F.concat(low, F.lit("://"), F.regexp_replace(host, r"\.$", ""), port, F.when(path == "", "/").otherwise(path), tail)
    return F.when(url.isNotNull() & (low != "") & (host != ""), whole)


def _lower_keys(headers: Column) -> Column:
    """Header names in lower case; of several the last holds."""
    entries = F.map_entries(F.coalesce(headers, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    lowered = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(lowered, lambda e: e["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(lowered, lambda e: e["key"] == n), -1)["value"]))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], r"^\s*W/", "")


def resolve_revisits(captures: DataFrame, ranges: int | None = None) -> DataFrame:
    """(record_id, url_key, status, refers_to, payload_digest, headers) for every row of ``captures``.

    ``captures``: record_id, url, warc_date timestamp, kind (``response`` or ``revisit``), headers map<string,string>, payload_digest.
    """
    spark = captures.sparkSession
    rows = stage(
        captures.select("record_id", canonical_url(F.col("url").cast("string")).alias("url_key"), F.col("warc_date").cast("timestamp").alias("at"), (F.col("kind") == "response").alias("full"), _lower_keys(F.col("headers")).alias("headers"), "payload_digest"),
        "warc_rows",
    )
    keys = rows.where("url_key is not null and at is not null and record_id is not null").select("record_id", "url_key", "at", F.coalesce("full", F.lit(False)).alias("full"))
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(keys.repartitionByRange(n, "url_key", "at", "record_id").withColumn("part", F.spark_partition_id()), "warc_dealt")
    this = F.when(F.col("full"), F.struct("at", "record_id"))
    before = Window.partitionBy("url_key", "part").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.select("record_id", "url_key", "part", "full", F.last(this, ignorenulls=True).over(before).alias("near"))
    ends = dealt.where("full").groupBy("url_key", "part").agg(F.max(F.struct("at", "record_id")).alias("end"))
    spans = dealt.select("url_key", "part").distinct().join(ends, ["url_key", "part"], "left")
    earlier = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("url_key", "part", F.last("end", ignorenulls=True).over(earlier).alias("far"))
    found = within.where("not full").join(carried, ["url_key", "part"], "left").select("record_id", F.coalesce("near", "far")["record_id"].alias("refers_to")).where("refers_to is not null").dropDuplicates(["record_id"])
    first = rows.where("full").groupBy("record_id").agg(F.min_by(F.struct("headers", "payload_digest"), F.struct("at", "payload_digest")).alias("o"))
    originals = first.select(F.col("record_id").alias("refers_to"), F.col("o.headers").alias("old_headers"), F.col("o.payload_digest").alias("old_digest"))
    # originals are joined to what refers to them, so that captures without one never meet under a null key
    joined = rows.join(found.join(originals, "refers_to"), "record_id", "left")
    old, new = F.col("old_headers"), F.col("headers")
    tags = _tag(old).isNotNull() & _tag(new).isNotNull()
    dates = old["last-modified"].isNotNull() & new["last-modified"].isNotNull()
    same = F.when(tags, _tag(old) == _tag(new)).when(dates, old["last-modified"] == new["last-modified"])
    full = F.coalesce("full", F.lit(False))
    status = F.when(full, "full").when(F.col("refers_to").isNull(), "orphan").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")
    good = F.col("status").isin("resolved", "unchecked")
    permitted = F.map_filter(new, lambda k, v: k.isin(PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(permitted, k)), permitted)
    return joined.withColumn("status", status).select(
        "record_id", "url_key", "status", F.when(good, F.col("refers_to")).alias("refers_to"), F.when(F.col("status") == "full", F.col("payload_digest")).when(good, F.col("old_digest")).alias("payload_digest"),
        F.when(good, merged).otherwise(new).alias("headers"),
    )
