"""Resolution of not-modified revisit records (operator 1).

A revisit is matched with the latest earlier full response of the same canonical
URL (as-of join), its validators are checked against that response's, and the
stored headers are merged with those that a 304 answer may update.

The as-of join is cut along time: per URL and time slice the last response is
aggregated, carried over the (few) slices of the URL, and joined back; within a
slice a window finds the rest.  A URL with a third of all records is thus spread
over the slices.

Defined results: status is `resolved`, `mismatch` (a validator differs),
`no_validator` (none that both sides have) or `no_response`; a response at the
same time is not earlier; of several responses at one time the greatest id
counts; a null URL or time matches nothing; null headers are no headers.  Field names are
compared in lower case, and so are merged ones.  A repeated revisit gives a row each time;
other columns of the records are not carried, so their names cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .anyname import any_names

#: Header fields that a 304 answer carries for the stored response (RFC 9110, 15.4.5), lower case.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
SLICES = 256


def canonical(url: Column) -> Column:
    """Host in lower case without user, www prefix and default port; no scheme, fragment or trailing slash; sorted query."""
    plain = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    rest = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    parts = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: x != "")), "&")
    return F.concat(host, path, F.when(parts != "", F.concat(F.lit("?"), parts)).otherwise(F.lit("")))


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def _entries(headers: Column) -> Column:
    """Entries with field names in lower case, one for each name (the least value), sorted by name."""
    plain = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    whole = F.transform(F.array(plain), lambda a: F.filter(a, lambda e, i: (i == 0) | (F.get(a, i - 1)["key"] != e["key"])))
    return F.element_at(whole, 1)


def _merged(old: Column, new: Column) -> Column:
    fresh = F.filter(_entries(new), lambda e: e["key"].isin(*PERMITTED))
    kept = F.filter(_entries(old), lambda e: ~F.array_contains(F.transform(fresh, lambda f: f["key"]), e["key"]))
    return F.map_from_entries(F.array_sort(F.concat(kept, fresh)))


COLUMNS = ("record_id", "url", "ts", "kind", "http_status", "etag", "last_modified", "digest", "headers")


@any_names(fixed=COLUMNS)
def resolve(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """records(record_id, url, ts, kind, http_status, etag, last_modified, digest, headers: map) ->
    one row for each record of kind `revisit`: record_id, canonical, response_id, status, headers (merged if resolved).

    Time is cut at quantiles of all records, so slices hold about as many records each, whatever the range of their
    times.  Records of one URL and time are one place of the time line (of responses the greatest id): ties are combined
    before they are shuffled.  Records without URL or time never reach the windows."""
    none = F.create_map().cast("map<string,string>")
    full = (F.col("kind") == "response") & (F.col("http_status") == 200)
    rows = records.select(
        "record_id", canonical(F.col("url")).alias("canonical"), "ts", full.alias("full"), (F.col("kind") == "revisit").alias("revisit"),
        F.struct("record_id", "etag", "last_modified", "digest", F.coalesce("headers", none).alias("headers")).alias("r"),
    ).filter("full or revisit")
    known = rows.filter("canonical is not null and ts is not null").withColumn("t#", F.col("ts").cast("double"))
    cuts = known.approxQuantile("t#", [k / slices for k in range(1, slices)], 0.25 / slices) if slices > 1 else []
    splits = [-math.inf, *(sorted(set(cuts)) or [0.0]), math.inf]
    placed = Bucketizer(splits=splits, inputCol="t#", outputCol="slice").transform(known)
    line = placed.groupBy("canonical", "slice", "ts").agg(F.max_by(F.when(F.col("full"), F.col("r")), F.when(F.col("full"), F.struct("record_id"))).alias("here"), F.max("revisit").alias("asked"))
    ends = line.filter("here is not null").groupBy("canonical", "slice").agg(F.max_by("here", "ts").alias("end"))
    seen = line.filter("asked").select("canonical", "slice").distinct()
    over = W.partitionBy("canonical").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = seen.join(ends, ["canonical", "slice"], "full").withColumn("before", F.last("end", ignorenulls=True).over(over)).select("canonical", "slice", "before")
    inside = W.partitionBy("canonical", "slice").orderBy("ts").rowsBetween(W.unboundedPreceding, -1)
    answers = line.withColumn("last", F.last("here", ignorenulls=True).over(inside)).filter("asked").join(carried, ["canonical", "slice"], "left")
    answers = answers.select("canonical", "ts", F.coalesce("last", "before").alias("old"))
    found = known.filter("revisit").drop("t#").join(answers, ["canonical", "ts"], "left").select("record_id", "canonical", "r", "old")
    lost = rows.filter("revisit and (canonical is null or ts is null)").select("record_id", "canonical", "r", F.lit(None).cast(found.schema["old"].dataType).alias("old"))
    found = found.unionByName(lost)
    pairs = [(_strong(F.col("r.etag")), _strong(F.col("old.etag"))), (F.col("r.last_modified"), F.col("old.last_modified")), (F.col("r.digest"), F.col("old.digest"))]
    compared = [F.when(a.isNotNull() & b.isNotNull(), a == b) for a, b in pairs]
    differs = F.lit(False)
    for c in compared:
        differs = differs | F.coalesce(~c, F.lit(False))
    status = F.when(F.col("old").isNull(), "no_response").when(differs, "mismatch").when(F.coalesce(*compared).isNull(), "no_validator").otherwise("resolved")
    out = found.withColumn("status", status)
    return out.select(
        "record_id", "canonical", F.col("old.record_id").alias("response_id"), "status",
        F.when(F.col("status") == "resolved", _merged(F.col("old.headers"), F.col("r.headers"))).alias("headers"),
    )
