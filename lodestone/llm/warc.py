"""WARC captures: not-modified revisits are resolved to the response they confirm.

For each revisit, the latest full response to the same canonical URL that is strictly earlier (an as-of join), a check that
the validators of both agree, and the response's headers with those updates that a 304 may carry.

All captures of a URL at one time have the same answer, so the as-of join is a running window over the distinct times of a URL,
however many captures fall on one of them. It runs within blocks of time that hold a bounded number of distinct times, and what
the blocks before left as their last response is carried in from one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units of time in a block, so distinct times of a URL that one window holds at most.
BLOCK = 20_000
#: Stands for a null time: before all others.
NEVER = -(2**62)
#: Header fields that a 304 response may update (RFC 9110, 15.4.5).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
#: Query parameters that do not change what is served.
IGNORED = r"^(utm_[a-z_]+|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """host/path?query: without scheme, `www.`, default port, fragment, trailing slashes and ignored parameters; the host in
    lower case, the parameters in order. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(IGNORED)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))


def weak(etag: Column) -> Column:
    """An entity tag for weak comparison; blank is none."""
    return F.nullif(F.regexp_replace(F.trim(etag), r"^W/", ""), F.lit(""))


def lower_names(headers: Column) -> Column:
    """A map with names in lower case; of names that differ in case only, the value of the first in order of the name as written."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    kept = F.array_distinct(names)
    return F.map_from_arrays(kept, F.transform(kept, lambda n: F.get(entries, (F.array_position(names, n) - 1).cast("int"))["value"]))


def resolve(captures: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per revisit row: id, canonical_url, at, response_id, outcome, headers.

    captures: id (long), url, at (long), revisit (boolean), headers (map of strings, names in any case: see `lower_names`).
    Validators are the headers etag and last-modified. outcome: `resolved` (those that both have agree, and there is one),
    `unverified` (none is in both), `mismatch`, `no_response`. Only the first two give merged headers; else the revisit's own
    stay. Responses at the same time: the largest id counts (a null one is the smallest), of equal ids that with the largest
    hash of its headers. Ids need not be unique: repeated revisits each get their row, repeated responses are one. A response
    without an id is found like any other, with a null response_id. A null URL matches nothing; a null time is before all
    others, so such a revisit finds nothing; a null map has no headers; null `revisit` counts as a response. Extra columns are
    ignored.
    """
    c = captures.select(F.col("id").cast("long").alias("id"), canonical_url(F.col("url")).alias("url"), F.coalesce(F.col("at").cast("long"), F.lit(NEVER)).alias("at"), F.coalesce("revisit", F.lit(False)).alias("revisit"), lower_names(F.col("headers")).alias("headers"))
    # which of the responses at one time counts
    place = F.when(~F.col("revisit"), F.struct(F.coalesce("id", F.lit(-(2**63))), F.xxhash64(F.map_entries("headers"))))
    times = c.where("url is not null").groupBy("url", "at").agg(F.max_by(F.struct("id", "headers"), place).alias("r"), F.bool_or("revisit").alias("asked"))
    times = times.withColumn("block", F.floor(F.col("at") / block))
    within = Window.partitionBy("url", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    seen = times.withColumn("here", F.last("r", ignorenulls=True).over(within)).where("asked").select("url", "block", "at", "here")
    ends = times.groupBy("url", "block").agg(F.max_by("r", F.when(F.col("r").isNotNull(), F.col("at"))).alias("end"))
    before = Window.partitionBy("url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("url", "block", F.last("end", ignorenulls=True).over(before).alias("carried"))
    found = seen.join(carried, ["url", "block"], "left").select("url", "at", F.coalesce("here", "carried").alias("r"))
    revisits = c.where("revisit").select("id", "url", "at", F.col("headers").alias("own"))
    both = revisits.join(found, ["url", "at"], "left").withColumn("theirs", F.col("r.headers"))
    tags = [weak(F.col(x)["etag"]) for x in ("own", "theirs")]
    times = [F.nullif(F.trim(F.col(x)["last-modified"]), F.lit("")) for x in ("own", "theirs")]
    outcome = (
        F.when(F.col("r").isNull(), "no_response")
        .when((tags[0] != tags[1]) | (times[0] != times[1]), "mismatch")
        .when((tags[0] == tags[1]) | (times[0] == times[1]), "resolved")
        .otherwise("unverified")
    )
    update = F.map_filter("own", lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter("theirs", lambda k, _: ~F.array_contains(F.map_keys(update), k)), update)
    both = both.withColumn("outcome", outcome)
    headers = F.when(F.col("outcome").isin("resolved", "unverified"), merged).otherwise(F.col("own"))
    return both.select("id", F.col("url").alias("canonical_url"), F.nullif("at", F.lit(NEVER)).alias("at"), F.col("r.id").alias("response_id"), "outcome", headers.alias("headers"))


def captures_of(pages: DataFrame, early: int = 500, late: int = 1000) -> DataFrame:
    """Captures as a crawl of `pages` would give them, in order of page_id: the full response, a conditional request for the
    same page `late` seconds after, and one `early` seconds before."""
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    base = pages.select(F.col("page_id").cast("long").alias("p"), "url", tag.alias("tag"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string").alias("size"))
    text = lambda c: c.cast("string")

    def one(shift: int, at: Column, revisit: bool, headers: list) -> Column:
        return F.struct((F.col("p") * 3 + shift).alias("id"), at.alias("at"), F.lit(revisit).alias("revisit"), F.create_map(*headers).alias("headers"))

    h = lambda *kv: [x if isinstance(x, Column) else F.lit(x) for x in kv]
    at = F.col("p")
    every = F.array(
        one(0, at, False, h("ETag", F.col("tag"), "Content-Type", "text/html", "Content-Length", F.col("size"), "Date", text(at), "Cache-Control", "max-age=60")),
        one(1, at + late, True, h("etag", F.concat(F.lit("W/"), F.col("tag")), "content-type", "text/plain", "date", text(at + late), "cache-control", "max-age=600")),
        one(2, at - early, True, h("ETag", F.col("tag"), "Date", text(at - early), "Expires", "0")),
    )
    return base.select("url", F.explode(every).alias("c")).select("url", "c.*")


def report(pages: DataFrame) -> DataFrame:
    """id, canonical_url, at, response_id, outcome and the headers as sorted `name: value` lines, for the captures of `pages`."""
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return resolve(captures_of(pages)).withColumn("headers", F.array_join(lines, "\n"))
