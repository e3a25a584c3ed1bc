"""Revisits of a web archive: the latest earlier full response of the same canonical URL, as-of joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landledger.functions.ordered import with_greatest_before
from landledger.session import settle

# Query parameters that do not name a page; headers that a not-modified answer may change.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*"
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Time units in a block of one URL; a URL's records are looked at block by block.
BLOCK = 4096


def canonical_url(url: Column) -> Column:
    """Host in lower case without www, no scheme, fragment, default port, tracking or closing slash."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^[^/?]*", 0)), r":(?:80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_replace(F.regexp_extract(u, r"\?(.*)$", 1), rf"(?:^|&){TRACKING}(?=&|$)", "")
    query = F.regexp_replace(query, r"^&+|&+$", "")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every record with canonical_url, refers_to, state, merged headers and body.

    ``records``: record_id, url, ts (whole number), kind ("response" or "revisit"), headers
    (map, names in lower case) and body. State of a revisit: "resolved" with the body and
    headers of the latest response with an earlier ts, changed by the permitted headers of the
    revisit; "stale" if its validator (etag, compared weakly, or else last-modified) is not that
    of the response; "unproven" if there is none to compare; "orphan" without an earlier
    response. Only resolved ones have a body. Responses are "full" and stay as they are.

    Of responses at one ts the one with the largest record_id counts. Records without url or
    ts refer to nothing (orphan). record_id must be unique; repeated rows of one are kept and
    resolved alike. Other columns are left out. No rows give no rows.
    """
    named = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "kind",
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "body",
    )
    full = F.col("kind") == "response"
    light = named.select(
        "record_id", "canonical_url", "ts", full.cast("int").alias("full"),
        _weak(F.try_element_at("headers", F.lit("etag"))).alias("etag"), F.try_element_at("headers", F.lit("last-modified")).alias("modified"),
    ).filter("canonical_url is not null and ts is not null").distinct()
    latest = F.when(F.col("full") == 1, F.struct("ts", "record_id", "etag", "modified"))
    seen = with_greatest_before(light, ["canonical_url"], ["ts", "full", "record_id"], f"ts div {BLOCK}", latest, "found").filter("full = 0")
    state = (
        F.when(F.col("found").isNull(), "orphan")
        .when(F.col("etag").isNotNull() & F.col("found.etag").isNotNull(), F.when(F.col("etag") == F.col("found.etag"), "resolved").otherwise("stale"))
        .when(F.col("modified").isNotNull() & F.col("found.modified").isNotNull(), F.when(F.col("modified") == F.col("found.modified"), "resolved").otherwise("stale"))
        .otherwise("unproven")
    )
    judged = settle(seen.select(F.col("record_id").alias("of"), F.col("found.record_id").alias("refers_to"), state.alias("state")))
    revisits = (
        named.filter(~full).drop("body").join(judged, F.col("record_id") == F.col("of"), "left").drop("of")
        .withColumn("state", F.coalesce("state", F.lit("orphan")))
    )
    wanted = judged.filter("state = 'resolved'").select(F.col("refers_to").alias("record_id")).distinct()
    bodies = (
        named.filter(full).join(wanted, "record_id", "left_semi").dropDuplicates(["record_id"])
        .select(F.col("record_id").alias("from"), F.col("headers").alias("old"), "body")
    )
    permitted = lambda k, v: k.isin(*PERMITTED)
    new = F.map_filter("headers", permitted)
    merged = F.map_concat(F.map_filter("old", lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)
    columns = ["record_id", "canonical_url", "ts", "kind", "refers_to", "state", "headers", "body"]
    resolved = revisits.join(bodies, (F.col("refers_to") == F.col("from")) & (F.col("state") == "resolved"), "left").withColumn(
        "headers", F.when(F.col("state") == "resolved", merged).otherwise(F.col("headers"))
    )
    whole = named.filter(full).withColumns({"refers_to": F.lit(None).cast(named.schema["record_id"].dataType), "state": F.lit("full")})
    return whole.select(*columns).unionByName(resolved.select(*columns))


def records_of_pages(pages: DataFrame, later: int = 5000) -> DataFrame:
    """A small archive from raw pages: each is fetched at its page_id and asked for again ``later`` on.

    The second answer is a revisit with the validator of the page; another page of the same URL
    fetched in between makes it stale.
    """
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    first = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.col("page_id").alias("ts"), F.lit("response").alias("kind"),
        F.create_map(
            F.lit("etag"), tag, F.lit("content-type"), F.lit("text/html"), F.lit("date"), F.col("page_id").cast("string"),
            F.lit("content-length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"),
        ).alias("headers"), F.col("html").alias("body"),
    )
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") + later).alias("ts"), F.lit("revisit").alias("kind"),
        F.create_map(
            F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("date"), (F.col("page_id") + later).cast("string"), F.lit("cache-control"), F.lit("max-age=60"),
            F.lit("set-cookie"), F.lit("a=b"),
        ).alias("headers"), F.lit(None).cast("string").alias("body"),
    )
    return first.unionByName(again)
