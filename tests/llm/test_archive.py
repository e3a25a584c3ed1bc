from __future__ import annotations

from pyspark.sql import functions as F

from landledger.llm.archive import canonical_url, records_of_pages, resolve_revisits

SCHEMA = "record_id long, url string, ts long, kind string, headers map<string,string>, body string, state string"


def test_urls(spark):
    urls = {
        "HTTPS://WWW.Example.com:443/A/b/?utm_source=x#top": "example.com/A/b", "http://example.com/A/b": "example.com/A/b",
        "http://m.example.com/x?page=2&ref=y": "m.example.com/x?page=2", "http://e.com/?ref=y&a=1&gclid=2": "e.com?a=1", "e.com": "e.com",
    }
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", canonical_url(F.col("url")).alias("c")).collect()
    assert {r.url: r.c for r in rows} == urls


def test_revisits(spark):
    def response(i, ts, tag, body, url="http://e.com/a", **more):
        return (i, url, ts, "response", {**({"etag": tag} if tag else {}), "content-type": "t", "date": str(ts), **more}, body, "clash")

    def revisit(i, ts, tag, url="http://www.e.com/a/#x", **more):
        return (i, url, ts, "revisit", {**({"etag": tag} if tag else {}), "date": str(ts), "set-cookie": "no", **more}, None, "clash")

    records = [
        response(1, 10, '"a"', "A"), response(2, 5000, '"b"', "B"), response(3, 5000, '"c"', "C"), response(4, 9000, None, "D", **{"last-modified": "m"}),
        revisit(11, 5, '"a"'), revisit(12, 10, '"a"'), revisit(13, 11, 'W/"a"'), revisit(14, 4999, '"b"'), revisit(15, 5001, '"c"'),
        revisit(16, 5002, None), revisit(17, 9001, None, **{"last-modified": "m"}), revisit(18, 9001, None, **{"last-modified": "n"}),
        revisit(19, 9001, '"d"', url="http://other.com"), revisit(20, None, '"a"'), revisit(21, 9, '"a"', url=None),
    ]
    rows = {r.record_id: r for r in resolve_revisits(spark.createDataFrame(records, SCHEMA)).collect()}
    assert len(rows) == len(records)
    assert {i: (r.state, r.refers_to, r.body) for i, r in rows.items() if i > 10} == {
        11: ("orphan", None, None), 12: ("orphan", None, None), 13: ("resolved", 1, "A"), 14: ("stale", 1, None), 15: ("resolved", 3, "C"),
        16: ("unproven", 3, None), 17: ("resolved", 4, "D"), 18: ("stale", 4, None), 19: ("orphan", None, None),
        20: ("orphan", None, None), 21: ("orphan", None, None),
    }
    assert rows[13].headers == {"etag": 'W/"a"', "content-type": "t", "date": "11"}
    assert rows[1].state == "full" and rows[1].body == "A"
    assert resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_and_null_pages(spark):
    pages = spark.createDataFrame([(1, "http://e.com/a", None), (1, "http://e.com/a", None), (2, None, "x")], "page_id long, url string, html string")
    rows = resolve_revisits(records_of_pages(pages)).collect()
    assert sorted((r.record_id, r.state) for r in rows) == [(2, "full"), (2, "full"), (3, "resolved"), (3, "resolved"), (4, "full"), (5, "orphan")]
