import random

import pytest
from pyspark.sql import functions as F

from codescout.llm import entry, urls

CASES = [
    # url, host, path, canonical
    (None, "", "", None),
    ("", "", "", None),
    ("no scheme/x", "", "", None),
    ("http://", "", "", ""),
    ("HTTP://WWW.Example.NET:80/en/?b=2&a=1&ref=x#top", "www.example.net:80", "/en/", "example.net/en?a=1&b=2"),
    ("https://a.org?x#y", "a.org", "", "a.org?x"),
    ("https://a.org#y/z", "a.org", "", "a.org"),
    ("x://y://z/p", "y:", "//z/p", "y://z/p"),
    ("https://ÄB.org/fr/x\ny", "Äb.org", "/fr/x\ny", "Äb.org/fr/x\ny"),
]


def test_parts(spark):
    frame = spark.createDataFrame([(c[0],) for c in CASES], "url string")
    got = frame.select("url", urls.host(F.col("url")), urls.path(F.col("url")), urls.canonical(F.col("url"))).collect()
    assert [tuple(r) for r in got] == CASES


def test_rules(spark):
    cases = [
        ("http://x.net/a", "net/", "block"),
        ("http://net/a", "net/", "block"),
        ("http://xnet/a", None, "allow"),
        ("http://example.net/en/1", "example.net/en/", "allow"),
        ("http://m.example.net/en/1", "example.net/en/", "allow"),
        ("http://m.example.net/en", "net/", "block"),
        ("http://badexample.com/de/", None, "allow"),
        ("http://example.com/de/", "example.com/de/", "block"),
        ("http://a.org/fr/", "org/fr/", "allow"),
        ("http://x.net", None, "allow"),
    ]
    frame = spark.createDataFrame([(i, c[0], "z") for i, c in enumerate(cases)], "page_id long, url string, verdict string")
    got = urls.judge(frame, frame.limit(0), entry.URL_RULES).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [c[1:] for c in cases]


@pytest.mark.parametrize("most_blocks", [1, 1 << 17])
def test_list_is_exact_whatever_the_filter(spark, most_blocks):
    draw = random.Random(1)
    listed = [(f"http://www.h{draw.randrange(50)}.com/p{draw.randrange(400)}/",) for _ in range(1500)] + [(None,), ("x",)]
    pages = [(i, f"https://h{draw.randrange(50)}.com/p{draw.randrange(400)}#f", "z") for i in range(3000)] + [(-1, None, "z"), (None, "https://q.com", "z")]
    pages += [(5, pages[5][1], "z")] * 3
    frame = spark.createDataFrame(pages, "page_id long, url string, listed string")
    names = {u.split("www.")[1].rstrip("/") for u, in listed if u and "://" in u}
    got = urls.judge(frame, spark.createDataFrame(listed, "url string"), [], most_blocks=most_blocks).collect()
    want = [(i, u is not None and u[8:].split("#")[0] in names) for i, u, _ in pages]
    assert sorted(((r.page_id, r.listed) for r in got), key=str) == sorted(want, key=str)
    assert all(r.verdict == ("block" if r.listed else "allow") for r in got)


def test_the_filter_stops_most_that_is_not_listed(spark):
    listed = spark.range(4000).select(F.concat(F.lit("h/"), F.col("id")).alias("u"))
    table, blocks = urls.bloom_table(listed, "u")
    others = spark.range(10_000, 30_000).select(F.concat(F.lit("h/"), F.col("id")).alias("u"))
    for frame, low, high in ((listed, 4000, 4000), (others, 0, 200)):
        probed = frame.withColumn("_block", urls._block(F.col("u"), blocks)).join(table, "_block")
        hit = probed
        for i in range(urls.WORDS):
            hit = hit.filter(F.col(f"_w{i}").bitwiseAND(urls._bit(F.col("u"), i)) != 0)
        assert low <= hit.count() <= high


def test_no_rows(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(none, none, entry.URL_RULES).count() == 0
