import pytest
from pyspark.sql import functions as F

from vellum.functions import urls
from vellum.operators import captures

URLS = [
    ("https://x.com/ann/status/12?s=1#a", "x", "12"), ("https://mobile.twitter.com/ann/status/12", "x", "12"), ("https://x.com/ann", "generic", None),
    ("https://news.ycombinator.com/item?id=5", "hacker-news", "5"), ("https://www.reddit.com/r/a/comments/b1/t/c2/", "reddit", "c2"), ("https://redd.it/b1", "reddit", "b1"),
    ("https://bsky.app/profile/a.b/post/3k", "bluesky", "3k"), ("https://me.substack.com/p/x", "substack", None), ("https://instagram.com/reel/z/", "instagram", "z"),
    ("https://www.linkedin.com/posts/a_activity-123-x", "linkedin", "a_activity-123-x"), ("https://facebook.com/watch?v=9", "facebook", "9"),
    ("https://www.tiktok.com/@a/video/7", "tiktok", "7"), ("https://threads.net/@a/post/P", "threads", "P"), ("https://youtu.be/v1", "youtube", "v1"),
    ("https://www.youtube.com/shorts/s1", "youtube", "s1"), ("https://github.com/a/b/pull/4", "github", "4"), ("https://github.com/a/b", "generic", None),
    ("https://discuss.a.org/t/topic/88", "discourse", "88"), ("https://notx.com/ann/status/12", "generic", None), ("ftp://x.com/a", None, None), ("text", None, None), (None, None, None),
]


def test_platforms(spark):
    df = spark.createDataFrame([(i, u) for i, (u, *_) in enumerate(URLS)], "i int, url string")
    got = {r.i: r.c for r in df.select("i", urls.classified(F.col("url")).alias("c")).collect()}
    for i, (url, platform, content_id) in enumerate(URLS):
        assert (got[i].platform, got[i].content_id) == (platform, content_id) if platform else got[i] is None, url


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://a.b/c?utm_source=x&q=1&fbclid=2#f", "https://a.b/c?q=1"), ("https://a.b/?access_token=1&session-id=2", "https://a.b/"), ("https://a.b/c?key=1&keys=2", "https://a.b/c?keys=2"),
        ("https://x.com/a/status/1?s=20&t=z&k=1", "https://x.com/a/status/1?k=1"), ("https://a.b/c?s=20", "https://a.b/c?s=20"), ("https://a.b/c", "https://a.b/c"),
    ],
)
def test_canonical(spark, url, want):
    assert spark.range(1).select(urls.canonical(F.lit(url)).alias("u")).first().u == want


def test_slugs(spark):
    assert urls.slug("Ünï 'Code' — 2nd!") == "ünï-code-2nd" and len(urls.slug("x" * 200)) == 80 and urls.slug("--") == ""
    df = spark.createDataFrame([("a-title", "12"), ("a-12", "12"), ("x" * 80, "abc"), ("", "7"), ("t", None)], "b string, i string")
    assert [r.s for r in df.select(urls.with_id(F.col("b"), F.col("i")).alias("s")).collect()] == ["a-title-12", "a-12", "x" * 76 + "-abc", "post-7", "t"]


PAGES = [
    ("Please verify you are human to continue. Complete the captcha.", None, "blocked"), ("Access denied", None, "blocked"),
    ("This article explains how to solve the captcha: please verify you are human.", None, "complete"), ("x", "Just a moment...", "blocked"),
    ("You must be logged in to read this page, sorry about that.", None, "auth-required"), ("Please enable JavaScript to run this application.", None, "unsupported"),
    ("short", None, "unsupported"), (None, None, "unsupported"), ("log in to read more " + "text " * 400, None, "partial"), ("good content " * 30, None, "complete"),
]


def test_status_and_quality(spark):
    df = spark.createDataFrame([(i, c, t) for i, (c, t, _) in enumerate(PAGES)], "i int, content string, title string")
    verdict = captures.status(F.col("content"), F.col("title"), F.lit("page"), F.lit(False))
    rows = df.withColumn("v", verdict).withColumn("q", captures.quality(F.col("content"), F.col("v"), F.lit(2), F.lit("http"), F.lit(None).cast("string"))).orderBy("i").collect()
    assert [r.v for r in rows] == [w for *_, w in PAGES]
    text = PAGES[-1][0]
    assert rows[-1].q == 5000 + len(text) + 60 * 5 + 100 and rows[7].q == -5000 + 100
    thread = df.select(captures.status(F.col("content"), F.col("title"), F.lit("thread"), F.lit(False)).alias("v")).collect()[-1]
    assert thread.v == "partial"


def test_best_candidate(spark):
    rows = [("p", 1, "partial", 99, False), ("p", 2, "complete", 1, False), ("p", 3, "complete", 5, False), ("p", 4, "complete", 5, False), ("q", 5, "partial", 1, True), ("q", 6, "complete", 9, False)]
    df = spark.createDataFrame(rows, "page string, n int, status string, score int, official boolean")
    assert {(r.page, r.n) for r in captures.best_candidates(df, "page", "n").collect()} == {("p", 3), ("q", 6)}
    assert {(r.page, r.n) for r in captures.best_candidates(df, "page", "n", F.col("official")).collect()} == {("p", 3), ("q", 5)}


def test_small_expressions(spark):
    df = spark.createDataFrame([("1.2k", "a ![i](x) [l](y) b"), ("3M", ""), ("1,234", None), ("x", "ab c")], "n string, t string")
    marks = captures.marker_counts(F.col("t"))
    rows = df.select(captures.compact_count(F.col("n")).alias("c"), captures.word_count(F.col("t")).alias("w"), marks["images"].alias("i"), marks["links"].alias("l")).collect()
    assert [(r.c, r.w, r.i, r.l) for r in rows] == [(1200, 4, 1, 1), (3_000_000, 0, 0, 0), (1234, 0, 0, 0), (None, 2, 0, 0)]
    title = captures.plain_title(F.lit(" "), F.lit("x\n## Head \ny"), F.lit("https://a.b/c/d/"))
    assert spark.range(1).select(title.alias("t")).first().t == "Head"
    assert spark.range(1).select(captures.plain_title(F.lit(None).cast("string"), F.lit(""), F.lit("https://a.b/c/d/")).alias("t")).first().t == "d"
