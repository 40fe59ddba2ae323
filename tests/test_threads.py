import json

import pytest

from vellum.operators import threads

SCHEMA = "entry_row_id long, thread_id string, entry_id string, parent_id string, relation string, tree_depth int, ordinal int, kind string, author_name string, handle string, text string, reason string, replies long, captured_at timestamp"


def entries(spark, rows):
    full = [(i, t, e, p, "reply" if p else "root", 0, o, k, "A", "a", f"text {e}\nmore", None, 5, None) for i, (t, e, p, o, k) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


ROWS = [
    ("t", "r", None, 0, "content"), ("t", "a", "r", 1, "content"), ("t", "b", "r", 2, "unavailable"), ("t", "c", "a", 3, "more"), ("t", "a", "r", 1, "content"),
    ("t", "lost", "gone", 9, "content"), ("u", "x", "y", 1, "content"), ("u", "y", "x", 2, "content"), ("v", "z", None, None, "content"),
]


def test_linking_and_counts(spark):
    once = threads.distinct_entries(entries(spark, ROWS))
    assert once.count() == len(ROWS) - 1
    rows = {(r.thread_id, r.entry_id): (r.depth, list(r.path)) for r in threads.linked(once).collect()}
    assert rows["t", "c"] == (2, [0, 1, 3]) and rows["t", "lost"] == (0, [9]) and rows["u", "x"][0] == 0 and rows["v", "z"] == (0, [0])
    counts = {r.thread_id: r for r in threads.thread_counts(once).collect()}
    assert (counts["t"].n_content, counts["t"].n_unavailable, counts["t"].n_more, counts["t"].status) == (3, 1, 1, "partial")
    shown = {r.thread_id: r.markdown for r in threads.rendered(threads.linked(once)).collect()}
    assert shown["t"].split("\n") == ["- **A**: text r more", "  - **A**: text a more", "    - **A**: _more replies_", "  - **A**: _unavailable_", "- **A**: text lost more"]


def test_deep_chain(spark):
    rows = [("d", f"e{i}", f"e{i - 1}" if i else None, i, "content") for i in range(30)]
    assert max(r.depth for r in threads.linked(entries(spark, rows)).collect()) == 29


def test_chain_beyond_the_deepest_indent(spark):
    """Entries below level 64 keep their place; only the indent stops there."""
    rows = [("d", f"e{i}", f"e{i - 1}" if i else None, i, "content") for i in range(70)]
    placed = threads.linked(entries(spark, rows)).cache()
    assert {r.entry_id: (r.depth, len(r.path)) for r in placed.collect()} == {f"e{i}": (i, i + 1) for i in range(70)}
    lines = threads.rendered(placed).first().markdown.split("\n")
    assert lines[69].startswith("  " * 64 + "- ") and "text e69" in lines[69]


HN = {"root": 1, "items": {"1": {"by": "ann", "title": "T", "kids": [3, 2, 9], "time": 0, "descendants": 3}, "2": {"by": "bob", "text": "a<p>b <i>c</i> &amp; <a href=\"https://u.test/\">l</a> <a href=\"javascript:x\">k</a>"}, "3": {"deleted": True}}}
REDDIT = [
    {"data": {"children": [{"kind": "t3", "data": {"id": "p", "title": "T", "selftext": "body", "author": "ann", "created_utc": 1.5, "permalink": "/r/x"}}]}},
    {"data": {"children": [{"kind": "t1", "data": {"id": "c", "body": "[removed]", "replies": {"data": {"children": [{"kind": "more", "data": {"id": "m"}}]}}}}]}},
]
SKY = {"thread": {"post": {"uri": "at://d/p/2", "author": {"handle": "h", "displayName": "H"}, "record": {"text": "two"}}, "parent": {"post": {"uri": "at://d/p/1", "record": {"text": "one"}}}, "replies": [{"notFound": True, "uri": "at://d/p/3"}]}}
X = [{"id": "1", "text": "a", "author": {"username": "u", "name": "U"}}, {"id": "2", "text": "b", "inReplyToStatusId": "1"}, {"id": "2", "text": "again"}, {"id": "4", "text": "c", "inReplyToStatusId": "5"}, {"id": "5", "text": "d", "inReplyToStatusId": "4"}]


def test_parsers(spark):
    rows = [("h", "hacker-news", json.dumps(HN)), ("r", "reddit", json.dumps(REDDIT)), ("b", "bluesky", json.dumps(SKY)), ("x", "x", json.dumps(X)), ("?", "mastodon", "{}"), ("!", "reddit", "no json"), ("0", "x", None)]
    df = spark.createDataFrame(rows, "thread_id string, platform string, raw string")
    out = {}
    for r in threads.parse_threads(df).collect():
        out.setdefault(r.thread_id, []).append(r)
    out = {k: sorted(v, key=lambda r: r.ordinal) for k, v in out.items()}
    assert [(r.entry_id, r.parent_id, r.kind, r.reason) for r in out["h"]] == [("1", None, "content", None), ("3", "1", "unavailable", "deleted"), ("2", "1", "content", None), ("9", "1", "unavailable", "not-found")]
    assert out["h"][2].text == "a\n\nb *c* & [l](<https://u.test/>) k" and out["h"][0].created_at == "1970-01-01T00:00:00.000Z"
    assert [(r.entry_id, r.tree_depth, r.kind) for r in out["r"]] == [("p", 0, "content"), ("c", 1, "unavailable"), ("m", 2, "more")] and (out["r"][0].title, out["r"][0].text) == ("T", "body")
    assert [(r.entry_id, r.parent_id, r.kind) for r in out["b"]] == [("1", None, "content"), ("2", "1", "content"), ("3", "2", "unavailable")]
    assert [(r.entry_id, r.parent_id, r.kind) for r in out["x"]][:5] == [("1", None, "content"), ("2", "1", "content"), ("4", None, "content"), ("5", "4", "content"), ("4", "5", "boundary")]
    assert [r.reason for r in out["x"] if r.kind == "warning"] == ["a cycle at entry 4 was cut", "repeated post 2 was skipped"]
    assert out["?"][0].kind == out["!"][0].kind == out["0"][0].kind == "boundary"


def test_limits():
    assert [e["kind"] for e in threads.hacker_news(json.dumps(HN), threads.Limits(items=2))] == ["content", "unavailable", "boundary", "warning"]
    assert [e["reason"] for e in threads.x_posts(json.dumps([{"id": str(i), "text": "t"} for i in range(20)]), threads.Limits(items=3)) if e["kind"] == "warning"] == ["posts were truncated to 3"]
    photo = {"type": "photo", "url": "https://p.test/1"}
    assert len(next(threads.x_posts(json.dumps({"id": 1, "text": "t", "media": [photo] * 9}), threads.Limits(media=2)))["media"]) == 2
    assert next(threads.reddit(json.dumps(REDDIT), threads.Limits(text=3)))["text"].endswith("[…]")
    with pytest.raises(ValueError):
        threads.Limits(depth=0)


def test_entries_without_id_stay_apart(spark):
    once = threads.distinct_entries(entries(spark, [("t", None, None, 0, "content"), ("t", None, None, 1, "content"), ("t", "a", None, 2, "content")]))
    assert once.count() == 3 and threads.linked(once).count() == 3


def test_unmatched_brackets_end_soon():
    import time

    begun = time.monotonic()
    assert threads.comment_markdown("<" * 200_000) == "<" * 200_000 and time.monotonic() - begun < 5
    assert threads.comment_markdown("One<p>Two<br><b>b</b> <em>s</em><pre><code>x &amp; y</code></pre>") == "One\n\nTwo\n**b** *s*\n\n```\nx & y\n```"
