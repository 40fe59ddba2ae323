import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import search

DOCS = ["the cat sat on the mat", "the dog and the cat and the cat", "", None, "nothing here", "CAT cat Cat cat", "a dog"]


def test_bm25(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(DOCS)], "id int, body string, score int")
    words = {i: re.findall(r"\w+", t.lower()) for i, t in enumerate(DOCS) if t}
    mean = sum(map(len, words.values())) / len(words)

    def score(own, query):
        out = 0.0
        for q in query:
            n = sum(q in w for w in words.values())
            idf, tf = math.log(1 + (len(words) - n + 0.5) / (n + 0.5)), own.count(q)
            out += idf * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * len(own) / mean))
        return out

    want = sorted(((i, score(w, ["cat", "dog"])) for i, w in words.items()), key=lambda x: (-x[1], x[0]))
    want = [(i, s) for i, s in want if s > 0][:3]
    got = [(r.doc_id, r.score) for r in search.bm25(df, "id", "body", "Cat, dog!", 3).collect()]
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])
    for bad in (("?", 3), ("cat", 0), ("cat", 101)):
        with pytest.raises(ValueError):
            search.bm25(df, "id", "body", *bad)
    tf = {(r.doc_id, r.term): (r.tf, r.length) for r in search.postings(df, "id", "body").collect()}
    assert tf[1, "cat"] == (2, 8) and tf[5, "cat"] == (4, 4) and (3, "cat") not in tf


def test_nearest(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8)).round(1)
    v[7] = v[3]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(q, int(i)) for q in range(0, 60, 10) for i in sorted(range(60), key=lambda i: (-round(s[q, i], 12), i))[:4]}
    for block in (1024, 2):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        got = {(r.query_id, r.id) for r in search.nearest(df, df.filter("id % 10 = 0"), "id", "v", 4).collect()}
        assert got == want
    assert search.nearest(df, df.limit(0), "id", "v").count() == 0


def test_index(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, sha256 string")
    diff = search.index_diff(old, new)
    assert {(r.path, r.state) for r in diff.collect()} == {("a", "unchanged"), ("b", "updated"), ("c", "removed"), ("d", "new")}
    assert tuple(search.update_counts(diff).first()) == (1, 1, 1, 1, 2)
    text = "# A\nsome words\n\n## B\n" + "more words here\n" * 20
    notes = spark.createDataFrame([("n.md", text), ("e.md", "")], "path string, content string")
    parts = search.chunks(notes, 60).orderBy("chunk_no").collect()
    assert "".join(p.chunk for p in parts) == text and all(len(p.chunk) <= 60 for p in parts)
    assert all(text[p.start_pos :].startswith(p.chunk) for p in parts) and parts[0].sha256 == hashlib.sha256(text.encode()).hexdigest()
    vectors = search.embedded(search.chunks(notes, 60), lambda texts: np.array([[len(t), 1.0] for t in texts]), 2)
    assert all(r.embedding == [float(len(r.chunk)), 1.0] for r in vectors.collect())


def test_hits(spark):
    body = "x " * 200 + "\nthe needle is here\n" + "y " * 500
    df = spark.createDataFrame([(body,)], "b string")
    at = search.snippet_offset(F.col("b"), "is needle")
    row = df.select(at.alias("at"), search.hit_line(F.col("b"), at).alias("line"), search.snippet(F.col("b"), at).alias("s")).first()
    assert row["at"] == body.index("needle") and row["line"] == 2 and row["s"].startswith("…") and row["s"].endswith("…") and "the needle is" in row["s"]
    notes = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "x"), ("c", "y")], "path string, content string")
    sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("one", "old", "x")}
    hits = spark.createDataFrame([("a", sha["one"], 0.9), ("b", sha["old"], 0.8), ("c", sha["x"], 0.7), ("a", sha["one"], 0.1)], "path string, sha256 string, score double")
    assert [(r.path, r.score) for r in search.live_hits(hits, notes, 0.5).collect()] == [("a", 0.9)]
    with pytest.raises(ValueError):
        search.live_hits(hits, notes, 2)
    assert search.path_handle("My Notes/Ünï___Code (1).md") == "my-notes/ünï/code-1.md"
    assert search.index_location("/r", "/c/") == "/c/" + hashlib.sha256(b"/r").hexdigest()[:20]
