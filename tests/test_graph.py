import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vellum.operators import graph, notes, traverse


def vault(spark, files, **kwargs):
    df = spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(files.items())], "scan_ordinal long, path string, content string")
    parsed = notes.parse_notes(df)
    return graph.Analysis(parsed, notes.raw_links(parsed), **kwargs)


FILES = {
    "index.md": "[[a/alpha]] [[beta]]",
    "a/alpha.md": "[[beta]]\n[[gamma|g]] [[beta]]\n[[#here]] [[alpha]] [[pic.png]] ![[x/y.pdf]]",
    "beta.md": "[[a/gamma.md]] [[index]]",
    "a/gamma.md": "[[../beta]] [[./none]] [[same]] [[nowhere]] [[no/where]]",
    "b/same.md": "",
    "c/same.md": "---\ntitle: The Lonely Note\naliases: [lonely one]\n---\n",
    "d.md": "Here the lonely note is named, and a LONELY ONE, not thelonely note.",
}


def test_edges_degrees_issues_orphans(spark):
    g = vault(spark, FILES)
    assert {(r.source, r.target, r.line) for r in g.edges.collect()} == {
        ("a/alpha.md", "beta.md", 1), ("a/alpha.md", "a/gamma.md", 2), ("beta.md", "a/gamma.md", 1), ("a/gamma.md", "beta.md", 1),
    }
    assert {(r.id, r.inbound, r.outbound) for r in g.degrees.collect() if r.inbound or r.outbound} == {("beta", 2, 1), ("a/gamma", 2, 1), ("a/alpha", 0, 2)}
    assert g.degrees.count() == 6
    assert {(r.kind, r.target, r.n_candidates) for r in g.issues.collect()} == {("broken", "./none", 0), ("ambiguous", "same", 2), ("broken", "nowhere", 0), ("broken", "no/where", 0)}
    assert {r.candidate for r in graph.candidates(g.issues, g.notes).collect()} == {"b/same", "c/same"}
    assert {r.path for r in g.orphans.collect()} == {"b/same.md", "c/same.md", "d.md"}
    assert {r.what: r.n for r in g.summary().collect()} == {"notes": 6, "edges": 4, "broken": 3, "ambiguous": 1, "orphans": 3}
    assert [(r.target, r.source) for r in g.backlinks.collect()] == sorted((r.target, r.source) for r in g.backlinks.collect())


def test_mentions(spark, monkeypatch):
    named, other = ("d.md", 1, "c/same.md", "The Lonely Note"), ("a/gamma.md", 1, "b/same.md", "same")
    assert {tuple(r) for r in vault(spark, FILES).mentions.collect()} == {named, other}
    monkeypatch.setattr(graph, "PHRASE_BLOCK_CHARS", 8)
    assert {tuple(r) for r in vault(spark, FILES).mentions.collect()} == {named, other}
    linked = FILES | {"c/same.md": FILES["c/same.md"] + "[[d]]"}
    assert {tuple(r) for r in vault(spark, linked).mentions.collect()} == {other}
    shared = FILES | {"e.md": "---\ntitle: the lonely note\naliases: [Lonely One]\n---\n"}
    assert {tuple(r) for r in vault(spark, shared).mentions.collect()} == {other}


def test_suggestions_are_limited(spark):
    from pyspark.sql import functions as F

    g = vault(spark, FILES, suggest=F.col("id") != "d")
    assert {r.path for r in g.orphans.collect()} == {"b/same.md", "c/same.md"} and g.mentions.count() == 1


def test_catalog(spark):
    g = vault(spark, FILES | {"a/plan-x.md": "---\ntype: plan\nstatus: open\ntitle: P | ]] <!-- x\n---\nDo it."})
    text = graph.render_catalog(g.notes)
    assert text.startswith(graph.CATALOG_START) and text.endswith(graph.CATALOG_END)
    assert "- [[a/plan-x|P — ] ‹!-- x]] — Status: open. Do it." in text
    assert text.index("### A") < text.index("### B") < text.index("### Notes")
    once = graph.replace_catalog("# Index", text)
    assert graph.replace_catalog(once, text) == once
    with pytest.raises(ValueError):
        graph.replace_catalog(once + graph.CATALOG_START, text)
    assert "_No durable notes" in graph.render_catalog(g.notes.limit(0))


def reach(edges, notes_, start, direction, depth):
    seen, front = {start: 0}, {start}
    for d in range(1, depth + 1):
        step = {t for s, t in edges if s in front and direction != "in"} | {s for s, t in edges if t in front and direction != "out"}
        front = {n for n in step if n in notes_ and n not in seen}
        seen |= dict.fromkeys(front, d)
    return seen


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(edges=st.sets(st.tuples(st.sampled_from("abcdef"), st.sampled_from("abcdefx")), max_size=12), direction=st.sampled_from(["in", "out", "both"]), depth=st.integers(1, 3))
def test_neighborhood(spark, edges, direction, depth):
    nodes = spark.createDataFrame([(c,) for c in "abcdef"], "path string")
    rows = spark.createDataFrame([(a, b, 1) for a, b in edges], "source string, target string, line int")
    found = traverse.neighborhood(nodes, rows, "a", direction, depth)
    assert {r.path: r.distance for r in found.nodes.collect()} == reach(edges, "abcdef", "a", direction, depth) and not found.truncated
    assert {(r.source, r.target) for r in found.edges.collect()} <= edges


def test_neighborhood_is_truncated_in_order(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(6)], "path string")
    rows = spark.createDataFrame([("n0", f"n{i}", 1) for i in range(1, 6)], "source string, target string, line int")
    found = traverse.neighborhood(nodes, rows, "n0", "out", 1, 3)
    assert found.truncated and {r.path for r in found.nodes.collect()} == {"n0", "n1", "n2"} and found.edges.count() == 2
    for bad in ({"depth": 0}, {"depth": 11}, {"limit": 0}, {"limit": 1001}, {"direction": "up"}):
        with pytest.raises(ValueError):
            traverse.neighborhood(nodes, rows, "n0", **bad)


def test_lookup(spark):
    n = vault(spark, FILES).notes
    cases = {
        "a/alpha": ("found", "a/alpha.md"), "A/Alpha.md": ("found", "a/alpha.md"), "gamma": ("found", "a/gamma.md"), "lonely one": ("found", "c/same.md"),
        "a%2Fgamma": ("found", "a/gamma.md"), "nope": ("missing", None), " ": ("missing", None), "same": ("ambiguous", None),
    }
    for query, want in cases.items():
        found = traverse.lookup_note(n, query)
        assert (found.kind, found.path) == want, query
    assert traverse.lookup_note(n, "same").candidates == ("b/same.md", "c/same.md")


def test_every_edge_is_a_backlink(spark):
    names = [f"n{i}" for i in range(8)]
    files = {f"{a}.md": " ".join(f"[[{b}]]" for b in names[i + 1 :: 2]) for i, a in enumerate(names)}
    g = vault(spark, files)
    want = {(f"{a}.md", f"{b}.md") for i, a in enumerate(names) for b in names[i + 1 :: 2]}
    assert {(r.source, r.target) for r in g.edges.collect()} == want == {(r.source, r.target) for r in g.backlinks.collect()}
    assert sum(r.inbound for r in g.degrees.collect()) == len(want) == len(list(itertools.chain(want)))
