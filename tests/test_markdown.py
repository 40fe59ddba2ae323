import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from vellum.functions import markdown as md
from vellum.operators import notes


def test_metadata_is_core_yaml():
    n = md.parse_note("a.md", "---\na: yes\nb: 2024-01-02\nc: 1:30\nd: 017\ne: 0o17\nf: 1e3\ng: [1, x, null, true]\nh: {i: ~}\nj: 1_000\n---\n")
    assert n.metadata == {"a": "yes", "b": "2024-01-02", "c": "1:30", "d": 17, "e": 15, "f": 1000.0, "g": [1, "x", None, True], "h": {"i": None}, "j": "1_000"}
    assert n.properties["f"] == "1000" and "g" not in n.properties


@pytest.mark.parametrize("head", ["a: 1\na: 2", "a: 1\nA: 2", "a: .inf", "a: 9007199254740993", "- a", "a: [", "text only: : :"])
def test_malformed_metadata(head):
    with pytest.raises(md.NoteError, match="x.md"):
        md.parse_note("x.md", f"---\n{head}\n---\nbody")


def test_unclosed_and_blank_metadata():
    with pytest.raises(md.NoteError):
        md.parse_note("x.md", "---\na: 1\n")
    assert md.parse_note("x.md", "---\n# only a comment\n---\n").metadata == {} == md.parse_note("x.md", "---\n---\n").metadata


def test_titles_tags_aliases():
    n = md.parse_note("dir/my-note.md", "---\nTAGS: ['#A', a, ' b ', 3]\naliases: [x, '', 4]\n---\n")
    assert (n.title, n.tags, n.aliases) == ("my note", ["a", "b"], ["x"])
    assert md.parse_note("a.md", "text\n# *Head* [[x|line]]\n").title == "Head line"
    assert md.parse_note("a.md", "---\ntitle: T\naliases: one\n---\n# H").aliases == ["one"]


@pytest.mark.parametrize(
    "text",
    [
        "```\n[[x]]\n```", "~~~ a`b\n[[x]]\n~~~", "    [[x]]", "\t[[x]]", "<!-- [[x]]\n[[x]] -->", "`[[x]]`", "``a ` [[x]]``", "<pre>\n[[x]]</pre>", "<code><code>[[x]]</code>[[x]]</code>",
        r"\[[x]]", "````\n```\n[[x]]\n````",
    ],
)
def test_code_and_comments_hold_no_links(text):
    assert md.parse_note("a.md", text).links == []


@pytest.mark.parametrize(
    "text,line", [("a\n\n[[x]]", 3), ("`a\n\n[[x]] `", 3), ("```\na\n```\n[[x]]", 4), ("<!-- a -->[[x|y]]", 1), (r"\\[[x]]", 1), ("# `a\n[[x]] b`", 2), ("``` a`b\n[[x]]", 2)]
)
def test_links_with_lines(text, line):
    assert [(t, n) for t, n, _ in md.parse_note("a.md", text).links] == [("x", line)]


@given(st.text(alphabet="ab`~<!->\n [](#)*\\|", max_size=80))
def test_masking_keeps_lines(text):
    assert md.prose(text).count("\n") == text.count("\n")


def test_summary():
    long = "word " * 60
    assert md.parse_note("a.md", f"# H\n\n- item\n\n{long}").summary == ("word " * 36).strip() + "…"
    assert md.concise("x" * 300) == "x" * 180 + "…"
    assert md.units("a👍") == 3 and md.clipped("a👍b", 2) == "a"


def test_parse_notes(spark):
    rows = [(0, "a.md", "---\nn: 1\n---\n[[b]] ![[c.png]]"), (1, "b.md", None), (2, "bad.md", "---\n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "scan_ordinal int, path string, content string, title string")
    out = {r.path: r for r in notes.parse_notes(df, on_error="quarantine").collect()}
    assert json.loads(out["a.md"].metadata) == {"n": 1} and out["b.md"].title == "b" and out["bad.md"].error
    links = notes.raw_links(notes.parse_notes(df.filter("path != 'bad.md'"))).collect()
    assert [(r.source_id, r.ordinal, r.target, r.line, r.embedded) for r in links] == [("a", 0, "b", 4, False), ("a", 1, "c.png", 4, True)]
    with pytest.raises(Exception, match="bad.md"):
        notes.parse_notes(df).collect()
