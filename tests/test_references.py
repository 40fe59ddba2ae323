from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import paths
from vellum.operators import references as ref

SPANS = "k string, s timestamp_ntz, e timestamp_ntz"
REFS = "row_id long, ref_key string, moment timestamp_ntz, reason string, span string, salt int, at string, n_salts string"


def day(n):
    return None if n is None else datetime(2024, 1, 1 + n)


def orphans(spark, refs, spans):
    r = spark.createDataFrame([(i, k, day(t), "x", "y", 1, "z", "w") for i, (k, t) in enumerate(refs)], REFS)
    p = ref.parent_spans(spark.createDataFrame([(k, day(a), day(b)) for k, a, b in spans], SPANS), F.col("k"), F.col("s"), F.col("e"))
    return {row.row_id: row.reason for row in ref.orphan_references(r, p).collect()}


def brute(refs, spans):
    out = {}
    for i, (k, t) in enumerate(refs):
        own = [(a, b) for key, a, b in spans if key == k]
        if k is None:
            continue
        if not own:
            out[i] = "missing"
        elif t is None or any((a is None or a <= t) and (b is None or t < b) for a, b in own):
            continue
        else:
            out[i] = "late" if all(a is not None and a > t for a, _ in own) else "deleted"
    return out


def test_reasons(spark):
    spans = [("a", 5, 8), ("a", 10, None), ("b", None, 3), ("c", 4, None), ("c", 4, None)]
    refs = [("a", 4), ("a", 5), ("a", 8), ("a", 10), ("b", 2), ("b", 3), ("c", 3), ("c", 4), ("d", 1), (None, 1), ("d", None), ("a", None)]
    assert orphans(spark, refs, spans) == brute(refs, spans) == {0: "late", 2: "deleted", 5: "deleted", 6: "late", 8: "missing", 10: "missing"}


def test_hot_key_is_salted(spark, monkeypatch):
    monkeypatch.setattr(ref, "SALT_ROWS", 10)
    refs = [("hot", i % 9) for i in range(300)] + [("cold", 1), ("none", 2)]
    spans = [("hot", 2, 4), ("hot", 6, 7), ("cold", 0, None)]
    assert orphans(spark, refs, spans) == brute(refs, spans)
    r = spark.createDataFrame([(i, k, day(t), "", "", 0, "", "") for i, (k, t) in enumerate(refs)], REFS)
    assert [tuple(x) for x in ref.hot_salts(r).collect()] == [("hot", 30)]


@pytest.mark.parametrize("broadcast", [0, 20_000])
def test_many_hot_keys(spark, monkeypatch, broadcast):
    """No key is too many: six hundred hot ones are all salted, whether their salts are broadcast or joined."""
    monkeypatch.setattr(ref, "SALT_ROWS", 2)
    monkeypatch.setattr(ref, "BROADCAST_KEYS", broadcast)
    refs = [(f"k{i % 600}", i % 9) for i in range(3000)]
    spans = [(f"k{i}", 2, 5) for i in range(0, 600, 2)]
    assert orphans(spark, refs, spans) == brute(refs, spans)


def test_empty_tables(spark):
    assert orphans(spark, [], [("a", 1, 2)]) == {}
    assert orphans(spark, [("a", 1)], []) == {0: "missing"}


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    refs=st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 9))), max_size=8),
    spans=st.lists(st.tuples(st.sampled_from(["a", "b"]), st.one_of(st.none(), st.integers(0, 9)), st.one_of(st.none(), st.integers(0, 9))), max_size=6),
)
def test_against_brute_force(spark, refs, spans):
    assert orphans(spark, refs, spans) == brute(refs, spans)


@pytest.mark.parametrize(
    "target,source,want",
    [
        ("a/b", "x/y.md", "id:a/b"), ("/a/b.md", "x/y.md", "id:a/b"), ("b", "x/y.md", "name:b"), ("b.MD#h", "x/y.md", "name:b"), ("../b", "x/y.md", "id:b"),
        ("./b^c", "x/y.md", "id:x/b"), ("a%2Fb", "x.md", "id:a/b"), ("a\\b", "x.md", "id:a/b"), ("img/x.PNG", "x.md", None), ("v0.5", "x.md", None), ("", "x.md", None),
        (" #a", "x.md", None), (None, "x.md", None), ("a%zz", "x.md", "name:a%zz"), ("a+b", "x.md", "name:a+b"), ("../../b", "x/y.md", "id:../b"), ("./b", None, "id:b"),
    ],
)
def test_target_rules(spark, target, source, want):
    df = spark.createDataFrame([(target, source)], "target string, source_path string")
    assert ref.with_target_key(df).first().target_key == want


def test_bare_names_prefer_the_root_note(spark):
    notes = spark.createDataFrame([("b.md", "b", day(3), None), ("x/b.md", "x/b", day(0), None), ("y/c.md", "y/c", day(0), day(1)), ("z/c.md", "z/c", day(2), None)], "path string, note_id string, added_at timestamp_ntz, removed_at timestamp_ntz")
    rows = {(r.ref_key, r.start_at.day) for r in ref.note_name_spans(notes).filter("ref_key LIKE 'name:%'").collect()}
    assert rows == {("name:b", 4), ("name:c", 1), ("name:c", 3)}


def test_paths(spark):
    cases = [("a/./b/../c", "a/c"), ("../a", "../a"), ("a/..", "."), ("", "."), ("a//b", "a/b")]
    df = spark.createDataFrame(cases, "p string, want string")
    assert all(r.got == r.want for r in df.select("want", paths.normalized(F.col("p")).alias("got")).collect())


def test_query(spark, data):
    rows = ref.p6_found(spark, data).collect()
    assert rows and {r.reason for r in rows} <= {"missing", "late", "deleted"}
    assert sum(r.n_refs for r in ref.p6_report(spark, data).collect()) == len(rows)
