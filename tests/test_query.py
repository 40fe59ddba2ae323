import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vellum.plans import query as q

META = [
    {"status": "Draft", "priority": 3, "owner": {"name": "Ann", "teams": ["x", "Y"]}}, {"status": "draft", "priority": "3"}, {"Status": "done", "priority": None}, {},
    {"priority": True, "tags": [1]}, {"priority": [2, 1]}, {"priority": {"b": 1, "a": 2}}, {"priority": 10.0, "a.b": 1}, {"K": 1, "k": 2}, {"priority": -1},
]


@pytest.fixture(scope="module")
def notes(spark):
    rows = [(i, f"n{i}.md", f"n{i}", f"T{i}", ["Inbox", "#b"] if i % 2 else [], json.dumps(m)) for i, m in enumerate(META)]
    rows.append((10, "n10.md", "n10", None, None, None))
    return spark.createDataFrame(rows, "scan_ordinal int, path string, id string, title string, tags array<string>, metadata string")


def ids(df):
    return [int(r.path[1:-3]) for r in df.collect()]


@pytest.mark.parametrize(
    "f,want",
    [
        (q.Equals("status", "DRAFT"), [0, 1]), (q.Equals("STATUS", "done"), [2]), (q.Equals("priority", 3), [0]), (q.Equals("priority", "3"), [1]), (q.Equals("priority", None), [2]),
        (q.Equals("priority", True), [4]), (q.Equals("priority", 2), [5]), (q.Equals("priority", 10), [7]), (q.Equals("owner.teams", "y"), [0]), (q.Equals("owner.teams.0", "X"), [0]),
        (q.Equals("owner", "Ann"), []), (q.Equals(["a.b"], 1), [7]), (q.Exists("priority"), [0, 1, 2, 4, 5, 6, 7, 9]), (q.Exists("k"), [8]), (q.Exists("owner..name"), []),
        (q.Exists(""), []), (q.Exists("owner.teams.2"), []), (q.Exists("owner.teams.01"), []),
    ],
)
def test_filters(notes, f, want):
    assert ids(q.run(notes, q.Query([f]))) == want


def test_ambiguous_keys_are_not_found(notes):
    assert ids(q.run(notes, q.Query([q.Equals("K", 1)]))) == [8] and ids(q.run(notes, q.Query([q.Exists("Á")]))) == []


def test_tags(notes):
    assert ids(q.run(notes, q.Query(tags=["#INBOX", "b"]))) == [1, 3, 5, 7, 9]
    assert ids(q.run(notes, q.Query(tags=["inbox", " "]))) == []


def test_order_of_types(notes):
    up = ids(q.run(notes, q.Query(sort=q.Sort("priority", metadata=True))))
    down = ids(q.run(notes, q.Query(sort=q.Sort("priority", True, True))))
    assert up == [2, 4, 9, 0, 7, 1, 5, 6, 10, 3, 8]
    assert down == [6, 5, 1, 7, 0, 9, 4, 2, 10, 3, 8]


def test_limit_and_builtin(notes, spark):
    assert ids(q.run(notes, q.Query(limit=0))) == [] and ids(q.run(notes, q.Query(sort=q.Sort("title"), limit=2))) == [0, 1]
    degrees = spark.createDataFrame([(f"n{i}", i % 3, 1) for i in range(9)], "id string, inbound int, outbound int")
    assert ids(q.run(notes, q.Query(sort=q.Sort("inbound", True), limit=4), degrees)) == [2, 5, 8, 1]
    for bad in ({"limit": -1}, {"limit": 1.5}):
        with pytest.raises(ValueError):
            q.Query(**bad)
    with pytest.raises(ValueError):
        q.run(notes, q.Query(sort=q.Sort("size")))


@pytest.mark.parametrize("text,want", [("null", None), ("true", True), ("3", 3), ("1.5", 1.5), ("'3'", "3"), ('"a"', "a"), ("abc", "abc"), ("1e2", 100), (" x ", "x")])
def test_literals(text, want):
    assert q.typed_literal(text) == want


def test_literal_out_of_range():
    with pytest.raises(ValueError):
        q.typed_literal("9007199254740993")


def test_canonical():
    assert q.canonical({"b": [1.0, None, "x"], "A": True}) == '{"A":true,"b":[1,null,"x"]}'


JSONS = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.text(alphabet="aA1", max_size=2)), lambda c: st.lists(c, max_size=2), max_leaves=3)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.just("absent"), JSONS), min_size=1, max_size=8), st.booleans())
def test_sorting_is_total_and_stable(spark, values, down):
    rows = [(i, f"p{i}", json.dumps({} if v == "absent" else {"v": v})) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "scan_ordinal int, path string, metadata string")
    got = [r.scan_ordinal for r in q.run(df, q.Query(sort=q.Sort("v", down, True))).collect()]
    rank = {type(None): 0, bool: 1, int: 2, str: 3, list: 4}

    def key(i):
        v = values[i]
        own = v if isinstance(v, (bool, int)) else v.lower() if isinstance(v, str) else q.canonical(v).lower()
        return rank[type(v)], own

    there = [i for i, v in enumerate(values) if v != "absent"]
    there.sort(key=key, reverse=down)
    keys = [key(i) for i in there]
    assert [key(i) for i in got[: len(there)]] == keys
    assert got[len(there) :] == sorted(i for i, v in enumerate(values) if v == "absent")
    for a, b in zip(got, got[1:]):
        if a in there and b in there and key(a) == key(b):
            assert a < b
