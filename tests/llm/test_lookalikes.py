import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vellum.llm import lookalikes as lk

SAME = [
    ("paper", "рареr"), ("café", "café"), ("ﬁrst oﬀer", "first offer"), ("ＡＢＣ １２", "ABC 12"), ("a​b﻿", "ab"), ("a b", "a b"), ("K", "K"),
    ("a‐b", "a-b"), ("ο", "o"), ("ё", "ë"),
    ("Օ", "O"), ("ᎪᏴ", "AB"), ("ꓮ", "A"), ("𝐀𝒃", "Ab"), ("Ⅳ", "IV"), ("ⅳ", "iv"), ("Ԁ", "D"), ("ℂ", "C"),
]
APART = [("l", "1"), ("O", "0"), ("I", "l"), ("a", "A"), ("a b", "ab"), ("a.", "a"), ("–", "-"), ("é", "e"), ("а б", "a 6")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert lk.skeleton(a) == lk.skeleton(b) and lk.skeleton(lk.skeleton(a)) == lk.skeleton(a)


@pytest.mark.parametrize("a,b", APART)
def test_apart(a, b):
    assert lk.skeleton(a) != lk.skeleton(b)


def test_printable_ascii_stays_apart():
    shown = [chr(c) for c in range(32, 127)]
    assert [lk.skeleton(c) for c in shown] == shown
    assert len(lk.TABLE) < 20_000 and not any(k < 127 for k in lk.TABLE)


@settings(max_examples=200)
@given(st.text(max_size=40))
def test_idempotent(text):
    assert lk.skeleton(lk.skeleton(text)) == lk.skeleton(text)


def rows(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, said string, skeleton string")
    return lk.skeletons(df, "id", "said", "t")


def brute(texts):
    known = [(i, t) for i, t in enumerate(texts) if t is not None]
    return {(a, b) for (a, x), (b, y) in itertools.combinations(known, 2) if x != y and lk.skeleton(x) == lk.skeleton(y)}


def test_pairs(spark):
    texts = ["café", "café", "cаfé", "café", None, "", "​", "", "other", "other", "ＣＡＦＥ", "CAFE"]
    assert {(r.row_id_a, r.row_id_b) for r in lk.pairs(lk.forms(rows(spark, texts))).collect()} == brute(texts)


def test_hot_form_is_not_compared_with_itself(spark):
    texts = ["same text"] * 3000 + ["ѕame text"]
    assert lk.pairs(lk.forms(rows(spark, texts))).count() == 3000


def test_rows_without_id(spark):
    df = spark.createDataFrame([(None, "a"), (1, "а"), (2, "a")], "id long, said string")
    assert [tuple(r) for r in lk.pairs(lk.forms(lk.skeletons(df, "id", "said", "t"))).collect()] == [("t", 1, 2)]


def test_empty(spark):
    assert lk.pairs(lk.forms(rows(spark, ["a"]).limit(0))).count() == 0


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aаeе́é​", max_size=4)), min_size=1, max_size=14))
def test_against_brute_force(spark, texts):
    assert {(r.row_id_a, r.row_id_b) for r in lk.pairs(lk.forms(rows(spark, texts))).collect()} == brute(texts)


def test_query(spark, data):
    for name, key in lk._SOURCES:
        source = {r[0]: r[1] for r in spark.read.parquet(f"{data}/{name}.parquet").select(key, "text").collect()}
        ids = list(source)
        want = {tuple(sorted((ids[a], ids[b]))) for a, b in brute(list(source.values()))}
        got = {(r.row_id_a, r.row_id_b) for r in lk.p3_found(spark, data).filter(f"tbl = '{name}'").collect()}
        assert got == want
    texts = lk.p3_texts(spark, data)
    assert texts.filter("text IS NULL").count() == 0
