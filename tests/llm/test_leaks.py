import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vellum.llm import leaks

ITEM = "The quick brown fox jumps over the lazy dog and then runs far away home"


def found(spark, docs, items, n=12):
    d = spark.createDataFrame(list(enumerate(docs)), "id long, body string")
    i = spark.createDataFrame(list(enumerate(items)), "key long, said string")
    return leaks.leak_spans(d, "id", "body", i, "key", "said", n)


def brute(docs, items, n):
    def words(t):
        return re.findall(r"[^\W_]+", unicodedata.normalize("NFC", t or "").casefold())

    out = set()
    for a, d in enumerate(docs):
        own = {tuple(words(d)[k : k + n]) for k in range(len(words(d)) - n + 1)}
        for b, i in enumerate(items):
            if any(tuple(words(i)[k : k + n]) in own for k in range(len(words(i)) - n + 1)):
                out.add((a, b))
    return out


def test_typography_does_not_hide_a_passage(spark):
    docs = [
        ITEM, ITEM.upper(), " | ".join(ITEM.split()), ITEM.replace(" ", "__"), "x " + "…".join(ITEM.split()[2:14]) + " y", " ".join(ITEM.split()[:11]), None, "",
        "nothing of it " * 50, ITEM.replace("fox", "box"),
    ]
    rows = found(spark, docs, [ITEM]).collect()
    assert {r.doc_id for r in rows} == {0, 1, 2, 3, 4}
    for r in rows:
        assert leaks.words_of(docs[r.doc_id]).findall(docs[r.doc_id][r.start_pos : r.end_pos])[0].casefold() in ("the", "brown")


def test_decomposed_accents(spark):
    item = "été là où les élèves étudient près du café à côté de la forêt"
    assert found(spark, [unicodedata.normalize("NFD", item)], [item]).count() == 1


def test_spans_join_and_are_cut_out(spark):
    doc = f"before {ITEM} after"
    rows = found(spark, [doc], [ITEM, ITEM]).collect()
    assert [(r.first_word, r.n_words) for r in rows] == [(1, 15), (1, 15)]
    df = spark.createDataFrame([(1, doc, [(rows[0].start_pos, rows[0].end_pos), (rows[1].start_pos, rows[1].end_pos)])], "doc_id long, text string, spans array<struct<start_pos:int,end_pos:int>>")
    assert leaks.without_spans(df).first().text == "before  after"


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = [f"a {ITEM} b", "c d"], [ITEM, "no such words " * 6, ITEM + " tail"]
    whole = {(r.doc_id, r.item_id) for r in found(spark, docs, items).collect()}
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 60)
    assert {(r.doc_id, r.item_id) for r in found(spark, docs, items).collect()} == whole


def test_empty_tables(spark):
    assert found(spark, ["x"], [None]).count() == 0
    d = spark.createDataFrame([], "id long, body string")
    i = spark.createDataFrame([(1, ITEM)], "key long, said string")
    assert leaks.leak_spans(d, "id", "body", i, "key", "said").count() == 0
    assert leaks.leak_spans(i, "key", "said", d, "id", "body").count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(docs=st.lists(st.text(alphabet="abA .-é", max_size=60), max_size=5), items=st.lists(st.text(alphabet="abA .é", max_size=30), min_size=1, max_size=4))
def test_against_brute_force(spark, docs, items):
    if not docs:
        return
    assert {(r.doc_id, r.item_id) for r in found(spark, docs, items, 3).collect()} == brute(docs, items, 3)


def test_query(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{data}/eval_items.parquet").select("item_id", "text").collect()}
    want = {(list(docs)[a], list(items)[b]) for a, b in brute(docs.values(), items.values(), 12)}
    assert {tuple(r) for r in leaks.p8_found(spark, data).collect()} == want
