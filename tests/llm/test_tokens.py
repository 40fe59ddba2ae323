import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import tokens

PATH = os.path.join(tokens.VOCABULARIES, tokens.BYTE_BPE_50K)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


@pytest.fixture(scope="module")
def machine():
    return tokens.transducer(PATH)


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tokens.VOCABULARIES, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "a", "Hello  world's\n\n x", "<|endoftext|>", "añ́ß 日本語 👍🏽‍", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\x00\x1c\x85", "1234567890" * 50])
def test_as_the_public_library(machine, public, text):
    assert machine.encode(text) == public(text)
    assert "".join(machine.decode(machine.encode(text))) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(machine, public, text):
    ids = machine.encode(text)
    assert ids == public(text)
    assert "".join(machine.decode(ids)) == text


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=24))
def test_transducer_equals_merging(machine, data):
    assert machine.encode_bytes(data) == machine.merged(data)


def test_small_tables_do_not_change_results(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 3)
    monkeypatch.setattr(tokens, "KEPT_STATES", 5)
    small, full = tokens.Transducer(tokens.read_ranks(PATH)), tokens.transducer(PATH)
    text = "several different words, again several different words and übergroße Wörter"
    assert small.encode(text) == full.encode(text)


def test_decoder_holds_back_cut_characters(machine):
    ids = machine.encode("日本")
    assert len(ids) > 2
    assert [p for p in machine.decode(ids)] == ["日", "本"]


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "hi there", 0), (3, "hi there", 0)], "doc_id long, text string, ids int")
    rows = sorted((r.row_id, r.ids) for r in tokens.encoded(df, "doc_id", "text").collect())
    assert rows[:2] == [(1, []), (2, [])] and rows[2] == rows[3] and rows[2][1]
    assert tokens.encoded(df.limit(0), "doc_id", "text").count() == 0
