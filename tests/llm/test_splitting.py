import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vellum.llm import splitting as sp

CHARS = sp.Profile(1, "chars", 20, 5)
BYTES = sp.Profile(2, "bytes", 24, 6)
WORDS = sp.Profile(3, "words", 4, 1)
MEASURE = {"chars": len, "bytes": lambda t: len(t.encode()), "words": lambda t: len(t.split())}


def pieces(spark, texts, profiles=(CHARS, BYTES, WORDS)):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    out = {}
    for r in sp.pieces(df, "id", "body", list(profiles)).collect():
        out.setdefault((r.row_id, r.profile_id), []).append(r)
    return {k: sorted(v, key=lambda r: r.piece_no) for k, v in out.items()}


def check(text, profile, rows):
    units = {"chars": lambda t: t, "bytes": str.encode, "words": str.split}[profile.size_unit]
    whole, at = units(text), 0
    for i, r in enumerate(rows):
        assert MEASURE[profile.size_unit](r.piece) <= profile.max_size
        own = units(r.piece)
        assert whole[r.start_pos : r.start_pos + r.n_units] == own
        shared = at - r.start_pos
        assert shared == 0 if i == 0 else profile.overlap_size - 3 * (profile.size_unit == "bytes") <= shared <= profile.overlap_size or r.start_pos == 0
        at = r.start_pos + r.n_units
    assert at == len(whole)


TEXTS = [
    "# Title\n\nFirst words here. And more of them\n\n## Second\nlast line of the text",
    "x" * 95,
    "añejo ñandú " * 9 + "日本語のとても長い文章ですからね",
    "one two three four five six seven eight nine ten",
    "```\ncode\ncode\n```\ntext after the code block goes on and on\n```\nopen",
    "a\r\nb\r\n" * 20,
    "👍🏽" * 30,
]


def test_pieces_cover_the_text_with_overlap(spark):
    found = pieces(spark, TEXTS)
    for i, text in enumerate(TEXTS):
        for p in (CHARS, BYTES, WORDS):
            if MEASURE[p.size_unit](text) > p.max_size:
                check(text, p, found[i, p.profile_id])
            else:
                assert (i, p.profile_id) not in found


def test_natural_boundaries_come_first(spark):
    text = "Some words of a line\n\nAnother paragraph which is longer than the first one by far"
    rows = pieces(spark, [text], [sp.Profile(1, "chars", 40, 0)])[0, 1]
    assert rows[0].piece == "Some words of a line\n\n"
    assert all(not r.piece[-1].isalnum() for r in rows[:-1])


def test_null_empty_exact_and_repeated(spark):
    df = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "y" * 20, "q"), (4, "z" * 21, "q"), (4, "z" * 21, "q")], "id long, body string, text string")
    rows = sp.cuts(df, "id", "body", [CHARS]).select("row_id").collect()
    assert [r.row_id for r in rows] == [4, 4]
    empty = df.limit(0)
    assert sp.pieces(empty, "id", "body", [CHARS]).count() == 0
    assert sp.cuts(df, "id", "body", []).count() == 0


def test_very_long_text(spark):
    text = "word " * 200_000
    rows = pieces(spark, [text], [sp.Profile(1, "chars", 2400, 240), sp.Profile(3, "words", 900, 60)])
    check(text, sp.Profile(1, "chars", 2400, 240), rows[0, 1])
    check(text, sp.Profile(3, "words", 900, 60), rows[0, 3])


def test_bad_profiles():
    for args in ((1, "lines", 5, 0), (1, "chars", 5, 5), (1, "bytes", 6, 3), (1, "chars", 5, -1)):
        with pytest.raises(ValueError):
            sp.Profile(*args)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.text(alphabet="ab .\n#`é日\t", min_size=0, max_size=120), min_size=1, max_size=6))
def test_any_text(spark, texts):
    found = pieces(spark, texts, [CHARS, WORDS])
    for i, text in enumerate(texts):
        for p in (CHARS, WORDS):
            assert ((i, p.profile_id) in found) == (MEASURE[p.size_unit](text) > p.max_size)
            if (i, p.profile_id) in found:
                check(text, p, found[i, p.profile_id])


def test_query_against_counting(spark, data):
    known = sp._known(spark, data)
    want = {
        (r.note_row_id, p.profile_id)
        for r in spark.read.parquet(f"{data}/notes.parquet").filter("content IS NOT NULL").select("note_row_id", "content").collect()
        for p in known
        if MEASURE[p.size_unit](r.content) > p.max_size
    }
    assert {tuple(r) for r in sp.p1_found(spark, data).collect()} == want
