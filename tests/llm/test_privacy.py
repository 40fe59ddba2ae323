import pytest

from vellum.llm import privacy as pv

FORMS = [
    ("Write to a.b+c@mail.example.org now", "email", "a.b+c@mail.example.org"),
    ("mailto:x_y (at) mail.test", "email", "x_y (at) mail.test"),
    ("x[at]mail[dot]example ok", "email", "x[at]mail[dot]example"),
    ("me at mail dot test", "email", "me at mail dot test"),
    ("a＠b.test", "email", "a＠b.test"),
    ("Call +34 600 007 225, please", "phone", "+34 600 007 225"),
    ("(555) 014-3632.", "phone", "(555) 014-3632"),
    ("030/55501048", "phone", "030/55501048"),
    ("0049-30-55501702", "phone", "0049-30-55501702"),
    ("+1.555.017.3736 x", "phone", "+1.555.017.3736"),
    ("SSN: 979-22-0012", "id_number", "979-22-0012"),
    ("id QQ 90 30 51 C ok", "id_number", "QQ 90 30 51 C"),
    ("809.565.160-83 lost", "id_number", "809.565.160-83"),
    ("at Flat 3, 10 Copper Mill Road, Ulaford", "street_address", "Flat 3, 10 Copper Mill Road, Ulaford"),
    ("to 226b Almond Close\nUlastad.", "street_address", "226b Almond Close\nUlastad"),
    ("Brindleweg 60, 01132 Ostileigh", "street_address", "Brindleweg 60, 01132 Ostileigh"),
    ("5 rue des Kestrel Hill, 99452 Ravoleigh", "street_address", "5 rue des Kestrel Hill, 99452 Ravoleigh"),
    ("Calle Heron 121, Casewick", "street_address", "Calle Heron 121, Casewick"),
]
NOTHING = [
    "Order 442-118-20 is open", "ISBN 978-0-00-0885-2", "Version 1.555.0110", "took 00:44:17 on 192.0.2.14", "vault-tools@2.51.0", "git@forge:notes/repo75.git",
    "cc @quietotter25", "19 Stone Street stories were imported", "section 4 Road map", "Room 33, Old Quay building, floor 2", "commit 9f43a81c", "",
]


@pytest.mark.parametrize("text,kind,value", FORMS)
def test_forms(text, kind, value):
    assert [(k, text[a:b]) for a, b, k in pv.formed(text)] == [(kind, value)]


@pytest.mark.parametrize("text", NOTHING)
def test_technical_values(text):
    assert pv.formed(text) == []


ROWS = [
    (1, "Thanks to Anar Keluner for the scan.", "x", "Anar Keluner"),
    (2, "I heard it from Keluner, Anar and M. Dromont too.", "anar_keluner9", "Anar Keluner"),
    (3, "ask Vein B. Dromont-Keluner", "the_real_veindromont", "Vein Dromont"),
    (4, "ANAR KELUNER said so; vein dromont as well", None, "Vein Dromont"),
    (5, "The North Loom project and the north field and a loom pattern. North wind, loom work.", "north-loom", "North Loom"),
    (6, "ask Anar M. please, or only Keluner", "dromont_otter", "Vein Dromont"),
    (7, None, "+15550158637", None),
    (8, "", "me@mail.test", "Vein Dromont"),
    (9, "north field, north wind, north side, a loom pattern, a loom beam, the loom cloth", "tel_07700900085", ""),
    (9, "mail anar.keluner@mail.test", "user15550106", "Anar"),
    (10, "the water stood low and the mill was still while we read the old book again " * 200, None, None),
]


def found(spark, rows):
    schema = "id long, said string, nick string, who string, text string, kind string"
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], schema)
    out = pv.personal_values(df, "id", "said", "nick", "who").collect()
    text = {}
    for i, said, nick, _ in rows:
        text.setdefault((i, "text"), []).append(said)
        text.setdefault((i, "handle"), []).append(nick)
    return sorted((r.row_id, r.field_name, r.kind, r.start_pos) for r in out), out


def test_names_and_handles(spark):
    places, _ = found(spark, ROWS)
    assert places == [
        (1, "text", "name", 10), (2, "handle", "name", 0), (2, "text", "name", 16), (2, "text", "name", 34), (3, "handle", "name", 9), (3, "text", "name", 4),
        (4, "text", "name", 0), (4, "text", "name", 22), (7, "handle", "phone", 0), (8, "handle", "email", 0), (9, "handle", "phone", 4), (9, "text", "email", 5),
    ]


def test_names_of_people_who_wrote_nothing(spark):
    """A stranger is found by the author terms beside their other name; titles and sentence starts are no names."""
    filler = "the water stood low and the mill was still while we read the old book again " * 40
    authors = [(i, f"Thanks to {g} {f} for this. {filler}", None, f"{g} {f}") for i, (g, f) in enumerate([("Anar", "Keluner"), ("Vein", "Dromont"), ("Mera", "Fenusk"), ("Oran", "Tarusk")] * 5)]
    strangers = [(100 + i, f"{filler}, says {g} {f} today.", None, None) for i, (g, f) in enumerate([("Anar", "Quibbel"), ("Mera", "Zanther"), ("Iljo", "Fenusk"), ("Sabe", "Tarusk"), ("J.", "Orwenn")] * 4)]
    others = [(200 + i, t, None, None) for i, t in enumerate(["Frau Keluner came. Frau Anar Keluner too. Frau Dromont left.", "We met Oran The end was near. The end. The mill.", "Anar Monday came. On Monday we read. A Monday."] * 3)]
    places, _ = found(spark, authors + strangers + others)
    start = {i: t.find("says ") + 5 for i, t, *_ in strangers}
    got = {(i, at) for i, field, kind, at in places}
    hits = sum((i, at) in got for i, at in start.items())
    assert hits >= 0.95 * len(start)
    assert sum(200 <= i for i, _ in got) == 3 and all((i, at) in {(200, 24), (203, 24), (206, 24)} for i, at in got if i >= 200)


def test_threshold_with_a_million_terms(spark):
    """The map of terms may be full: what it lets pass is verified, so ordinary words stay ordinary."""
    from pyspark.sql import functions as F

    n = 1_000_000
    names = spark.range(n).select(F.concat(F.lit("G"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit(" F"), F.translate(F.col("id").cast("string"), "0123456789", "klmnopqrst")).alias("author"))
    rows = names.select(F.xxhash64("author").alias("row_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("handle"), "author")
    texts = [(i, f"{'the red wall and a mill by the blue water and a field ' * 30} Red Mill, Blue Field by {g} {f} again", "Red Mill" if i % 2 else "Blue Field") for i, (g, f) in enumerate([("Gba", "Flk"), ("Gcd", "Fmn"), ("Gef", "Fop")] * 4)]
    rows = rows.unionByName(spark.createDataFrame([(i, t, None, a) for i, t, a in texts], rows.schema))
    terms = pv.disclosing(rows).filter("term IN ('gba', 'gcd', 'gef', 'flk', 'fmn', 'fop', 'red', 'blue', 'mill', 'field')")
    assert {r.term for r in terms.collect()} == {"gba", "gcd", "gef", "flk", "fmn", "fop"}


def test_what_everyone_posts_is_nobodys(spark):
    authors = [f"Ana{chr(97 + i)} Bor{chr(97 + i)}" for i in range(20)]
    rows = [(i, "call (555) 014-3632", None, a) for i, a in enumerate(authors)] + [(50, "call (555) 014-9999", None, authors[0]), (51, "call (555) 014-7777", None, authors[1])]
    assert [x for x in found(spark, rows)[0] if x[2] == "phone"] == [(50, "text", "phone", 5), (51, "text", "phone", 5)]


def test_overlapping_candidates(spark):
    """Of one begin the longer holds, and a double name needs both parts."""
    filler = "the water stood low and the mill was still while we read the old book again " * 60
    rows = [(1, f"Anar Keluner-Dromont and Vein Dromont. {filler}", None, "Anar Keluner"), (2, f"A. Keluner-Mill, Vein Dromont. {filler}", None, "Vein Dromont")]
    out = found(spark, rows)[1]
    assert sorted((r.row_id, r.start_pos, r.end_pos) for r in out) == [(1, 0, 20), (1, 25, 37), (2, 0, 10), (2, 17, 29)]


def test_ordinary_words_reveal_nobody(spark):
    schema = "row_id long, text string, handle string, author string"
    df = spark.createDataFrame(ROWS, schema)
    terms = {(r.role, r.term) for r in pv.disclosing(df).collect()}
    assert ("given", "anar") in terms and ("family", "dromont") in terms
    assert ("given", "north") not in terms and ("family", "loom") not in terms


def test_placeholders(spark):
    df = spark.createDataFrame([("call +34 600 007 225 or a@b.test!", [(5, 20, "phone"), (24, 32, "email")]), ("none", None)], "t string, s array<struct<start_pos:int,end_pos:int,kind:string>>")
    from pyspark.sql import functions as F

    got = [r.x for r in df.select(pv.replaced(F.col("t"), F.col("s")).alias("x")).collect()]
    assert got == ["call [PHONE] or [EMAIL]!", "none"]


def test_empty_and_long(spark):
    assert found(spark, [])[0] == []
    long = "word " * 100_000 + "a@b.test"
    assert found(spark, [(1, long, None, None)])[0] == [(1, "text", "email", 500_000)]


def test_query(spark, data):
    rows = pv.p4_found(spark, data).collect()
    assert {r.kind for r in rows} <= {"email", "phone", "id_number", "street_address", "name"} and rows
    texts = {r.entry_row_id: r for r in pv.p4_texts(spark, data).collect()}
    entries = {r.entry_row_id: r for r in spark.read.parquet(f"{data}/captured_entries.parquet").collect()}
    assert texts.keys() == entries.keys()
    touched = {(r.entry_row_id, r.field_name) for r in rows}
    for key, row in entries.items():
        for field in ("text", "handle"):
            assert (texts[key][field] == row[field]) == ((key, field) not in touched)
