import pytest

from vellum.llm import scans as sc

SOUND = {w: 100 for w in "the quick brown fox jumps over lazy dog in of catalog page a well-known well known half half-finished finished essay report index card running".split()}


@pytest.fixture
def known():
    return sc.Vocabulary(SOUND)


@pytest.mark.parametrize(
    "line,after,want",
    [
        ("the qu-", "ick fox", ("qu", "ick")), ("the cata¬", "log of", ("cata", "log")), ("the cata=", "log", ("cata", "log")), ("the well-", "known fox", None),
        ("the half-", "finished essay", None), ("of 1990-", "1994", None), ("the cata- |", "log", ("cata", "log")), ("the quick", "fox", None), ("the cata-", None, None),
        ("[K-", "00apug]", None), ("the cata-", "Log", ("cata", "Log")), ("the cata-", "the dog", ("cata", "")), ("the cata-", "l0g", ("cata", "l0g")), ("the wcll-", "known", None), ("run-", "ningfox", ("run", "ningfox")),
    ],
)
def test_cut_words(known, line, after, want):
    assert sc.cut_word(line, after, known) == want


@pytest.mark.parametrize("line", ["tbe quick fox", "the quick | fox", "thequick fox", "the qui ck fox", "the catal0g", "the 1azy dog", "the fox^", "tbe"])
def test_misread(known, line):
    assert sc.misread(line, known, None, None, False)


@pytest.mark.parametrize("line", ["the quick brown fox", "the well-known fox", "The QUICK fox.", "[K-00apud] the fox", "10:45 of 2024", "a Ulaford dog", ""])
def test_not_misread(known, line):
    assert not sc.misread(line, known, None, None, False)


def test_halves_are_no_misreading(known):
    assert not sc.misread("the cata", known, None, "cata", False)


@pytest.mark.parametrize(
    "text,title",
    [("3", False), ("- 3 -", False), ("[12]", False), ("Page 2 of 9", False), ("p. 4", False), ("iv", False), ("Amber Index", True), ("9 | North Loom", True), ("A title   4", True), ("Pngc 9 | of 9", False), ("[9] |", False)],
)
def test_titles(text, title):
    assert sc.has_title(text) == title


@pytest.mark.parametrize("text,want", [("3", [3]), ("- l2 -", [12]), ("Page 2 of 9", [2, 9]), ("iv", [4]), ("xxviii", [28]), ("9 | North Loom", [9]), ("l", [1]), ("In 1999 the harbor", [1999]), ("mill", []), ("", []), ("|", [1])])
def test_page_numbers(text, want):
    assert sc.page_numbers(text) == want


@pytest.mark.parametrize("a,b", [("Marble Finch", "Marblc Fincli"), ("9 | North Loom", "12 | North Looni"), ("STONE ALMANAC", "STONE ALMANAC ~"), ("Stone Almanac", "Storie Almariac"), ("A LIST", "A LlST")])
def test_edge_keys(a, b):
    from difflib import SequenceMatcher

    assert SequenceMatcher(None, sc.edge_key(a), sc.edge_key(b)).ratio() > 0.8


FRAGMENTS = "fragment_id long, pdf_id string, page_no int, ordinal int, font_size double, text string, tbl string, defect string"
BLOCKS = "block_id long, pdf_id string, page_no int, ordinal int, text string"
BODY = ["the quick brown fox jumps over the lazy dog in the catalog", "a report of the index card and the running fox in the catalog"]


def corpus(noisy=()):
    rows, blocks, n = [], [], 0
    for d in range(8):
        for p in (1, 2):
            lines = [("Amber Index", 8.0), *[(t, 10.0) for t in BODY * 3], (f"- {p} -", 8.0)]
            for o, (t, size) in enumerate(lines):
                rows.append((n, f"d{d}", p, o, size, t, "x", "y"))
                n += 1
            blocks.append((1000 * d + p, f"d{d}", p, 0, "\n".join(t for t, _ in lines)))
    for i, (pdf, page, ordinal, size, text) in enumerate(noisy):
        rows.append((9000 + i, pdf, page, ordinal, size, text, "x", "y"))
    return rows, blocks


def run(spark, rows, blocks, repair=False):
    return sc.findings(spark.createDataFrame(rows, FRAGMENTS), spark.createDataFrame(blocks, BLOCKS), repair)


def test_furniture_and_blocks(spark):
    rows, blocks = corpus()
    found = {}
    for r in run(spark, rows, blocks).collect():
        found.setdefault((r.tbl, r.row_id), set()).add(r.defect)
    want = {("pdf_fragments", r[0]): {"header"} if r[5] == "Amber Index" else {"page_number"} for r in rows if r[4] < 10}
    want |= {("pdf_blocks", b[0]): {"header", "page_number"} for b in blocks}
    assert found == want


def test_noise_across_pages(spark):
    noisy = [
        ("n", 1, 0, 8.0, "Amber Index"), ("n", 1, 1, 10.0, "tbe quick brown fox jumps over the lazy dog"), ("n", 1, 2, 10.0, "a report of the index card and the cata-"),
        ("n", 1, 3, 8.0, "1"), ("n", 2, 0, 8.0, "Amber Index"), ("n", 2, 1, 10.0, "log in the running fox"), ("n", 2, 2, 8.0, "2"), ("n", 2, 3, 10.0, None),
        ("n", 2, 4, 10.0, ""), (None, 1, 1, 10.0, "the fox"), ("n", None, 1, 10.0, "tbe fox"),
    ]
    rows, blocks = corpus(noisy)
    blocks.append((77, "n", 1, 0, "Amber Index\ntbe quick brown fox jumps over the lazy dog\na report of the index card and the cata-\n1"))
    blocks.append((78, "n", 2, 0, None))
    got = {}
    for r in run(spark, rows, blocks).filter("row_id >= 9000 OR row_id IN (77, 78)").collect():
        got.setdefault(r.row_id, set()).add(r.defect)
    assert got == {
        9000: {"header"}, 9001: {"misread"}, 9002: {"hyphen"}, 9003: {"page_number"}, 9004: {"header"}, 9006: {"page_number"}, 9010: {"misread"},
        77: {"header", "misread", "hyphen", "page_number"},
    }
    texts = {r.row_id: r.text for r in run(spark, rows, blocks, True).collect()}
    assert texts[77] == "the quick brown fox jumps over the lazy dog a report of the index card and the cata-"


def test_block_lines_without_fragment(spark):
    """What stands in a block only is read too, in lines and in running text, and tells how a line before it goes on."""
    head, foot = ("e", 1, 0, 8.0, None), ("e", 1, 7, 8.0, None)
    noisy = [
        head, ("e", 1, 1, 10.0, BODY[0]), ("e", 1, 2, 10.0, None), ("e", 1, 3, 10.0, "a report of the cata-"), ("e", 1, 4, 10.0, None), ("e", 1, 5, 10.0, None),
        ("e", 1, 6, 10.0, BODY[1]), foot, ("g", 1, 0, 10.0, BODY[0]), ("g", 1, 1, 10.0, None), ("g", 1, 2, 10.0, None), ("g", 1, 3, 10.0, BODY[1]),
    ]
    rows, blocks = corpus(noisy)
    texts = ["Amber Index", f"{BODY[0]}\ntbe running fox", "a report of the cata-\nlog in the card", f"the lazy cata- log {BODY[1]}", "- 1 -"]
    blocks += [(70 + i, "e", 1, i, t) for i, t in enumerate(texts)]
    blocks += [(80, "g", 1, 0, f"{BODY[0]} the index in the cata- log of the fox {BODY[1]}"), (90, "b", 1, 0, f"{BODY[0]}\ntbe fox"), (91, "b", 2, 0, f"{BODY[1]}\nthe cata-"), (92, "b", 3, 0, "log of the fox")]
    got = {}
    for r in run(spark, rows, blocks).filter("row_id >= 9000 OR tbl = 'pdf_blocks' AND row_id BETWEEN 70 AND 92").collect():
        got.setdefault(r.row_id, set()).add(r.defect)
    assert got == {9003: {"hyphen"}, 70: {"header"}, 71: {"misread"}, 72: {"hyphen"}, 73: {"hyphen"}, 74: {"page_number"}, 80: {"hyphen"}, 90: {"misread"}, 91: {"hyphen"}}


def test_paragraphs_over_page_ends(spark):
    """A paragraph stands whole at its first block, also over pages and runs of pages; pages without blocks come from fragments."""
    pages = {1: "the quick brown fox and the cata-", 2: "log in the running", 3: "fox jumps.", 63: "a report of the", 64: "index card and the cata-", 65: "log of the lazy dog.", 66: "the fox."}
    rows, blocks = corpus([("q", p, 0, 10.0, t) for p, t in pages.items()])
    rows += [(9500, "w", 1, 0, 10.0, "the quick cata-", "x", "y"), (9501, "w", 1, 1, 10.0, "log in tbe fox", "x", "y"), (9502, "w", 2, 0, 10.0, "jumps over the dog.", "x", "y")]
    blocks += [(500 + p, "q", p, 0, t) for p, t in pages.items()]
    got = {(r.tbl, r.row_id): r.text for r in sc.paragraphs(spark.createDataFrame(rows, FRAGMENTS), spark.createDataFrame(blocks, BLOCKS)).filter("pdf_id IN ('q', 'w')").collect()}
    want = {501: "the quick brown fox and the catalog in the running fox jumps.", 563: "a report of the index card and the catalog of the lazy dog.", 566: "the fox.", 502: "", 503: "", 564: "", 565: ""}
    assert got == {**{("pdf_blocks", i): t for i, t in want.items()}, ("pdf_fragments", 9500): "the quick catalog in the fox jumps over the dog."}


@pytest.mark.parametrize("text,want", [("the well- known fox", "the well-known fox"), ("in [K- 00apug] the", "in [K-00apug] the"), ("the half- and", "the half- and"), ("the cata- the dog", "the cata- the dog"), ("the cata- l0g", "the catalog")])
def test_repaired_breaks(known, text, want):
    assert sc.repaired(text, set(), known) == want


@pytest.mark.parametrize("pdfs", ["zzzzzz", "uvwxyz"])
def test_rare_words_and_words_of_one_document(spark, pdfs):
    """A word that clean pages attest is sound in a corpus of any size, and where one document alone has it."""
    rows, blocks = corpus([(d, p, 1, 10.0, "the zither fox") for p, d in enumerate(pdfs, 1)] + [("z", 9, 1, 10.0, "the zi-"), ("z", 9, 2, 10.0, "ther fox"), ("z", 9, 3, 10.0, "the zitber fox")])
    got = {(r.row_id, r.defect) for r in run(spark, rows, blocks).filter("row_id >= 9000 AND defect IN ('hyphen', 'misread')").collect()}
    assert got == {(9006, "hyphen"), (9008, "misread")}


def test_what_stands_once_is_no_furniture(spark):
    """A small line that stands once is no header, a year no page number, though both stand at the edge; nor is a line of text that ends some pages and stands inside others."""
    extra = [("s", 1, 0, 8.0, "the report of the lazy index"), ("s", 1, 1, 10.0, BODY[0]), ("s", 1, 2, 8.0, "1999"), ("s", 2, 0, 10.0, "In 1999 the fox"), ("s", 2, 1, 10.0, BODY[1]), ("s", 2, 2, 10.0, "the catalog.")]
    extra += [("t", p, o, 10.0, t) for p in (1, 2, 3) for o, t in enumerate([BODY[0], "the catalog.", "the catalog.", BODY[1], "the catalog."])]
    rows, blocks = corpus(extra)
    assert run(spark, rows, blocks).filter("row_id >= 9000").count() == 0


def test_furniture_returns_misread(spark):
    """Titles return in other letters, numbers as a sequence with letters for digits, two lines deep."""
    pages = [("Amber Iridex", "Quick Report", "11"), ("Amber Index", "Quick Report", "l2"), ("Ambcr Index", "Quick Rcport", "13")]
    extra = [("m", p, o, 10.0, t) for p, (a, b, c) in enumerate(pages, 1) for o, t in enumerate([a, b, *BODY, c])]
    got = {}
    for r in run(spark, *corpus(extra)).filter("row_id >= 9000").collect():
        got.setdefault((r.row_id - 9000) % 5, []).append(r.defect)
    assert [sorted(got[i]).count("header") for i in (0, 1)] == [3, 3] and got[4].count("page_number") == 3 and "header" not in got[4] and {2, 3}.isdisjoint(got)


@pytest.mark.parametrize("word", ["catlog", "catalogg", "xatalog", "catalig", "rrunning", "fnished", "inex", "quick", "catxlxg"])
def test_edits_both_ways(word):
    """Halves and trying all letters find the same."""
    few, many = sc.Vocabulary(SOUND), sc.Vocabulary({**SOUND, **{word[: len(word) // 2] + f"{i:04}q": 1 for i in range(600)}})
    extra = set(many.sound) - set(few.sound)
    assert sorted(set(few._edited(word)) - {word}) == sorted(set(many._edited(word)) - extra - {word})


def test_confusions_are_learnt(spark):
    sound = [w for w in "grape angle bridge signal garden magnet dragon finger".split()]
    rows = [(w, 50, True, True) for w in sound] + [(w.replace("g", "q", 1), 1, False, False) for w in sound] + [("xyzzy", 1, False, False)]
    assert sc.learnt_confusions(spark.createDataFrame(rows, "word string, n long, sound boolean, fair boolean")) == [("q", "g")]
    assert sc.learnt_confusions(spark.createDataFrame(rows, "word string, n long, sound boolean, fair boolean").limit(0)) == []


def test_repeated_rows_and_headings(spark):
    rows, blocks = corpus([("h", 1, 0, 16.0, "The quick catalog"), ("h", 1, 0, 16.0, "The quick catalog"), ("h", 1, 1, 10.0, BODY[0]), ("h", 1, 2, 10.0, "tbe fox"), ("h", 1, 2, 10.0, "tbe fox")])
    got = sorted((r.row_id, r.defect) for r in run(spark, rows, blocks).filter("row_id >= 9000").collect())
    assert got == [(9003, "misread"), (9004, "misread")]


def test_empty(spark):
    rows, blocks = corpus()
    assert sc.findings(spark.createDataFrame(rows, FRAGMENTS).limit(0), spark.createDataFrame(blocks, BLOCKS).limit(0)).count() == 0


def test_query(spark, data):
    rows = sc.p2_found(spark, data).collect()
    assert {r.defect for r in rows} <= {"hyphen", "misread", "header", "page_number"} and len(set(rows)) == len(rows)
    assert sc.p2_texts(spark, data).count() == spark.read.parquet(f"{data}/pdf_blocks.parquet").filter("text IS NOT NULL AND text != ''").count()
