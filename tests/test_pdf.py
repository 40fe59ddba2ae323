import pytest
from pyspark.sql import functions as F

from vellum.operators import pdf

SCHEMA = "fragment_id long, pdf_id string, page_no int, top_pt double, left_pt double, width_pt double, height_pt double, font_size double, bold boolean, text string"


def fragments(spark, rows):
    return spark.createDataFrame([(i, "d", *r) for i, r in enumerate(rows)], SCHEMA)


def line(page, top, text, size=10.0, bold=False, left=50.0):
    return (page, top, left, 5.0 * len(text), size * 1.1, size, bold, text)


PAGES = [
    *[line(p, 20.0, f"Running head {p}", 8.0) for p in (1, 2, 3)], line(1, 100.0, "Chapter One", 18.0), line(1, 130.0, "First line of text that is"), line(1, 144.0, "continued here."),
    line(1, 180.0, "A new paragraph."), line(1, 194.0, "- an item"), line(1, 208.0, "2) another item"), line(2, 100.0, "Sub part", 14.0), line(2, 120.0, "Words of the second page."),
    line(2, 160.0, "Bold head", 10.0, True), line(2, 174.0, "after it."), line(3, 100.0, "Third page only."), line(3, 114.0, "x" * 400),
]


def test_layout(spark):
    lines = pdf.visual_lines(fragments(spark, PAGES))
    assert pdf.body_sizes(lines).first().body_size == 10.0
    assert {(r.size, r.level) for r in pdf.heading_levels(lines, pdf.body_sizes(lines)).collect()} == {(18.0, 2), (14.0, 3)}
    assert [r.margin for r in pdf.repeated_margins(lines).collect()] == ["running head #"]
    blocks = [(r.page_no, r.kind, r.level, r.text[:30]) for r in pdf.layout_blocks(lines).orderBy("page_no", "block_no").collect()]
    assert blocks == [
        (1, "heading", 2, "Chapter One"), (1, "paragraph", None, "First line of text that is con"), (1, "paragraph", None, "A new paragraph."), (1, "list-item", None, "an item"),
        (1, "list-item", None, "another item"), (2, "heading", 3, "Sub part"), (2, "paragraph", None, "Words of the second page."), (2, "heading", 2, "Bold head"),
        (2, "paragraph", None, "after it."), (3, "paragraph", None, ("Third page only. " + "x" * 400)[:30]),
    ]
    text = pdf.markdown(pdf.layout_blocks(lines)).first().markdown
    assert text.startswith("<!-- pdf-page: 1 -->\n\n## Chapter One\n\nFirst line") and "- another item" in text and text.count("<!-- pdf-page") == 3


def test_rows_columns_and_spaces(spark):
    rows = [(1, 100.0, 50.0, 30.0, 11.0, 10.0, False, "left"), (1, 101.0, 85.0, 20.0, 11.0, 10.0, False, "side"), (1, 100.5, 105.0, 5.0, 11.0, 10.0, False, ","), (1, 100.0, 400.0, 40.0, 11.0, 10.0, True, "right"), (1, 120.0, 50.0, 9.0, 11.0, 10.0, False, None)]
    got = [(r.text, r.bold_ratio) for r in pdf.visual_lines(fragments(spark, rows)).orderBy("part_no").collect()]
    assert got == [("left side,", 0.0), ("right", 1.0)]
    assert pdf.layout_blocks(pdf.visual_lines(fragments(spark, rows).limit(0))).count() == 0


def test_upper_median(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0), (0, 9.0), (1, 5.0)], "g int, v double")
    assert {r.g: r.m for r in df.groupBy("g").agg(pdf.upper_median("v").alias("m")).collect()} == {0: 3.0, 1: 5.0}


def test_recognised_words(spark):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tconf\ttext"
    body = ["5\t1\t1\t1\t1\t2\t80\tworld", "5\t1\t1\t1\t1\t1\t90\thello", "5\t1\t1\t1\t2\t1\t60\tagain.", "5\t1\t1\t1\t2\t2\t-1\tx", "5\t1\t1\t1\t2\t3\t50\t ", "bad"]
    df = spark.createDataFrame([("i", "\n".join([head, *body])), ("e", head), ("n", None)], "image_id string, tsv string")
    words = pdf.ocr_words(df)
    assert sorted(r.text for r in words.collect()) == ["again.", "hello", "world"]
    assert sorted(r.text for r in pdf.ocr_lines(words).collect()) == ["again.", "hello world"]
    row = pdf.ocr_quality(words).first()
    assert row.words == 3 and row.letters == 15 and row.confidence == pytest.approx((90 * 5 + 80 * 5 + 60 * 6) / 16) and row.substantive


def test_half_points(spark):
    got = spark.createDataFrame([(9.74,), (9.75,), (10.24,), (10.25,)], "s double").select(pdf.half_points(F.col("s")).alias("h")).collect()
    assert [r.h for r in got] == [9.5, 10.0, 10.0, 10.5]


def test_documents_have_frontmatter(spark):
    facts = [("d", 'A "title"', "d.pdf", "s", None, 3, "2026-01-01", "complete", "Me", None, None), ("e", None, "My file.PDF", "t", "https://e.test/", 1, "2026-01-01", "partial", None, None, None)]
    names = "pdf_id string, title string, filename string, sha256 string, source_url string, pages int, clipped string, status string, author string, subject string, created string"
    bodies = spark.createDataFrame([("d", "Body.")], "pdf_id string, markdown string")
    got = {r.pdf_id: r.markdown for r in pdf.documents(spark.createDataFrame(facts, names), bodies).collect()}
    assert got["d"].startswith('---\ntitle: "A \\"title\\""\nsource: "source.pdf"\n') and 'author: "Me"\n---\n\n# A "title"\n\n[Open the source PDF](source.pdf)\n\nBody.\n' in got["d"]
    assert 'title: "My file"' in got["e"] and 'source_url: "https://e.test/"' in got["e"] and "author" not in got["e"] and got["e"].endswith("(source.pdf)\n")


def test_rows_by_least_top(spark):
    """Lines that fall slowly are rows of their own: the distance counts from the row's least top."""
    rows = [(1, 100.0 + 1.5 * k, 50.0, 30.0, 10.0, 10.0, False, f"t{k}") for k in range(6)]
    assert [r.row_no for r in pdf.with_rows(fragments(spark, rows)).orderBy("fragment_id").collect()] == [1, 1, 2, 2, 3, 3]


def test_images_of_unknown_type(spark):
    found = pdf.image_candidates(spark.createDataFrame([("d", 1, 0, b"no image"), ("d", 2, 0, None)], "pdf_id string, page_no int, place int, content binary"))
    assert [r.image_id for r in found.collect()] == [None, None] and found.filter("warning IS NOT NULL").count() == 2
    notes = spark.createDataFrame([], "image_id string, kind string, method string, markdown string, platform string")
    assert pdf.resolved_images(found, notes).count() == 0
