import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import boilerplate as bp

NAV = '<ul><li><a href="/1">Home</a></li><li><a href="/2">About us</a></li></ul>'


def page(i, marked=True):
    box, aside = ("main", "aside") if marked else ("div", "div")
    return "\n".join(
        [
            "<html>", "<head>", f"<title>Long story {i} of the orchard</title>", "<style>p { color: red }</style>", "</head>", "<body>", f"<{aside}>",
            "<ul>", '<li><a href="/1">Home</a></li>', '<li><a href="/2">About us</a></li>', "</ul>", "<p>We use cookies to improve this page.</p>", f"</{aside}>", f"<{box}>",
            f"<h1>Long story {i} of the orchard</h1>", f"<p>By Author Number{i}</p>",
            f"<p>The harvest of year {i} was better than anyone in the village had thought it would be.", "It went on for weeks.</p>",
            f"<p>Later the {i} neighbours met in the barn and talked about the prices of the season.</p>", f"</{box}>", f"<{aside}>", "<p>Share this page</p>",
            '<p><a href="/x">Read more stories</a></p>', f"</{aside}>", "</body>", "</html>",
        ]
    )


FURNITURE = {9, 10, 12, 22, 23}


def test_html_blocks():
    blocks, titles = bp.html_blocks(page(1))
    assert "Long story 1 of the orchard" in titles
    lines = {b[0]: b for b in blocks}
    assert set(lines) == FURNITURE | {15, 16, 17, 19}
    assert lines[17][1] == 2 and lines[17][2].endswith("weeks.")
    assert lines[9][4] == len("Home") and lines[9][5] == 0 and lines[15][5] == 1


def test_hidden_parts_keep_the_line_numbers():
    blocks, _ = bp.html_blocks("<html>\n<body>\n<!-- a\nb -->\n<script>\nx\n</script>\n<p>shown</p>\n</body>")
    assert [(b[0], b[2]) for b in blocks] == [(8, "shown")]


@pytest.mark.parametrize("body,want", [("<!--" + "x" * 3000 + "-->\n<html>\n<body>\n<p>a</p>", True), ("<div>\n<main>\n<p>a</p>\n</main>\n</div>", True), ("text " * 600 + "\n```\n<html>\n```\nand `<body>`", False), ("# T", False)])
def test_html_is_told_by_the_whole_body(body, want):
    assert bp.is_html(body) == want


def test_markdown_blocks():
    blocks, titles = bp.markdown_blocks("---\na: b\n---\n# T\n\n* [Home](/x)\n| a | b |\n> q\n**Related**\ntext [l](u) more\n---")
    assert [(b[0], b[3]) for b in blocks] == [(4, 2), (6, 1), (7, 3), (8, 5), (9, 2), (10, 0)] and titles == {"T"}
    assert blocks[1][4] == 4


def test_tree_and_its_expression(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, len(bp.FEATURES)))
    y = ((x[:, 0] > 0.5) & (x[:, 6] < 0.7)).astype(float)
    tree = bp.grown(x, y)

    def walk(t, row):
        while isinstance(t, tuple):
            t = t[2] if row[t[0]] <= t[1] else t[3]
        return t

    assert np.mean([(walk(tree, r) >= 0.5) == (v == 1) for r, v in zip(x, y, strict=True)]) > 0.97
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], list(bp.FEATURES))
    got = [r.s for r in df.select(bp.expression(tree).alias("s")).collect()]
    assert np.allclose(got, [walk(tree, r) for r in x[:50]])


def frame(spark, bodies):
    return spark.createDataFrame([(5, "t", i, b, None, "x") for i, b in enumerate(bodies)], "share int, tbl string, row_id long, body string, title string, line_no string")


def test_unmarked_pages_learn_from_marked_ones(spark):
    bodies = [page(i) for i in range(60)] + [page(77, marked=False), None, "", page(77, marked=False)]
    rows = {}
    for r in bp.furniture(frame(spark, bodies)).collect():
        rows.setdefault(r.row_id, set()).add(r.line_no)
    assert rows[60] == rows[63] == FURNITURE and 61 not in rows and 62 not in rows
    assert all(rows[i] == FURNITURE for i in range(60))


@pytest.mark.parametrize("score", [0.0, 1.0])
def test_the_tree_judges_every_block(spark, monkeypatch, score):
    """Also those that the corpus knows well from one side."""
    monkeypatch.setattr(bp, "grown", lambda x, y: score)
    rows = {(r.row_id, r.line_no) for r in bp.furniture(frame(spark, [page(i) for i in range(40)])).collect()}
    assert rows == ({(i, n) for i in range(40) for n in FURNITURE | {15, 16, 17, 18, 19}} if score else set())


def test_null_and_repeated_ids(spark):
    bodies = [page(i) for i in range(30)]
    df = frame(spark, bodies)
    twice = df.unionByName(df).unionByName(df.limit(5).withColumn("row_id", F.lit(None).cast("long")))
    rows = bp.furniture(twice).collect()
    assert sorted(r.line_no for r in rows if r.row_id == 3) == sorted([*FURNITURE, *FURNITURE])
    assert sorted(r.line_no for r in rows if r.row_id is None) == sorted([*FURNITURE] * 5)


def test_without_marked_pages_a_rule_stands_in(spark):
    rows = bp.furniture(frame(spark, [page(1, marked=False)])).collect()
    assert {9, 10} <= {r.line_no for r in rows} and not {17, 18, 19} & {r.line_no for r in rows}


def test_empty(spark):
    assert bp.furniture(frame(spark, ["x"]).limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "a", "One two Three four five.", "9 pages 12"])
def test_key_ignores_numbers(text):
    assert bp.block_key(text, False) == bp.block_key(text.replace("9", "7").replace("12", "5"), False)


def test_long_page(spark):
    body = page(1).replace("<p>Share this page</p>", "<p>Share this page</p>" + "\n<p>word</p>" * 20_000)
    assert bp.furniture(frame(spark, [body])).count() > 0


def test_held_out_pages(spark, data):
    """On marked pages that the tree has not seen it agrees with their own marks."""
    folder = data.replace("sf0.001", "sf0.01")
    found = {}
    for r in bp.p5_found(spark, folder).filter("tbl = 'acquisitions'").collect():
        found.setdefault(r.row_id, set()).add(r.line_no)
    right = wrong = 0
    for r in spark.read.parquet(f"{folder}/acquisitions.parquet").filter("body IS NOT NULL").select("page_id", "body").collect():
        for no, _, _, _, _, inside in bp.html_blocks(r.body)[0] if bp._MAIN.search(r.body) else []:
            if not inside:
                right += no in found.get(r.page_id, ())
                wrong += no not in found.get(r.page_id, ())
    assert right / (right + wrong) > 0.97
