"""Page boilerplate: flat text blocks told from the article by a decision tree.

A page is read as flat blocks (a line, or the lines of one paragraph). A block has its
word count, link density and kind, those of its neighbours and of its list, and the share
of equal blocks of the corpus that stand outside a page's main element, counted over all
pages that mark one. The tree is fitted on a table of at most ``TRAIN_PAGES`` such pages,
drawn by a hash, whose blocks are labelled by the element they stand in; blocks inside the
main element that the corpus mostly knows from outside are left out of it. The fitted tree
becomes one expression, so pages are classified in the JVM; every block goes by the tree.
Pages of every kind (HTML, Markdown, plain text) go through the same tree; the table holds
its pages also without their links and without links and tags, as Markdown and plain text
show them.

Defined results: null, empty and textless bodies give no rows; repeated rows each give
theirs; where no page marks a main element, a fixed rule on link density and words
stands in for the tree. Line numbers count from 1 at ``\\n``. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.session import written
from vellum.sources.tables import table

#: Pages of the labelled table at most; depth and smallest leaf of the tree.
TRAIN_PAGES, DEPTH, LEAF = 1500, 10, 15
#: Blocks of a page of that table at most; longer pages are not drawn.
TRAIN_BLOCKS = 400
KINDS = ("other", "item", "heading", "cell", "control", "quote")

_HTML = re.compile(r"<(?:!doctype|html|head|body)\b", re.I)
_FENCED = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1|\Z)|`[^`\n]*`", re.M | re.S)
_TAG = re.compile(r"<[^>]*>")
_FIRST = re.compile(r"<(\w+)")
_ANCHOR = re.compile(r"<a\b[^>]*>(.*?)</a>", re.I)
_OPENS = re.compile(r"^\s*<(p|li|div|blockquote|td|h[1-6]|figcaption|dd|dt)\b[^>]*>(?=.*\S)", re.I)
_HIDDEN = re.compile(r"<(script|style|noscript|template|head)\b.*?</\1>|<!--.*?-->", re.I | re.S)
_HIDES = re.compile(r"<(?:script|style|noscript|template|head)\b|<!--", re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title>", re.I | re.S)
_MAIN = re.compile(r"<(/?)(main|article)\b", re.I)
_LINK = re.compile(r"!?\[([^\]]*)\]\([^)]*\)")
_MARK = re.compile(r"^(?:[-*+]|\d+[.)])\s+")
_DIGITS = re.compile(r"\d+")
_SEPARATOR = re.compile(r" (?:[›>/·|»]) ")
_ENDS = re.compile(r"[.!?:;。！？…][\"'”’»)\]]*$")
_KIND_OF = {"li": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "td": 3, "tr": 3, "th": 3, "button": 4, "a": 4, "span": 4, "blockquote": 5}


def _blank(match: re.Match) -> str:
    return "\n" * match.group().count("\n")


def html_blocks(body: str) -> tuple[list, set[str]]:
    """``[line, lines, text, kind, linked characters, inside]`` of each block; the page's titles."""
    titles = {t.strip() for m in _TITLE.findall(body) for t in (html.unescape(m), html.unescape(m).rpartition(" - ")[0]) if t.strip()}
    marked = bool(_MAIN.search(body))
    out, depth, pending = [], 0, None
    at = max(0, body.find("<body"))
    skipped = body.count("\n", 0, at)
    shown = body[at:]
    if _HIDES.search(shown):
        shown = _HIDDEN.sub(_blank, shown)
    for no, line in enumerate(shown.split("\n"), 1 + skipped):
        if marked and ("main" in line or "article" in line):
            for m in _MAIN.finditer(line):
                depth += -1 if m.group(1) else 1
        text = _TAG.sub(" ", line) if "<" in line else line
        text = " ".join((html.unescape(text) if "&" in text else text).split())
        if pending is not None and text:
            block = out[pending]
            block[1], block[2] = no - block[0] + 1, f"{block[2]} {text}"
            block[4] += sum(len(_TAG.sub("", a)) for a in _ANCHOR.findall(line))
            if "</" in line and _TAG.sub("", line.rstrip()[-12:]) != line.rstrip()[-12:]:
                pending = None
            continue
        if not text:
            continue
        first = _FIRST.search(line)
        name = first.group(1).lower() if first else ""
        linked = sum(len(html.unescape(_TAG.sub("", a))) for a in _ANCHOR.findall(line)) if "<a" in line else 0
        out.append([no, 1, text, _KIND_OF.get(name, 0), linked, int(depth > 0) if marked else None])
        if name == "h1":
            titles.add(text)
        opened = _OPENS.match(line)
        pending = len(out) - 1 if opened and f"</{opened.group(1)}" not in line else None
    return out, titles


def markdown_blocks(text: str) -> tuple[list, set[str]]:
    out, titles = [], set()
    lines = text.split("\n")
    skip = 0
    if lines and lines[0].strip() == "---":
        skip = next((i for i, x in enumerate(lines[1:], 2) if x.strip() == "---"), 0)
    for no, raw in enumerate(lines, 1):
        line = raw.strip()
        if no <= skip or not line or not re.search(r"\w", line):
            continue
        kind = 0
        if mark := _MARK.match(line):
            kind, line = 1, line[mark.end() :]
        elif line.startswith("#"):
            level = len(line) - len(line.lstrip("#"))
            kind, line = 2, line.lstrip("# ")
            if level == 1:
                titles.add(line)
        elif line.startswith("|"):
            kind, line = 3, line.strip("| ")
        elif line.startswith(">"):
            kind, line = 5, line.lstrip("> ")
        elif line.startswith("**") and line.endswith("**"):
            kind = 2
        linked = sum(len(m) for m in _LINK.findall(line)) if "](" in line else 0
        shown = " ".join(_LINK.sub(r"\1", line).replace("**", "").split())
        if linked and kind == 0 and linked >= len(shown):
            kind = 4
        if shown:
            out.append([no, 1, shown, kind, linked, None])
    return out, titles


def block_key(text: str, ends: bool) -> str:
    """Equal for blocks whose words differ, after the first, in numbers, names and punctuation only; every word counts."""
    words = [w.strip(".,;:") for w in text.split(" ")]
    words[1:] = ["X" if w[:1].isupper() else w for w in words[1:]]
    return _DIGITS.sub("9", " ".join(words)) + (" !" if ends else "")


_BLOCK = T.StructType(
    [
        T.StructField("tbl", T.StringType()),
        T.StructField("row_id", T.LongType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("n_lines", T.IntegerType()),
        T.StructField("key", T.StringType()),
        T.StructField("words", T.IntegerType()),
        T.StructField("density", T.FloatType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("ends", T.IntegerType()),
        T.StructField("parts", T.IntegerType()),
        T.StructField("title", T.IntegerType()),
        T.StructField("inside", T.IntegerType()),
        T.StructField("uid", T.LongType()),
    ]
)


def is_html(body: str) -> bool:
    """Whether a body names an element of a page's frame, or its main part, anywhere but in Markdown code."""
    if "<" not in body:
        return False
    shown = _FENCED.sub("", body) if "`" in body or "~~~" in body else body
    return bool(_HTML.search(shown) or _MAIN.search(shown))


def _features(tbl: str, row_id: int, body: str, title: str | None, uid: int) -> list[tuple]:
    markup = is_html(body)
    blocks, titles = html_blocks(body) if markup else markdown_blocks(body)
    if title:
        titles.add(title.strip())
    parts = [len(_SEPARATOR.findall(b[2])) if _SEPARATOR.search(b[2]) else 0 for b in blocks]
    for b, n in zip(blocks, parts, strict=True):
        if n:
            titles.add(_SEPARATOR.split(b[2])[-1])
    out = []
    for (no, lines, text, kind, linked, inside), n in zip(blocks, parts, strict=True):
        ends = bool(_ENDS.search(text[-6:]))
        words = text.count(" ") + 1
        out.append((tbl, row_id, no, lines, block_key(text, ends), words, min(1.0, linked / len(text)), kind, int(ends), n, int(text in titles and kind != 1), inside, uid))
    return out


def numbered(pages: DataFrame) -> DataFrame:
    """Pages with ``uid``: a row is a page of its own, also where its id is null or repeated. Pages that have one keep it."""
    return pages if "uid" in pages.columns else pages.withColumn("uid", F.monotonically_increasing_id())


def blocks(pages: DataFrame) -> DataFrame:
    """Blocks of pages ``(tbl, row_id, body, title)``; keys come out hashed."""

    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float32(), *[pa.int32()] * 5, pa.int64()]
        for batch in batches:
            found = []
            for values in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if values[2]:
                    found += _features(*values)
            columns = list(zip(*found, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], _BLOCK.names)

    rows = numbered(pages).select("tbl", "row_id", "body", "title", "uid").mapInArrow(run, _BLOCK)
    return rows.withColumn("key", F.xxhash64("key")).withColumn("kind", F.col("kind").cast("byte"))


def with_shares(rows: DataFrame) -> DataFrame:
    """``share``: of equal blocks on pages with a main element, how many stand outside; -1 where unknown."""
    counted = rows.filter("inside IS NOT NULL").groupBy("key").agg(
        F.count(F.lit(1)).alias("seen"), F.sum(1 - F.col("inside")).alias("outside")
    )
    # A block seen once tells only of itself.
    counted = counted.filter("seen > 1").select("key", (F.col("outside") / F.col("seen")).cast("float").alias("share"), F.log2("seen").cast("float").alias("often"))
    return rows.join(counted, "key", "left").withColumns({"share": F.coalesce("share", F.lit(-1.0)), "often": F.coalesce("often", F.lit(0.0))})


FEATURES = (
    "words", "density", "kind", "ends", "parts", "title", "share", "often", "words_1", "density_1", "share_1", "ends_1", "words_2", "density_2",
    "share_2", "ends_2", "kind_1", "kind_2", "list_density", "list_ends", "list_share", "list_size", "run_share", "run_size", "before", "words_3", "ends_3", "share_3",
)


def with_neighbours(rows: DataFrame) -> DataFrame:
    """The features of :data:`FEATURES`: of a block, its neighbours (1 before, 2 and 3 after), its list and its run of short blocks."""
    page = Window.partitionBy("uid", "plain").orderBy("line_no")
    near = {}
    for c, none in (("words", 0), ("density", 0.0), ("share", -1.0), ("ends", 0), ("kind", -1)):
        near[f"{c}_1"] = F.coalesce(F.lag(c).over(page), F.lit(none))
        near[f"{c}_2"] = F.coalesce(F.lead(c).over(page), F.lit(none))
        if c in ("words", "ends", "share"):
            near[f"{c}_3"] = F.coalesce(F.lead(c, 2).over(page), F.lit(none))
    prose = (F.col("ends") == 1) & (F.col("words") >= 8) & (F.col("share") < 0.5)
    earlier = page.rowsBetween(Window.unboundedPreceding, -1)
    near["before"] = F.least(F.coalesce(F.sum(prose.cast("int")).over(earlier), F.lit(0)), F.lit(3))
    item = F.col("kind") == 1
    short = (F.col("ends") == 0) & (F.col("words") <= 14)
    rows = rows.withColumns({"item": item, "short": short}).withColumns(near)
    rows = rows.withColumn("lag_item", F.lag("item").over(page)).withColumn("lag_short", F.lag("short").over(page))
    turn = {f"{n}_run": F.sum((~F.col(f"lag_{n}").eqNullSafe(F.col(n))).cast("int")).over(page) for n in ("item", "short")}
    rows = rows.withColumns(turn)
    mine = Window.partitionBy("uid", "plain", "item_run")
    run = Window.partitionBy("uid", "plain", "short_run")
    known = F.when(F.col("share") >= 0, F.col("share"))
    first = F.min_by("share_1", "line_no").over(mine)
    return rows.withColumns(
        {
            "list_density": F.when(F.col("item"), F.avg("density").over(mine)).otherwise(-1.0),
            "list_ends": F.when(F.col("item"), F.avg("ends").over(mine)).otherwise(-1.0),
            "list_share": F.when(F.col("item"), first).otherwise(-1.0),
            "list_size": F.when(F.col("item"), F.count(F.lit(1)).over(mine)).otherwise(0),
            "run_share": F.when(F.col("short"), F.coalesce(F.avg(known).over(run), F.lit(-1.0))).otherwise(-1.0),
            "run_size": F.when(F.col("short"), F.count(F.lit(1)).over(run)).otherwise(0),
        }
    )


def grown(x: np.ndarray, y: np.ndarray, depth: int = DEPTH, leaf: int = LEAF):
    """A tree by falling Gini impurity: ``(feature, threshold, left, right)`` or the share of furniture."""
    p = float(y.mean()) if len(y) else 0.0
    if depth == 0 or len(y) < 2 * leaf or p in (0.0, 1.0):
        return p
    best = (1e-9, None, None)
    parent = p * (1 - p) * len(y)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        ones = np.cumsum(t)
        n = np.arange(1, len(t))
        cut = (v[1:] > v[:-1]) & (n >= leaf) & (len(t) - n >= leaf)
        if not cut.any():
            continue
        left, right = ones[:-1], ones[-1] - ones[:-1]
        impurity = left * (n - left) / n + right * (len(t) - n - right) / (len(t) - n)
        gain = np.where(cut, parent - impurity, -1)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
    _, f, threshold = best
    if f is None:
        return p
    side = x[:, f] <= threshold
    return f, threshold, grown(x[side], y[side], depth - 1, leaf), grown(x[~side], y[~side], depth - 1, leaf)


def expression(tree) -> Column:
    """The tree as one expression over :data:`FEATURES`."""
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, threshold, left, right = tree
    return F.when(F.col(FEATURES[f]) <= threshold, expression(left)).otherwise(expression(right))


def labelled_table(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the drawn pages: as they are, without links, without tags."""
    marked = rows.filter("inside IS NOT NULL")
    pages = marked.groupBy("uid").agg(F.count(F.lit(1)).alias("blocks"), F.min(F.xxhash64("tbl", "row_id")).alias("draw"))
    uids = [r["uid"] for r in pages.filter(F.col("blocks") <= TRAIN_BLOCKS).orderBy("draw", "uid").limit(TRAIN_PAGES).collect()]
    if not uids:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    pages = rows.sparkSession.createDataFrame([(u,) for u in uids], "uid long")  # at most TRAIN_PAGES
    drawn = marked.join(F.broadcast(pages), "uid", "left_semi")
    none = {"density": F.lit(0.0).cast("float")}
    unlinked = drawn.withColumns({"plain": F.lit(1), **none})
    bare = drawn.withColumns({"plain": F.lit(2), "kind": F.lit(0).cast("byte"), **none})
    table_ = with_neighbours(drawn.unionByName(unlinked).unionByName(bare))
    own = (F.col("share") >= 0.5) & (F.col("title") == 0)
    listed = (F.col("kind") == 1) & (F.col("ends") == 0) & (F.col("list_share") >= 0.5)
    run = (F.col("run_share") >= 0.5) & (F.col("title") == 0) & ~F.col("share").between(0, 0.3)
    doubtful = (F.col("inside") == 1) & (own | listed | run)
    kept = table_.filter(~doubtful).select(*[F.col(c).cast("float") for c in FEATURES], (1 - F.col("inside")).alias("y")).toPandas()
    return kept[list(FEATURES)].to_numpy(np.float64), kept["y"].to_numpy(np.float64)


def furniture(pages: DataFrame) -> DataFrame:
    """``(tbl, row_id, line_no, n_lines, uid)`` of blocks of pages ``(tbl, row_id, body, title, uid)`` that are no part of the article."""
    rows = with_shares(written(blocks(pages), "page-blocks")).withColumn("plain", F.lit(0))
    x, y = labelled_table(rows)
    score = expression(grown(x, y)) if len(y) else F.when((F.col("density") > 0.5) | (F.col("words") < 4), 1.0).otherwise(0.0)
    found = with_neighbours(rows).filter(score >= 0.5)
    lines = F.explode(F.sequence(F.col("line_no"), F.col("line_no") + F.col("n_lines") - 1))
    return found.select("tbl", "row_id", "uid", lines.alias("line_no"))


_SOURCES = (("acquisitions", "page_id", "body", "browser_title"), ("capture_outcomes", "capture_id", "markdown", None))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for name, key, body, title in _SOURCES:
        shown = F.col(title) if title else F.lit(None).cast("string")
        parts.append(table(spark, folder, name).select(F.lit(name).alias("tbl"), F.col(key).alias("row_id"), F.col(body).alias("body"), shown.alias("title")))
    return reduce(DataFrame.unionByName, parts)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return furniture(_pages(spark, folder)).select("tbl", "row_id", "line_no")


def articles(pages: DataFrame) -> DataFrame:
    """``(tbl, row_id, article)`` of every page with a body, without the lines of its furniture.

    The pages are written once with their numbers, so a row finds its own lines again
    whatever its id.
    """
    pages = written(numbered(pages.filter("body IS NOT NULL")), "pages")
    dropped = furniture(pages).groupBy("uid").agg(F.collect_set("line_no").alias("dropped"))
    lines = F.split("body", "\n")
    kept = F.filter(lines, lambda line, i: F.coalesce(~F.array_contains("dropped", i + 1), F.lit(True)))
    return pages.join(dropped, "uid", "left").select("tbl", "row_id", F.array_join(kept, "\n").alias("article"))


def p5_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with a body without the lines of its furniture."""
    return articles(_pages(spark, folder))
