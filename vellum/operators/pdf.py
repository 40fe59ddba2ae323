"""PDF geometry to blocks: visual lines, columns, body size, headings, margins, paragraphs; OCR words to lines.

Fragments are ``pdf_id, page_no, top_pt, left_pt, width_pt, height_pt, font_size, bold, text``.
Everything is a window within a page or an aggregate of a document joined back, so no
page or document is held in one task's memory.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.text import image_type
from vellum.session import written

#: A list item's mark (fixed value).
BULLET = r"^(?:[•●◦▪▫‣⁃*-]|\d{1,4}[.)]|[a-zA-Z][.)])\s+(.+)$"
LARGER, BOLD, BOLD_GAP, PARAGRAPH_GAP = 1.08, 0.78, 1.45, 1.55


def half_points(size: Column) -> Column:
    """A size rounded to half points, halves upwards."""
    return F.floor(size * 2 + 0.5) / 2


def with_rows(fragments: DataFrame) -> DataFrame:
    """Fragments with ``row_no``: by rising top a row goes on while it is no further from its least top than the tolerance.

    Pages come as sorted streams; of each only the current row's top is held.
    """
    schema = T.StructType([*fragments.schema.fields, T.StructField("row_no", T.IntegerType())])

    def run(batches):
        page, least, row = None, 0.0, 0
        for batch in batches:
            numbers = []
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("pdf_id", "page_no", "top_pt", "height_pt"))
            for pdf, no, top, height in zip(*columns, strict=True):
                if page != (pdf, no):
                    page, row, least = (pdf, no), 1, top
                elif top is not None and (least is None or abs(top - least) > max(2.0, (height or 0.0) * 0.18)):
                    row, least = row + 1, top
                numbers.append(row)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int32())], [*batch.schema.names, "row_no"])

    ordered = fragments.repartition("pdf_id", "page_no").sortWithinPartitions("pdf_id", "page_no", "top_pt", "left_pt", "fragment_id")
    return ordered.mapInArrow(run, schema)


def visual_lines(fragments: DataFrame, page_width: float = 595.0) -> DataFrame:
    """Fragments joined to lines: rows by their top, columns by wide gaps.

    A row begins where a fragment's top is further from the row's least top than the
    tolerance. A gap wider than a fifth of the page or eight font sizes begins another line
    of the same row. ``page_width`` counts where fragments have no column of that name.
    """
    rows = with_rows(fragments.filter("text IS NOT NULL"))
    width = F.coalesce(F.col("page_width"), F.lit(page_width)) if "page_width" in fragments.columns else F.lit(page_width)
    across = Window.partitionBy("pdf_id", "page_no", "row_no").orderBy("left_pt", "fragment_id")
    reached = F.max(F.col("left_pt") + F.col("width_pt")).over(across.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("gap", F.col("left_pt") - reached)
    wide = F.col("gap") > F.greatest(width * 0.2, F.col("font_size") * 8)
    rows = rows.withColumn("part_no", F.sum(F.coalesce(wide.cast("int"), F.lit(0))).over(across))
    spaced = (F.col("gap") > F.greatest(F.lit(1.0), F.col("font_size") * 0.08)) & ~F.col("text").rlike(r"^[\s,.;:!?)}\]]")
    piece = F.concat(F.when(F.coalesce(spaced, F.lit(False)), " ").otherwise(""), F.col("text"))
    weight = F.greatest(F.lit(1), F.length(F.trim("text")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left_pt", "fragment_id", piece.alias("piece")))), lambda x: x["piece"]), "")
    lines = rows.groupBy("pdf_id", "page_no", "row_no", "part_no").agg(
        F.trim(F.regexp_replace(joined, r"[ \t]+", " ")).alias("text"),
        (F.sum(F.col("font_size") * weight) / F.sum(weight)).alias("font_size"),
        (F.sum(F.when(F.col("bold"), weight).otherwise(0)) / F.sum(weight)).alias("bold_ratio"),
        F.min("top_pt").alias("top"), F.min("left_pt").alias("left"), F.max(F.col("top_pt") + F.col("height_pt")).alias("bottom"),
    )
    return lines.filter("text != ''")


def body_sizes(lines: DataFrame) -> DataFrame:
    """``(pdf_id, body_size)``: the size of most characters, the smaller of equals."""
    weights = lines.groupBy("pdf_id", half_points(F.col("font_size")).alias("size")).agg(F.sum(F.length("text")).alias("chars"))
    return weights.groupBy("pdf_id").agg(F.min_by("size", F.struct(-F.col("chars"), F.col("size"))).alias("body_size"))


def heading_levels(lines: DataFrame, bodies: DataFrame) -> DataFrame:
    """``(pdf_id, size, level)``: sizes larger than the body's, the largest level 2, none beyond 6."""
    larger = lines.join(bodies, "pdf_id").filter(F.col("font_size") > F.col("body_size") * LARGER)
    sizes = larger.select("pdf_id", half_points(F.col("font_size")).alias("size")).distinct()
    rank = F.row_number().over(Window.partitionBy("pdf_id").orderBy(F.desc("size")))
    return sizes.select("pdf_id", "size", F.least(F.lit(6), rank + 1).alias("level"))


def margin_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\d+", "#"), r"\s+", " "))


def repeated_margins(lines: DataFrame, page_height: float = 842.0) -> DataFrame:
    """``(pdf_id, margin)``: texts in the outer 6 % of three pages and 40 % of all pages at least."""
    pages = lines.groupBy("pdf_id").agg(F.count_distinct("page_no").alias("pages"))
    outer = (F.col("top") <= page_height * 0.06) | (F.col("bottom") >= page_height * 0.94)
    found = lines.filter(outer & (F.length("text") <= 160)).select("pdf_id", "page_no", margin_text(F.col("text")).alias("margin"))
    counts = found.filter("margin != ''").groupBy("pdf_id", "margin").agg(F.count_distinct("page_no").alias("on"))
    return counts.join(pages, "pdf_id").filter(F.col("on") >= F.greatest(F.lit(3), F.ceil(F.col("pages") * 0.4))).select("pdf_id", "margin")


def upper_median(column: str) -> Column:
    """The upper of the two middle values; interpolates nothing."""
    values = F.sort_array(F.collect_list(column))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def layout_blocks(lines: DataFrame, page_height: float = 842.0) -> DataFrame:
    """``(pdf_id, page_no, block_no, kind, level, text)`` of lines of :func:`visual_lines`."""
    lines = written(lines, "pdf-lines")  # read five times
    bodies = body_sizes(lines)
    levels = heading_levels(lines, bodies)
    margins = repeated_margins(lines, page_height).withColumnRenamed("margin", "margin_key")
    kept = lines.withColumn("margin_key", margin_text(F.col("text"))).join(margins, ["pdf_id", "margin_key"], "left_anti").drop("margin_key")
    kept = kept.join(bodies, "pdf_id").withColumn("size", half_points(F.col("font_size"))).join(levels, ["pdf_id", "size"], "left")
    page = Window.partitionBy("pdf_id", "page_no").orderBy("top", "left", "row_no", "part_no")
    kept = kept.withColumn("gap", F.col("top") - F.lag("top").over(page))
    steps = kept.filter("gap > 0").groupBy("pdf_id", "page_no").agg(upper_median("gap").alias("step"))
    kept = kept.join(steps, ["pdf_id", "page_no"], "left")
    step = F.coalesce("step", F.greatest(F.lit(1.0), F.col("body_size") * 1.4))
    gap = F.coalesce("gap", F.lit(float("inf")))
    larger = F.col("font_size") > F.col("body_size") * LARGER
    bold = (F.col("bold_ratio") >= BOLD) & (F.length("text") <= 180) & (gap >= step * BOLD_GAP)
    heading = (F.length("text") <= 240) & (larger | bold)
    item = F.regexp_extract("text", BULLET, 1)
    kind = F.when(heading, "heading").when(item != "", "list-item").otherwise("paragraph")
    kept = kept.withColumns({"kind": kind, "level": F.when(heading, F.when(larger, F.col("level")).otherwise(2)), "text": F.when(~heading & (item != ""), F.trim(item)).otherwise(F.col("text"))})
    # a paragraph goes on while lines of text follow each other without a wide gap
    fresh = (F.col("kind") != "paragraph") | (F.lag("kind").over(page) != "paragraph") | (F.col("gap") >= step * PARAGRAPH_GAP) | F.col("gap").isNull()
    kept = kept.withColumn("block_no", F.sum(F.coalesce(fresh.cast("int"), F.lit(1))).over(page))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "left", "row_no", "part_no", "text"))), lambda x: x["text"]), " ")
    return kept.groupBy("pdf_id", "page_no", "block_no").agg(
        F.first("kind").alias("kind"), F.first("level").alias("level"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text")
    )


def inline(text: Column) -> Column:
    """Text that Markdown shows as it is, on one line."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"([\\`*_\[\]{}<>#])", r"\\$1"), r"\s+", " "))


def markdown(blocks: DataFrame) -> DataFrame:
    """``(pdf_id, markdown, n_headings, n_texts)``: a document is one file, so its blocks meet in one row.

    A block of kind ``image`` brings its Markdown (:func:`image_markdown`) as its text.
    """
    shown = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(2), F.least(F.lit(6), F.coalesce("level", F.lit(2))))), F.lit(" "), inline(F.col("text"))))
        .when(F.col("kind") == "list-item", F.concat(F.lit("- "), inline(F.col("text"))))
        .when(F.col("kind") == "image", F.col("text"))
        .otherwise(inline(F.col("text")))
    )
    first = F.row_number().over(Window.partitionBy("pdf_id", "page_no").orderBy("block_no")) == 1
    rows = blocks.withColumn("shown", F.concat(F.when(first, F.concat(F.lit("<!-- pdf-page: "), F.col("page_no"), F.lit(" -->\n\n"))).otherwise(""), shown))
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "block_no", "shown")))
    return rows.groupBy("pdf_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["shown"]), "\n\n").alias("markdown"),
        F.count_if(F.col("kind") == "heading").alias("n_headings"), F.count_if(F.col("kind").isin("paragraph", "list-item")).alias("n_texts"),
    )


def documents(facts: DataFrame, bodies: DataFrame) -> DataFrame:
    """``(pdf_id, markdown)`` with frontmatter: ``facts`` are one row a document, ``bodies`` as of :func:`markdown`."""

    def quoted(name: str) -> Column:
        text = F.col(name)
        for plain, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
            text = F.replace(text, F.lit(plain), F.lit(shown))
        return F.concat(F.lit('"'), text, F.lit('"'))

    named = F.nullif(F.trim(F.regexp_replace("filename", r"(?i)\.pdf$", "")), F.lit(""))
    facts = facts.withColumn("title", F.coalesce("title", named, F.col("pdf_id")))
    lines = {
        "title": quoted("title"), "source": F.lit('"source.pdf"'), "source_type": F.lit('"pdf"'), "source_original_filename": quoted("filename"), "source_sha256": quoted("sha256"), "source_url": quoted("source_url"),
        "pages": F.col("pages").cast("string"), "clipped": quoted("clipped"), "capture_status": quoted("status"), "capture_method": F.lit('"poppler"'), "author": quoted("author"), "description": quoted("subject"), "created": quoted("created"),
    }
    head = F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in lines.items()])  # what is null is left out
    text = F.concat(F.lit("---\n"), head, F.lit("\n---\n\n# "), inline(F.col("title")), F.lit("\n\n[Open the source PDF](source.pdf)\n\n"), F.coalesce("markdown", F.lit("")))
    return facts.join(bodies.select("pdf_id", "markdown"), "pdf_id", "left").select("pdf_id", F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n")).alias("markdown"))


# --- images -----------------------------------------------------------------


def image_candidates(images: DataFrame) -> DataFrame:
    """Images ``(pdf_id, page_no, place, content)`` with their id, hash, size and type; of an unknown type there is a warning and no id."""
    sha, kind = F.sha2("content", 256), image_type(F.col("content"))
    name = F.concat(F.lit("page-"), F.col("page_no"), F.lit("-image-"), F.col("place") + 1, F.lit("-"), F.substring(sha, 1, 12))
    return images.select(
        *[c for c in images.columns if c != "content"], F.when(kind.isNotNull(), name).alias("image_id"), sha.alias("sha256"), F.octet_length("content").alias("n_bytes"), kind.alias("extension"),
        F.when(kind.isNull(), F.concat(F.lit("Skipped an unsupported generated image on page "), F.col("page_no"), F.lit("."))).alias("warning"),
    )


def resolved_images(candidates: DataFrame, notes: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Each image by its note ``(image_id, kind, method, markdown, platform)``, else by what was recognised in it, else unclassified.

    ``words`` as of :func:`ocr_words`; text of too few or doubtful words leaves the image visual.
    """
    rows = candidates.filter("image_id IS NOT NULL").join(notes.select("image_id", F.col("kind").alias("said_kind"), F.col("method").alias("said_method"), F.col("markdown").alias("said"), "platform"), "image_id", "left")
    method, kind, text = F.coalesce("said_method", F.lit("manual")), F.col("said_kind"), F.when(F.col("said_kind") != "visual", F.col("said")).otherwise("")
    if words is None:
        other = (F.lit("unclassified"), F.lit("visual"), F.lit(""), F.lit(None).cast("double"))
    else:
        lines = ocr_lines(words).groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "block", "paragraph", "line_no", "text"))), lambda x: x["text"]), "\n").alias("read"))
        rows = rows.join(ocr_quality(words).select("image_id", "confidence", "substantive"), "image_id", "left").join(lines, "image_id", "left")
        sound = F.coalesce("substantive", F.lit(False))
        other = (F.lit("tesseract"), F.when(sound, "text").otherwise("visual"), F.when(sound, F.col("read")).otherwise(""), F.col("confidence"))
    noted = kind.isNotNull()
    out = {"method": F.when(noted, method).otherwise(other[0]), "kind": F.when(noted, kind).otherwise(other[1]), "markdown": F.when(noted, text).otherwise(other[2]), "confidence": F.when(~noted, other[3])}
    kept = [c for c in candidates.columns if c not in out]
    rows = rows.select(*kept, "platform", *[v.alias(k) for k, v in out.items()])
    return rows.withColumn("word_count", F.when(F.col("markdown") == "", 0).otherwise(F.regexp_count("markdown", F.lit(r"\S+"))))


def image_markdown(image: DataFrame) -> DataFrame:
    """Resolved images with ``shown``: the link to the asset, and the text that the image shows."""
    alt = inline(F.concat(F.coalesce("platform", F.lit("PDF image")), F.lit(" from page "), F.col("page_no").cast("string")))
    asset = F.concat(F.lit("assets/"), F.substring("sha256", 1, 16), F.lit("."), F.col("extension"))
    heading = F.concat(F.lit("#### Text visible in "), F.coalesce(F.concat(inline(F.col("platform")), F.lit(" image")), F.lit("image")))
    text = F.when(F.col("kind").isin("text", "mixed"), F.concat(F.lit("\n\n"), heading, F.lit("\n\n"), F.trim("markdown"))).otherwise("")
    return image.withColumn("shown", F.concat(F.lit("!["), alt, F.lit("]("), asset, F.lit(")"), text))


def capture_counts(resolved: DataFrame, warnings: DataFrame) -> DataFrame:
    """``(pdf_id, n_text, n_mixed, n_visual, ocr, n_warnings, status)``: a manifest's figures of images; ``warnings(pdf_id, warning)``."""

    def of(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind).alias(f"n_{kind}")

    noted, read = F.count_if(F.col("method").isin("agent", "manual")) > 0, F.count_if(F.col("method") == "tesseract") > 0
    ocr = F.when(noted & read, "mixed").when(noted, "annotations").when(read, "tesseract").otherwise("unavailable").alias("ocr")
    counts = resolved.groupBy("pdf_id").agg(of("text"), of("mixed"), of("visual"), ocr, F.count_if(F.col("method") == "unclassified").alias("open"))
    said = warnings.filter("warning IS NOT NULL").groupBy("pdf_id").agg(F.count_distinct("warning").alias("n_warnings"))
    rows = counts.join(said, "pdf_id", "full_outer").fillna(0, ["n_text", "n_mixed", "n_visual", "open", "n_warnings"]).fillna("unavailable", ["ocr"])
    return rows.withColumn("status", F.when((F.col("open") > 0) | (F.col("n_warnings") > 0), "partial").otherwise("complete")).drop("open")


# --- recognition ------------------------------------------------------------


def ocr_words(tsv: DataFrame) -> DataFrame:
    """Words of ``tsv(image_id, tsv)``, tables with a header line; rows without text or numbers drop out."""
    lines = F.split(F.col("tsv"), r"\r?\n")
    rows = tsv.select("image_id", F.split(F.get(lines, 0), "\t").alias("head"), F.explode(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).alias("line"))
    fields = F.split("line", "\t")

    def at(name: str) -> Column:
        place = F.array_position("head", name)
        return F.when(place > 0, F.get(fields, (place - 1).cast("int")))

    names = {"page": "page_num", "block": "block_num", "paragraph": "par_num", "line_no": "line_num", "word": "word_num"}
    columns = [at(v).try_cast("int").alias(k) for k, v in names.items()]
    words = rows.select("image_id", *columns, F.trim(at("text")).alias("text"), at("conf").try_cast("double").alias("confidence"))
    return words.filter((F.col("text") != "") & F.col("confidence").between(0, 100)).dropna()


def ocr_lines(words: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("word", "text")))
    return words.groupBy("image_id", "page", "block", "paragraph", "line_no").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"))


def ocr_quality(words: DataFrame) -> DataFrame:
    """Words, length-weighted confidence and whether an image's text is worth keeping."""
    n = F.length("text")
    figures = F.sum(F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))).alias("letters")
    rows = words.groupBy("image_id").agg(F.count(F.lit(1)).alias("words"), (F.sum(F.col("confidence") * n) / F.sum(n)).alias("confidence"), figures)
    return rows.withColumn("substantive", (F.col("words") >= 3) & (F.col("letters") >= 12) & (F.col("confidence") >= 35))
