"""From acquired pages to bundles: extraction, status, choice, naming, rewriting, redaction, manifests."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import pages, redaction, urls
from vellum.functions.text import bounded
from vellum.operators import assets, captures

#: Bounds of article metadata in UTF-16 units (fixed values).
META_UNITS = {"title": 2048, "author": 1024, "published": 256, "description": 8192}
MAX_JSON_NODES = 50_000
ARTICLE = "title string, author string, published string, description string, content string, declared_items bigint"


def declared_comments(source: str) -> int | None:
    """The first ``commentCount`` of a page's linked data, found depth first."""
    for block in re.findall(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", source):
        try:
            stack, seen = [json.loads(block)], 0
        except ValueError:
            continue
        while stack and seen < MAX_JSON_NODES:
            node = stack.pop()
            seen += 1
            if isinstance(node, dict):
                count = node.get("commentCount")
                if isinstance(count, (int, str)) and str(count).isdigit():
                    return int(count)
                stack += reversed(list(node.values()))
            elif isinstance(node, list):
                stack += reversed(node)
    return None


def _article(body: str | None, content_type: str | None, shown_title: str | None) -> tuple:
    if not body:
        return (None,) * 6
    markup = "html" in (content_type or "").lower() or (not content_type and re.search(r"(?i)<(?:!doctype|html|body)\b", body[:2000]))
    a = pages.extract_article(body) if markup else pages.Article(content=body)
    if not a.content.strip():
        return (None,) * 6
    meta = {k: bounded(v, n) if (v := getattr(a, k)) else None for k, n in META_UNITS.items()}
    return (meta["title"] or shown_title, meta["author"], meta["published"], meta["description"], a.content, declared_comments(body) if markup else None)


def articles(acquisitions: DataFrame) -> DataFrame:
    """Acquisitions with their article's fields; a body without text has none."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int64()]
        names = [part.split(" ")[0] for part in ARTICLE.split(", ")]
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("body", "content_type", "browser_title")]
            found = [_article(*r) for r in zip(*columns, strict=True)]
            made = [pa.array([r[i] for r in found], t) for i, t in enumerate(kinds)]
            kept = len(batch.columns) - 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *made], [*batch.schema.names[:kept], *names])

    # the article's columns come beside the page's own: no join, so rows keep apart whatever their ids
    own = ["page_id", "final_url", "content_type", "acquisition_method", "content_truncated", "warnings", "fetched_at"]
    rows = acquisitions.select(*own, "body", "browser_title")
    schema = T.StructType([*acquisitions.select(*own).schema.fields, *T.StructType.fromDDL(ARTICLE).fields])
    return rows.mapInArrow(run, schema)


def extractions(acquisitions: DataFrame) -> DataFrame:
    """Each acquisition's article with platform, scope, status, words and score.

    Of records with one ``page_id`` the one fetched first counts; records without id stay apart.
    """
    numbered = acquisitions.withColumn("own", F.when(F.col("page_id").isNull(), F.monotonically_increasing_id()))
    columns = F.struct(*[c for c in acquisitions.columns if c != "page_id"])
    place = F.struct(F.col("fetched_at").isNull(), "fetched_at", F.coalesce(F.length("body"), F.lit(-1)), F.xxhash64("body", "final_url"))
    first = numbered.groupBy("page_id", "own").agg(F.min_by(columns, place).alias("a")).select("page_id", "a.*")
    rows = articles(first)
    kind = urls.classified(F.col("final_url"))
    rows = rows.withColumns({"platform": F.coalesce(kind["platform"], F.lit("generic")), "content_id": kind["content_id"], "canonical_url": urls.canonical(F.col("final_url"))})
    rows = rows.withColumn("capture_scope", urls.scope(F.col("platform")))
    rows = rows.withColumn("status", captures.status(F.col("content"), F.col("title"), F.col("capture_scope"), F.col("content_truncated")))
    items = F.when(F.col("content").isNull(), 0).otherwise(1)
    score = captures.quality(F.col("content"), F.col("status"), items, F.col("acquisition_method"), F.col("content_type"))
    return rows.withColumns({"word_count": captures.word_count(F.col("content")).cast("bigint"), "captured_items": items, "score": score})


def chosen(rows: DataFrame) -> DataFrame:
    """One extraction an address: best status, then score, then the earliest page."""
    return captures.best_candidates(rows.filter("canonical_url IS NOT NULL"), "canonical_url", "page_id")


def finished(rows: DataFrame, local: dict[str, str] | None = None) -> DataFrame:
    """Chosen extractions as ``slug, status, markdown, manifest`` ready to be written; credentials are out."""

    @F.pandas_udf(T.StringType())
    def rewrite(contents: pd.Series, bases: pd.Series) -> pd.Series:
        pairs = zip(contents, bases, strict=True)
        return pd.Series([None if c is None else pages.rewritten(c, b, local or {}) for c, b in pairs], dtype=object)

    tail = F.nullif(F.regexp_extract("canonical_url", r"([^/?#]+)/*(?:[?#].*)?$", 1), F.lit(""))
    slug = urls.with_id(urls.slugs(redaction.redacted(F.coalesce("title", tail))["text"]), F.col("content_id"))
    rows = rows.withColumn("slug", F.when(slug == "", F.concat(F.lit("page-"), F.col("page_id").cast("string"))).otherwise(slug))
    # equal slugs of different addresses are kept apart by a hash of the address
    repeated = rows.groupBy("slug").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("slug", F.lit(True).alias("shared"))
    apart = F.concat("slug", F.lit("-"), F.substr(F.sha2("canonical_url", 256), F.lit(1), F.lit(8)))
    rows = rows.join(repeated, "slug", "left").withColumn("slug", F.when(F.col("shared"), apart).otherwise(F.col("slug"))).drop("shared")
    body = F.coalesce(rewrite("content", "canonical_url"), F.lit(""))
    document = assets.capture_document(F.col("title"), F.col("author"), F.col("canonical_url"), F.col("fetched_at").cast("string"), F.col("status"), body)
    rows = rows.withColumn("clean", redaction.redacted(document))
    described = rows.select(
        F.col("page_id").alias("capture_id"), F.col("final_url").alias("source_url"), "canonical_url", F.col("fetched_at").alias("captured_at"), "platform", "status",
        "capture_scope", "acquisition_method", F.lit("readable").alias("extractor"), "word_count", "warnings",
    )
    manifests = assets.manifest(described)
    return rows.join(manifests.withColumnRenamed("capture_id", "page_id"), "page_id").select(
        "page_id", "slug", "status", F.col("clean.text").alias("markdown"), F.col("clean.count").alias("n_redacted"), "manifest"
    )


def run(acquisitions: DataFrame, root: str, force: bool = False) -> DataFrame:
    """Extracts, chooses, writes bundles below ``root``; returns the report of what was written."""
    rows = finished(chosen(extractions(acquisitions)))
    assets.write_bundles(rows, root, force)
    return rows.select("page_id", "slug", "status", "n_redacted")


# --- checks and small rules -------------------------------------------------


def is_slug(text: Column) -> Column:
    return text.rlike(r"^[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*$") & (F.length(text) <= 80)


def is_artifact_path(text: Column) -> Column:
    """A relative path within a bundle: no empty, hidden or upward parts."""
    return text.rlike(r"^(?!.*(?:^|/)\.)(?!.*//)[A-Za-z0-9._-]+(?:/[A-Za-z0-9._-]+)*$") & (F.length(text) <= 1024)


def scroll_budget(items: Column) -> Column:
    """How often a browser scrolls for so many items."""
    return F.greatest(F.lit(3), F.least(F.lit(40), F.ceil(items / 20))).cast("int")


def exit_code(status: Column) -> Column:
    return F.when(status.isin("complete", "partial"), 0).otherwise(3)


def visible_comments(content: Column) -> Column:
    """The number that a page says its comments have, with k and m."""
    said = r"(?i)\b(?:view|read|show)\s+(?:all\s+)?([\d,.]+)\s*([km])?\s+comments?\b"
    return captures.compact_count(F.nullif(F.concat(F.regexp_extract(content, said, 1), F.regexp_extract(content, said, 2)), F.lit("")))


def embedded_platforms(links: DataFrame) -> DataFrame:
    """``(doc_id, platform)`` of links ``(doc_id, ordinal, platform)``: each once, in its first spelling."""
    return links.groupBy("doc_id", F.lower("platform").alias("key")).agg(F.min_by("platform", "ordinal").alias("platform")).select("doc_id", "platform")


def annotated(images: DataFrame, notes: DataFrame) -> DataFrame:
    """Images ``(image_id, sha256)`` with their notes ``(image_id, sha256, description)``; a note of no or another image is an error."""
    known = images.select("image_id", F.col("sha256").alias("image_sha"))
    checked = notes.join(known, "image_id", "left").withColumn(
        "description",
        F.when(F.col("sha256").eqNullSafe(F.col("image_sha")), F.col("description")).otherwise(F.raise_error(F.concat(F.lit("note of another image: "), F.col("image_id")))),
    )
    return images.join(checked.select("image_id", "description"), "image_id", "left")
