"""Content-addressed assets, manifests and transactional bundles."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import image_type

MANIFEST_VERSION = 3


def addressed(assets: DataFrame, cap: int) -> DataFrame:
    """``(source, sha256, path, bytes)`` of assets ``(ordinal, source, content)`` that are images within ``cap``."""
    kept = assets.filter(F.col("content").isNotNull() & (F.octet_length("content") <= cap)).withColumn("ext", image_type(F.col("content")))
    sha = F.sha2("content", 256)
    return kept.filter("ext IS NOT NULL").select(
        "ordinal", "source", sha.alias("sha256"), F.concat(F.lit("assets/"), sha, F.lit("."), F.col("ext")).alias("path"), F.octet_length("content").alias("bytes")
    )


def deduplicated(rows: DataFrame, key: str = "sha256", order: str = "ordinal") -> DataFrame:
    """The first row of each key; combined before the shuffle."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), F.col(order)).alias("r")).select(key, "r.*")


def within_budget(rows: DataFrame, budget: int, group: str, order: str = "ordinal") -> DataFrame:
    """Rows of each group while their running total of ``bytes`` stays within the budget."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("total", F.sum("bytes").over(before)).filter(F.col("total") <= budget).drop("total")


def asset_names(rows: DataFrame, group: str, name: str = "name", order: str = "ordinal") -> DataFrame:
    """Names without collisions: repeated ones get a number before the extension."""
    clean = F.regexp_replace(F.lower(name), r"[^a-z0-9._-]+", "-")
    nth = F.row_number().over(Window.partitionBy(group, "base").orderBy(order))
    stem, ext = F.regexp_extract("base", r"^(.*?)(\.[a-z0-9]+)?$", 1), F.regexp_extract("base", r"^(.*?)(\.[a-z0-9]+)?$", 2)
    rows = rows.withColumn("base", clean).withColumn("nth", nth)
    return rows.withColumn("asset_name", F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat(stem, F.lit("-"), F.col("nth"), ext))).drop("base", "nth")


def manifest(captures: DataFrame) -> DataFrame:
    """``(capture_id, manifest)``: the JSON manifest of each capture, its fields checked."""
    sound = F.col("status").isin("complete", "partial", "auth-required", "blocked", "unsupported") & F.col("source_url").rlike("(?i)^https?://")
    checked = F.when(sound, F.lit(MANIFEST_VERSION)).otherwise(F.raise_error(F.concat(F.lit("bad manifest of capture "), F.col("capture_id").cast("string"))).cast("int"))
    fields = F.struct(
        checked.alias("version"), F.col("source_url").alias("sourceUrl"), F.col("canonical_url").alias("canonicalUrl"),
        F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("capturedAt"), "platform", "status", F.col("capture_scope").alias("scope"),
        F.struct(F.col("acquisition_method").alias("method")).alias("acquisition"), F.struct("extractor", F.col("word_count").alias("wordCount")).alias("extraction"),
        F.array_distinct(F.coalesce("warnings", F.array().cast("array<string>"))).alias("warnings"),
    )
    return captures.select("capture_id", F.to_json(fields).alias("manifest"))


def capture_document(title: Column, author: Column, source: Column, captured: Column, status: Column, body: Column) -> Column:
    """A capture as Markdown: metadata, heading, body."""

    def quoted(c: Column) -> Column:
        return F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)

    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), quoted(c))) for k, c in (("title", title), ("author", author), ("source", source), ("captured", captured), ("status", status))]
    head = F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"))
    repeated = F.startswith(F.ltrim(body), F.concat(F.lit("# "), title))
    return F.concat(head, F.when(title.isNotNull() & ~F.coalesce(repeated, F.lit(False)), F.concat(F.lit("# "), title, F.lit("\n\n"))).otherwise(""), F.regexp_replace(body, r"^\s+|\s+$", ""), F.lit("\n"))


class Bundle:
    """One capture's folder, written aside and moved into place, or not at all.

    A folder that exists is replaced only by ``force`` and only if it holds a manifest of
    this engine; a failed move brings it back.
    """

    def __init__(self, target: str | os.PathLike, force: bool = False) -> None:
        self.target = Path(target)
        if self.target in (Path("/"), Path.home()) or self.target.is_symlink():
            raise ValueError(f"{self.target} is no place for a bundle")
        if self.target.exists() and not (force and self._owned()):
            raise FileExistsError(self.target)
        self.staging = self.target.parent / f".{self.target.name}.{uuid.uuid4().hex}"
        self.staging.mkdir(parents=True)

    def _owned(self) -> bool:
        try:
            return json.loads((self.target / "manifest.json").read_text()).get("version") == MANIFEST_VERSION
        except (OSError, ValueError):
            return False

    def write(self, name: str, data: bytes, sha256: str | None = None) -> None:
        place = (self.staging / name).resolve()
        if not place.is_relative_to(self.staging.resolve()):
            raise ValueError(f"{name} leaves the bundle")
        if sha256 and hashlib.sha256(data).hexdigest() != sha256:
            raise ValueError(f"{name} is not the file that was announced")
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(data)

    def commit(self) -> Path:
        old = self.target.parent / f".{self.target.name}.old.{uuid.uuid4().hex}"
        moved = self.target.exists()
        if moved:
            os.replace(self.target, old)
        try:
            os.replace(self.staging, self.target)
        except OSError:
            if moved:
                os.replace(old, self.target)
            self.abort()
            raise
        shutil.rmtree(old, ignore_errors=True)
        return self.target

    def abort(self) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


def write_bundles(captures: DataFrame, root: str, force: bool = False) -> None:
    """Writes ``captures(slug, markdown, manifest)`` as bundles below a shared folder, each by the task that holds its row."""

    def write(rows) -> None:
        for row in rows:
            bundle = Bundle(Path(root) / row["slug"], force)
            try:
                bundle.write("capture.md", (row["markdown"] or "").encode())
                bundle.write("manifest.json", row["manifest"].encode())
            except BaseException:
                bundle.abort()
                raise
            bundle.commit()

    captures.select("slug", "markdown", "manifest").foreachPartition(write)
