"""The vault facade: the commands of the engine as methods."""

from __future__ import annotations

import platform
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum import session
from vellum.functions.urls import PLATFORMS
from vellum.operators import graph, notes, search, traverse
from vellum.plans import query as plans
from vellum.sources import vault


@dataclass
class Vault:
    """A folder of notes; every view is derived, lazy and rebuilt from the files."""

    spark: SparkSession
    root: str
    index: str = "index.md"
    suggest: Column | None = None
    on_error: str = "raise"
    embed: Callable[[Sequence[str]], np.ndarray] | None = None
    dimension: int = 0

    @property
    def catalog_id(self) -> str:
        return self.index.removesuffix(".md")

    @cached_property
    def notes(self) -> DataFrame:
        return notes.parse_notes(vault.read_vault(self.spark, self.root), self.on_error).filter("error IS NULL")

    @cached_property
    def graph(self) -> graph.Analysis:
        return graph.Analysis(self.notes, notes.raw_links(self.notes), self.catalog_id, self.suggest)

    def list(self, where: Sequence[plans.Equals] = (), has: Sequence[str] = (), tags: Sequence[str] = (), sort: plans.Sort | None = None, limit: int | None = None) -> DataFrame:
        """Content notes by metadata and tags; degrees are joined only where they are sorted on."""
        asked = plans.Query([*where, *map(plans.Exists, has)], tags, sort or plans.Sort(), limit)
        degrees = self.graph.degrees if asked.sort.by in ("inbound", "outbound") and not asked.sort.metadata else None
        return plans.run(self.notes.filter(F.col("id") != self.catalog_id), asked, degrees)

    def lookup(self, name: str) -> traverse.Lookup:
        return traverse.lookup_note(self.notes, name)

    def backlinks(self, name: str) -> DataFrame | None:
        found = self.lookup(name)
        return self.graph.backlinks.filter(F.col("target") == found.path) if found.kind == "found" else None

    def links(self, name: str, direction: str = "both", depth: int = 1, limit: int = 50) -> traverse.Neighborhood | None:
        found = self.lookup(name)
        return traverse.neighborhood(self.notes, self.graph.edges, found.path, direction, depth, limit) if found.kind == "found" else None

    def search(self, text: str, limit: int = 10, mode: str | None = None, min_score: float = 0.0, index: str | None = None) -> DataFrame:
        """Hits with their notes' titles, degrees and a snippet, best first.

        ``semantic`` (the default where an embedder is given) compares vectors of the index at
        ``index``; hits whose note has changed since, or is gone, are left out. ``keyword`` reads the
        notes as they are. ``min_score`` applies to the hits found.
        """
        mode = mode or ("semantic" if self.embed else "keyword")
        bodies = self.notes.filter(F.col("id") != self.catalog_id).select("id", "path", "title", "content", "searchable_text")
        if mode == "semantic":
            if self.embed is None or index is None:
                raise ValueError("semantic search needs an embedder and an index")
            vector = [float(x) for x in np.asarray(self.embed([text])).reshape(-1)]
            hits = search.semantic(search.current(self.spark.read.parquet(index)), vector, limit)
        elif mode == "keyword":
            hits = search.bm25(bodies, "path", "searchable_text", text, limit).withColumnRenamed("doc_id", "path")
            hits = hits.join(bodies.select("path", F.sha2("content", 256).alias("sha256")), "path").withColumn("start_pos", F.lit(None).cast("int"))
        else:
            raise ValueError(f"no mode {mode!r}")
        found = search.live_hits(hits, bodies, min_score).join(self.graph.degrees.select("id", "inbound", "outbound"), "id", "left")
        at = search.snippet_offset(F.col("content"), text, F.col("start_pos"))
        shown = found.select("path", "title", "score", "inbound", "outbound", search.hit_line(F.col("content"), at).alias("line"), search.snippet(F.col("content"), at).alias("snippet"))
        return shown.orderBy(F.desc("score"), "path")

    def build_index(self, path: str, force: bool = False) -> DataFrame:
        """Brings the chunk index at ``path`` up to date; counts of what was new, changed, removed.

        Changed notes are appended as a new part and listed in it; readers take a note's
        newest part. ``force`` writes everything anew. With an embedder chunks have their vectors.
        """
        bodies = self.notes.filter(F.col("id") != self.catalog_id).select("path", "content")
        now = bodies.select("path", F.sha2("content", 256).alias("sha256"))
        part = 0 if force else search.next_part(self.spark, path)
        listed = search.current(self.spark.read.parquet(path)).select("path", "sha256").distinct() if part else self.spark.createDataFrame([], "path string, sha256 string")
        diff = session.written(search.index_diff(listed, now), "index-diff")
        fresh = search.chunks(bodies.join(diff.filter("state IN ('new', 'updated')"), "path", "left_semi"))
        fresh = fresh if self.embed is None else search.embedded(fresh, self.embed, self.dimension)
        gone = diff.filter("state = 'removed'").select("path", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fresh.schema.fields[1:]])
        search.write_part(fresh.unionByName(gone), path, part, anew=force or not part)
        return search.update_counts(diff)

    def expected_index(self) -> tuple[vault.Revision, str]:
        seen = vault.read_index(self.root, self.index)
        return seen, graph.replace_catalog(seen.content, graph.render_catalog(self.notes, self.catalog_id))

    def refresh(self) -> bool:
        """Brings the index's catalog up to date; whether it was stale."""
        seen, expected = self.expected_index()
        if expected == seen.content:
            return False
        vault.write_index(self.root, self.index, seen, expected)
        return True

    def check(self) -> int:
        """0 for a sound vault, 3 where the index is stale or links are broken or ambiguous."""
        seen, expected = self.expected_index()
        return 3 if expected != seen.content or not self.graph.issues.isEmpty() else 0


def adapters(spark: SparkSession) -> DataFrame:
    """What each platform's pages are captured by, and how far."""
    structured = {"x", "hacker-news", "reddit", "bluesky"}
    rows = [(p, "structured" if p in structured else "page", "thread" if p in structured else "page") for p in (*PLATFORMS, "signed-in")]
    return spark.createDataFrame(rows, "platform string, lane string, scope string")


def doctor(spark: SparkSession) -> dict[str, str]:
    """Versions that a report of trouble needs."""
    import importlib.util

    optional = {n: str(importlib.util.find_spec(n) is not None) for n in ("yaml", "ahocorasick", "regex", "xxhash")}
    return {"spark": spark.version, "python": sys.version.split()[0], "system": platform.platform(), **optional}
