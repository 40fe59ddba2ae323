"""Files to typed notes and raw links."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import markdown

NOTE_SCHEMA = (
    "scan_ordinal bigint, path string, id string, title string, content string, summary string, searchable_text string, "
    "aliases array<string>, tags array<string>, properties map<string,string>, metadata string, "
    "links array<struct<target:string,line:int,embedded:boolean>>, error string"
)

NAMES = (
    "scan_ordinal", "path", "id", "title", "content", "summary", "searchable_text", "aliases", "tags", "properties", "metadata", "links", "error",
)


def parse_notes(files: DataFrame, on_error: str = "raise", content: bool = True) -> DataFrame:
    """Notes of ``files(scan_ordinal, path, content)``, a row a file.

    A malformed note stops the job; with ``on_error="quarantine"`` it comes out with
    its ``error`` and no other values. Null contents count as empty. ``content=False``
    leaves out the texts, for passes that need metadata and links only.
    """
    if on_error not in ("raise", "quarantine"):
        raise ValueError(on_error)
    links = pa.list_(pa.struct([("target", pa.string()), ("line", pa.int32()), ("embedded", pa.bool_())]))
    text, texts = pa.string(), pa.list_(pa.string())
    types = [pa.int64(), text, text, text, text, text, text, texts, texts, pa.map_(text, text), text, links, text]

    def row(ordinal: int, path: str, body: str | None) -> tuple:
        try:
            n = markdown.parse_note(path, body or "")
        except markdown.NoteError as error:
            if on_error == "raise":
                raise
            return (ordinal, path, *[None] * 10, str(error))
        found = [{"target": t, "line": line, "embedded": e} for t, line, e in n.links]
        shown = (n.content, n.summary, n.searchable) if content else (None, n.summary, None)
        meta = json.dumps(n.metadata, ensure_ascii=False)
        return (ordinal, n.path, n.id, n.title, *shown, n.aliases, n.tags, list(n.properties.items()), meta, found, None)

    def run(batches):
        for batch in batches:
            rows = [row(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], list(NAMES))

    return files.select(F.col("scan_ordinal").cast("bigint"), "path", "content").mapInArrow(run, NOTE_SCHEMA)


def raw_links(notes: DataFrame) -> DataFrame:
    """``(source_ordinal, source_id, source_path, ordinal, target, line, embedded)`` of parsed notes."""
    return notes.select(
        F.col("scan_ordinal").alias("source_ordinal"),
        F.col("id").alias("source_id"),
        F.col("path").alias("source_path"),
        F.posexplode("links").alias("ordinal", "link"),
    ).select("source_ordinal", "source_id", "source_path", "ordinal", "link.*")
