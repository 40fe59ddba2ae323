"""The explicit link graph of a vault: resolution, edges, degrees, issues, orphans, mentions, catalog.

Notes have ``scan_ordinal, path, id`` (``title``, ``aliases``, ``searchable_text`` for
mentions and the catalog); raw links are as of :func:`vellum.operators.notes.raw_links`.
Nothing is collected per note: backlinks and candidates are rows.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from functools import cached_property
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import markdown, paths
from vellum.session import written

#: Characters of phrases that one automaton holds; more phrases are matched in more passes.
PHRASE_BLOCK_CHARS = 20_000_000
MIN_PHRASE = 4


def icu(column: Column | str) -> Column:
    """The locale-aware order of paths and titles."""
    return F.collate(F.col(column) if isinstance(column, str) else column, "UNICODE")


def resolved_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Every link with ``kind`` (note, broken, ambiguous, attachment), ``target_id`` and ``n_candidates``.

    An empty address is the source itself; a path with another extension is an
    attachment; then a relative path, the exact id, and for bare names the only note
    with that last path part. A name that several notes bear is ambiguous.
    """
    links = links.withColumn("address", paths.link_address(F.col("target")))
    links = links.withColumn("bare", F.regexp_replace(paths.without_markdown_extension(F.col("address")), "^/", ""))
    bare = F.col("bare")
    relative = F.when(bare.startswith("."), paths.joined(paths.dirname(F.col("source_id")), bare))
    links = links.withColumn("wanted", F.coalesce(relative, bare)).withColumn("relative", relative.isNotNull())
    # wrong in no case: at most one row an id and a row a name, so neither join repeats a link
    ids = notes.select(F.col("id").alias("wanted")).distinct().withColumn("known", F.lit(True))
    names = notes.select(paths.basename(F.col("id")).alias("wanted"), "id").distinct()
    names = names.groupBy("wanted").agg(F.count(F.lit(1)).alias("bearers"), F.min("id").alias("only"))
    bare_name = ~F.col("relative") & ~F.col("wanted").contains("/")
    found = links.join(ids, "wanted", "left").join(names, "wanted", "left")
    bearers = F.when(bare_name, F.coalesce("bearers", F.lit(0))).otherwise(0)
    kind = (
        F.when(F.col("address") == "", "note")
        .when(paths.is_attachment(F.col("address")), "attachment")
        .when(F.col("known"), "note")
        .when(bearers == 1, "note")
        .when(bearers > 1, "ambiguous")
        .otherwise("broken")
    )
    target = F.when(F.col("address") == "", F.col("source_id")).when(F.col("known"), F.col("wanted")).otherwise(F.col("only"))
    found = found.withColumn("kind", kind)
    return found.withColumns(
        {
            "target_id": F.when(F.col("kind") == "note", target),
            "n_candidates": F.when(F.col("kind") == "ambiguous", bearers).otherwise(0).cast("bigint"),
        }
    ).drop("address", "bare", "relative", "known", "bearers", "only", "wanted")


def edges(resolved: DataFrame, catalog_id: str = "index") -> DataFrame:
    """``(source_id, source, target_id, target, line)``: the first link of each pair, self and catalog links left out."""
    kept = resolved.filter(
        (F.col("kind") == "note") & (F.col("source_id") != F.col("target_id")) & (F.col("source_id") != catalog_id) & (F.col("target_id") != catalog_id)
    )
    first = F.min(F.struct("source_ordinal", "ordinal", "line", "source_path")).alias("first")
    return (
        kept.groupBy("source_id", "target_id")
        .agg(first)
        .select("source_id", F.col("first.source_path").alias("source"), "target_id", F.concat("target_id", F.lit(".md")).alias("target"), "first.line")
    )


def degrees(notes: DataFrame, edge_rows: DataFrame, catalog_id: str = "index") -> DataFrame:
    """``(id, path, inbound, outbound)`` of every content note."""
    ends = edge_rows.select(
        F.inline(
            F.array(
                F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            )
        )
    )
    counts = ends.groupBy("id").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound"))
    content = notes.filter(F.col("id") != catalog_id).select("id", "path")
    return content.join(counts, "id", "left").fillna(0, ["inbound", "outbound"])


def issues(resolved: DataFrame) -> DataFrame:
    """``(kind, source, line, target, n_candidates)`` of broken and ambiguous links."""
    found = resolved.filter(F.col("kind").isin("broken", "ambiguous"))
    return found.select("kind", F.col("source_path").alias("source"), "line", "target", "n_candidates")


def candidates(issue_rows: DataFrame, notes: DataFrame) -> DataFrame:
    """The notes that an ambiguous target may mean, a row each: ``(source, line, target, candidate)``."""
    names = notes.select(paths.basename(F.col("id")).alias("name"), F.col("id").alias("candidate")).distinct()
    name = F.regexp_replace(paths.without_markdown_extension(paths.link_address(F.col("target"))), "^/", "")
    open_rows = issue_rows.filter("kind = 'ambiguous'").withColumn("name", name)
    return open_rows.join(names, "name").select("source", "line", "target", "candidate")


def orphans(notes: DataFrame, edge_rows: DataFrame, suggest: Column | None = None, catalog_id: str = "index") -> DataFrame:
    """Paths of content notes without any edge; ``suggest`` limits them."""
    linked = edge_rows.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    content = notes.filter(F.col("id") != catalog_id)
    content = content if suggest is None else content.filter(suggest)
    return content.join(linked, "id", "left_anti").select("path")


def phrases(notes: DataFrame) -> DataFrame:
    """``(lower, phrase, target_id, target)``: titles and aliases that one note alone bears."""
    said = F.explode(F.array_distinct(F.transform(F.concat(F.array("title"), F.coalesce("aliases", F.array())), paths.trim)))
    rows = notes.select(F.col("id").alias("target_id"), F.col("path").alias("target"), said.alias("phrase"))
    rows = rows.filter((F.length("phrase") >= MIN_PHRASE) & F.col("phrase").rlike("[A-Za-z]")).withColumn("lower", F.lower("phrase"))
    ends = [f("target_id").alias(n) for n, f in (("a", F.min), ("b", F.max))]
    one = rows.groupBy("lower").agg(*ends, F.min(F.struct("target_id", "target", "phrase")).alias("one")).filter("a = b")
    return one.select("lower", "one.phrase", "one.target_id", "one.target")


def mentions(notes: DataFrame, edge_rows: DataFrame, suggest: Column | None = None, catalog_id: str = "index") -> DataFrame:
    """``(source, line, target, phrase)``: notes named in another's prose without a link either way.

    Of a target's phrases the longest that occurs counts, at its first whole-word place.
    """
    import ahocorasick

    content = notes.filter(F.col("id") != catalog_id)
    content = content if suggest is None else content.filter(suggest)
    known = phrases(content)
    total = known.agg(F.sum(F.length("lower"))).first()[0] or 0
    n_blocks = -(-total // PHRASE_BLOCK_CHARS)
    texts = content.select(F.col("id").alias("source_id"), F.col("path").alias("source"), F.col("searchable_text").alias("text"))
    schema = "source_id string, source string, line int, target_id string, target string, phrase string"
    context = notes.sparkSession.sparkContext
    out = None
    for block in range(n_blocks):
        rows = known.filter(F.pmod(F.xxhash64("lower"), F.lit(n_blocks)) == block).collect()  # PHRASE_BLOCK_CHARS at most
        if not rows:
            continue
        shared = context.broadcast([tuple(r) for r in rows])
        part = texts.mapInArrow(_mention_scanner(shared, ahocorasick), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return notes.sparkSession.createDataFrame([], "source string, line int, target string, phrase string")
    # over the blocks, the longest phrase of a pair
    best = out.groupBy("source_id", "target_id").agg(
        F.min(F.struct((-F.length("phrase")).alias("n"), F.lower("phrase").alias("l"), "source", "line", "target", "phrase")).alias("m")
    )
    pair = [F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")]
    linked = edge_rows.select(*pair).distinct()
    return best.select("m.*", *pair).join(linked, ["a", "b"], "left_anti").select("source", "line", "target", "phrase")


#: The automata that a worker has built, by a name for their phrases; those of earlier queries leave.
_MACHINES: dict[str, object] = {}


def _machine(name: str, shared, ahocorasick):
    if name not in _MACHINES:
        while len(_MACHINES) > 3:
            _MACHINES.pop(next(iter(_MACHINES)))
        machine = ahocorasick.Automaton()
        for lower, phrase, target_id, target in shared.value:
            machine.add_word(lower, (lower, phrase, target_id, target))
        machine.make_automaton()
        _MACHINES[name] = machine
    return _MACHINES[name]


def _mention_scanner(shared, ahocorasick):
    name = uuid.uuid4().hex

    def run(batches):
        machine = _machine(name, shared, ahocorasick)
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            found = []
            for source_id, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                best: dict[str, tuple] = {}
                low = (text or "").lower()
                for end, (lower, phrase, target_id, target) in machine.iter(low):
                    start = end - len(lower) + 1
                    if target_id == source_id or not _whole(low, start, end + 1, lower):
                        continue
                    order = (-len(lower), lower, start)
                    if target_id not in best or order < best[target_id][0]:
                        best[target_id] = (order, phrase, target)
                for target_id, (order, phrase, target) in best.items():
                    found.append((source_id, source, text.count("\n", 0, order[2]) + 1, target_id, target, phrase))
            columns = list(zip(*found, strict=True)) or [()] * 6
            names = ["source_id", "source", "line", "target_id", "target", "phrase"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def _alnum(char: str) -> bool:
    return char.isascii() and char.isalnum()


def _whole(text: str, start: int, end: int, phrase: str) -> bool:
    before = start == 0 or not (_alnum(phrase[0]) and _alnum(text[start - 1]))
    return before and (end == len(text) or not (_alnum(phrase[-1]) and _alnum(text[end])))


# --- catalog ----------------------------------------------------------------

CATALOG_START, CATALOG_END = "<!-- catalog:start -->", "<!-- catalog:end -->"
_CONTROL = re.compile(f"[\\x00-\\x1f\\x7f-\\x9f{chr(0x61C)}{chr(0x200E)}{chr(0x200F)}{chr(0x2028)}-{chr(0x202E)}{chr(0x2066)}-{chr(0x2069)}]")


def safe_text(text: str, limit: int) -> str:
    """Text that cannot break the catalog's markers, links or lines."""
    text = _CONTROL.sub(" ", markdown.concise(text, limit))
    for bad, good in (("<!--", "‹!--"), ("-->", "--›"), ("|", " — "), ("]]", "]")):
        text = text.replace(bad, good)
    return " ".join(text.split())


def section_title(folder: str) -> str:
    return " ".join(part[:1].upper() + part[1:] for part in folder.split("-"))


def catalog_line(note_id: str, title: str, summary: str, properties: dict[str, str] | None) -> str:
    properties = properties or {}
    status = f"Status: {safe_text(properties['status'], 60)}." if properties.get("type") == "plan" and "status" in properties else ""
    details = " ".join(x for x in (status, safe_text(summary or "", 180)) if x)
    label = safe_text(title, 240) or safe_text(note_id.rpartition("/")[2], 240) or "Untitled"
    target = "/".join(quote(part, safe="!~*'()") for part in note_id.split("/"))
    return f"- [[{target}|{label}]]" + (f" — {details}" if details else "")


def catalog_rows(notes: DataFrame, catalog_id: str = "index") -> DataFrame:
    """``(section, id, title, line)`` of every content note; a section is the first path part."""

    @F.pandas_udf(T.StringType())
    def line(ids: pd.Series, titles: pd.Series, summaries: pd.Series, properties: pd.Series) -> pd.Series:
        rows = zip(ids, titles, summaries, properties, strict=True)
        return pd.Series([catalog_line(i, t or "", s, dict(p) if p is not None else None) for i, t, s, p in rows], dtype=object)

    section = F.when(F.col("id").contains("/"), F.substring_index("id", "/", 1)).otherwise("Notes")
    return notes.filter(F.col("id") != catalog_id).select(section.alias("section"), "id", "title", line("id", "title", "summary", "properties").alias("line"))


def render_catalog(notes: DataFrame, catalog_id: str = "index") -> str:
    """The managed block of the index; its lines are streamed in order, as the file is one anyway."""
    rows = catalog_rows(notes, catalog_id).orderBy(icu("section"), icu("title"), icu("id")).select("section", "line")
    out, current = [CATALOG_START, "## Note catalog", ""], None
    for row in rows.toLocalIterator(prefetchPartitions=True):
        if row["section"] != current:
            out += [""] if current is not None else []
            current = row["section"]
            out += [f"### {safe_text(section_title(current), 120) or 'Notes'}", ""]
        out.append(row["line"])
    out += ["", CATALOG_END] if current is not None else ["_No durable notes have been filed yet._", "", CATALOG_END]
    return "\n".join(out)


def replace_catalog(index: str, catalog: str) -> str:
    """The index with its managed block replaced, or appended where there is none."""
    starts, ends = index.count(CATALOG_START), index.count(CATALOG_END)
    if not starts and not ends:
        return f"{index.rstrip()}\n\n{catalog}\n"
    a, b = index.find(CATALOG_START), index.find(CATALOG_END)
    if starts != 1 or ends != 1 or b < a:
        raise ValueError("the managed block of the index is malformed or repeated")
    return index[:a] + catalog + index[b + len(CATALOG_END) :]


# --- all of it --------------------------------------------------------------


@dataclass
class Analysis:
    """Lazy views of one vault; each is computed only when it is used."""

    notes: DataFrame
    links: DataFrame
    catalog_id: str = "index"
    suggest: Column | None = None

    @cached_property
    def resolved(self) -> DataFrame:
        return resolved_links(self.links, self.notes)

    @cached_property
    def edges(self) -> DataFrame:
        return edges(self.resolved, self.catalog_id)

    @property
    def backlinks(self) -> DataFrame:
        return self.edges.select("target", "source", "line").orderBy(icu("target"), icu("source"), "line")

    @property
    def degrees(self) -> DataFrame:
        return degrees(self.notes, self.edges, self.catalog_id)

    @property
    def issues(self) -> DataFrame:
        """Broken and ambiguous links in the order of source, line and target."""
        return issues(self.resolved).orderBy(icu("source"), "line", icu("target"))

    @property
    def connections(self) -> DataFrame:
        """Content notes with their degrees, in the order of their paths."""
        return self.degrees.orderBy(icu("path"))

    @property
    def orphans(self) -> DataFrame:
        return orphans(self.notes, self.edges, self.suggest, self.catalog_id)

    @property
    def mentions(self) -> DataFrame:
        return mentions(self.notes, self.edges, self.suggest, self.catalog_id).orderBy(icu("source"), "line", icu("target"))

    def summary(self) -> DataFrame:
        """A row a count; the links are resolved once."""
        count = F.count(F.lit(1))
        resolved = written(self.resolved.select("kind", "source_id", "source_path", "source_ordinal", "ordinal", "line", "target", "target_id", "n_candidates"), "graph-links")
        pairs, open_links = edges(resolved, self.catalog_id), issues(resolved)
        parts = {
            "notes": self.notes.filter(F.col("id") != self.catalog_id).agg(count.alias("n")),
            "edges": pairs.agg(count.alias("n")),
            "broken": open_links.agg(F.count_if(F.col("kind") == "broken").alias("n")),
            "ambiguous": open_links.agg(F.count_if(F.col("kind") == "ambiguous").alias("n")),
            "orphans": orphans(self.notes, pairs, self.suggest, self.catalog_id).agg(count.alias("n")),
        }
        rows = None
        for name, part in parts.items():
            part = part.select(F.lit(name).alias("what"), "n")
            rows = part if rows is None else rows.unionByName(part)
        return rows
