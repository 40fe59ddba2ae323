"""Note look-up and bounded traversal of the explicit graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import paths
from vellum.operators.graph import icu
from vellum.session import written

MAX_DEPTH, MAX_NODES = 10, 1000


@dataclass(frozen=True)
class Lookup:
    kind: str  # found, ambiguous or missing
    path: str | None = None
    candidates: tuple[str, ...] = ()


def lookup_note(notes: DataFrame, query: str, limit: int = MAX_NODES) -> Lookup:
    """The note a query means: its id, else its id but for case, else a label of one note only.

    Labels are the last path part, the title and the aliases. At most ``limit``
    candidates of an ambiguous query are listed.
    """
    text = query.strip()
    one = notes.sparkSession.range(1)
    address = F.regexp_replace(F.regexp_replace(paths.percent_decoded(F.lit(text)), r"\\", "/"), "^/+", "")
    wanted = one.select(paths.without_markdown_extension(paths.normalized(address)).alias("w"), (address == "").alias("blank")).first()
    if wanted["blank"]:
        return Lookup("missing")
    note_id = wanted["w"]
    exact = notes.filter(F.col("id") == note_id).orderBy("scan_ordinal").select("path").limit(1).collect()
    if exact:
        return Lookup("found", exact[0]["path"])

    def outcome(rows: DataFrame) -> Lookup | None:
        found = [r["path"] for r in rows.select("path").orderBy(icu("path")).limit(limit + 1).collect()]
        if not found:
            return None
        return Lookup("found", found[0]) if len(found) == 1 else Lookup("ambiguous", None, tuple(found[:limit]))

    by_case = outcome(notes.filter(F.lower("id") == note_id.lower()))
    if by_case:
        return by_case
    labels = F.concat(F.array(paths.basename(F.col("id")), F.col("title")), F.coalesce("aliases", F.array().cast("array<string>")))
    asked = {text.lower(), note_id.rpartition("/")[2].lower()}
    return outcome(notes.filter(F.exists(labels, lambda x: F.lower(x).isin(*asked)))) or Lookup("missing")


@dataclass(frozen=True)
class Neighborhood:
    nodes: DataFrame  # path, distance, position: nearest first, in the order of admission
    edges: DataFrame  # source, target, line, in that order
    truncated: bool


def neighborhood(notes: DataFrame, edges: DataFrame, start: str, direction: str = "both", depth: int = 1, limit: int = 50) -> Neighborhood:
    """Notes within ``depth`` links of ``start``, ``limit`` at most, nearest first.

    A level joins the frontier (``limit`` rows at most) with the edges in the cluster. New
    notes are admitted in the order frontier, source, target, line; beyond the limit they
    are left out and the result is truncated. Every edge met on the way between admitted
    notes comes out.
    """
    if direction not in ("in", "out", "both"):
        raise ValueError(direction)
    if not 1 <= depth <= MAX_DEPTH or not 1 <= limit <= MAX_NODES:
        raise ValueError(f"depth is 1 to {MAX_DEPTH}, limit 1 to {MAX_NODES}")
    spark = notes.sparkSession
    known = notes.select(F.col("path").alias("neighbor")).distinct()
    steps = []
    if direction in ("out", "both"):
        steps.append(edges.select(F.col("source").alias("path"), F.col("target").alias("neighbor"), "source", "target", "line"))
    if direction in ("in", "both"):
        steps.append(edges.select(F.col("target").alias("path"), F.col("source").alias("neighbor"), "source", "target", "line"))
    # written once: the levels read it, the links are not resolved again for each
    moves = written((steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1])).join(known, "neighbor", "left_semi"), "graph-moves")

    distance, visited, frontier, truncated = {start: 0}, [], [start], False
    for level in range(1, depth + 1):
        if not frontier:
            break
        visited += frontier
        rank = spark.createDataFrame([(p, i) for i, p in enumerate(sorted(frontier))], "path string, rank int")
        seen = spark.createDataFrame([(p,) for p in distance], "neighbor string")
        fresh = moves.join(F.broadcast(rank), "path").join(F.broadcast(seen), "neighbor", "left_anti")
        first = fresh.groupBy("neighbor").agg(F.min(F.struct("rank", icu("source").alias("s"), icu("target").alias("t"), "line")).alias("o"))
        room = limit - len(distance)
        new = [r["neighbor"] for r in first.orderBy("o").limit(room + 1).collect()]
        truncated |= len(new) > room
        frontier = new[:room]
        distance |= dict.fromkeys(frontier, level)
    nodes = spark.createDataFrame([(p, d, i) for i, (p, d) in enumerate(distance.items())], "path string, distance int, position int")  # limit rows at most
    expanded = spark.createDataFrame([(p,) for p in visited], "path string")
    inside = F.broadcast(nodes.select(F.col("path").alias("neighbor")))
    used = moves.join(F.broadcast(expanded), "path", "left_semi").join(inside, "neighbor", "left_semi")
    return Neighborhood(nodes, used.select("source", "target", "line").distinct().orderBy(icu("source"), icu("target"), "line"), truncated)
