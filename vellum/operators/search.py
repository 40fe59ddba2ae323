"""Keyword and vector search over chunks, the index behind them, and snippets."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.session import written

K1, B = 1.2, 0.75
MAX_HITS = 100
#: Query vectors that a worker holds at a time.
QUERY_BLOCK = 1024
TERM = r"[\p{L}\p{N}]+"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, term, tf, length)``: the inverted index, counted within documents."""
    rows = docs.select(F.col(id_col).alias("doc_id"), terms_of(F.col(text_col)).alias("terms")).filter(F.size("terms") > 0)
    rows = rows.select("doc_id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    return rows.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def bm25(docs: DataFrame, id_col: str, text_col: str, query: str, k: int = 10) -> DataFrame:
    """``(doc_id, score)`` of the ``k`` best documents; ties go by id.

    Texts are cut into terms once; only those of the query leave the scan.
    """
    wanted = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    if not wanted or not 1 <= k <= MAX_HITS:
        raise ValueError("a query needs a term and 1 to 100 hits")
    rows = docs.select(F.col(id_col).alias("doc_id"), terms_of(F.col(text_col)).alias("terms")).filter(F.size("terms") > 0)

    def times(word: str) -> Column:
        return F.size(F.filter("terms", lambda t: t == word))

    counts = [times(w).alias(f"tf_{i}") for i, w in enumerate(wanted)]
    rows = rows.select("doc_id", F.size("terms").alias("length"), *counts)
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(wanted))]
    ).first()
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = float(np.log(1 + (stats["n"] - stats[f"df_{i}"] + 0.5) / (stats[f"df_{i}"] + 0.5)))
        tf = F.col(f"tf_{i}")
        score += F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(stats["mean"])))
    return rows.select("doc_id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(k)


def write_postings(docs: DataFrame, id_col: str, text_col: str, path: str, buckets: int = 64) -> None:
    """The inverted index at ``path``, in folders by a hash of the term, with the corpus' figures beside it."""
    rows = written(postings(docs, id_col, text_col), "postings")
    rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    figures = rows.select("doc_id", "length").distinct().agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).withColumn("buckets", F.lit(buckets))
    figures.write.mode("overwrite").parquet(f"{path}/figures")


def bm25_indexed(spark: SparkSession, path: str, query: str, k: int = 10) -> DataFrame:
    """As :func:`bm25` over an index of :func:`write_postings`: only the folders of the query's terms are read."""
    wanted = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    if not wanted or not 1 <= k <= MAX_HITS:
        raise ValueError("a query needs a term and 1 to 100 hits")
    figures = spark.read.parquet(f"{path}/figures").first()
    asked = spark.createDataFrame([(w,) for w in wanted], "term string").select(F.pmod(F.xxhash64("term"), F.lit(figures["buckets"])).cast("int")).distinct().collect()
    rows = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin([r[0] for r in asked]) & F.col("term").isin(wanted))
    found = {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row a word asked for
    idf = F.create_map(*[F.lit(x) for w in wanted for x in (w, float(np.log(1 + (figures["n"] - found.get(w, 0) + 0.5) / (found.get(w, 0) + 0.5))))])
    part = idf[F.col("term")] * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(figures["mean"])))
    return rows.groupBy("doc_id").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def semantic(index: DataFrame, query: Sequence[float], k: int = 10) -> DataFrame:
    """``(path, sha256, start_pos, score)`` of the ``k`` notes whose best chunk is nearest to the query's vector.

    ``index`` has chunks with an ``embedding``; the score is the cosine, 0 at least. One pass, and
    one aggregate by path with map-side combine.
    """
    if not 1 <= k <= MAX_HITS:
        raise ValueError("1 to 100 hits")
    length = float(np.linalg.norm(query)) or 1.0
    asked = F.array(*[F.lit(float(x) / length) for x in query])
    own = F.transform("embedding", lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(own, F.lit(0.0), lambda s, x: s + x * x))
    product = F.aggregate(F.zip_with(own, asked, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    rows = index.select("path", "sha256", "chunk_no", "start_pos", F.greatest(F.when(size > 0, product / size).otherwise(0.0), F.lit(0.0)).alias("score"))
    best = rows.groupBy("path").agg(F.max_by(F.struct("sha256", "start_pos", "score"), F.struct("score", (-F.col("chunk_no")).alias("first"))).alias("b"))
    return best.select("path", "b.*").orderBy(F.desc("score"), "path").limit(k)


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 10) -> DataFrame:
    """``(query_id, id, score, rank)``: exact cosine neighbours of every query vector among all others.

    Query vectors are held in blocks; every batch of the corpus keeps its own ``k`` best
    for each query, so only those are shuffled.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter("v IS NOT NULL")
    asked = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter("v IS NOT NULL")
    n_blocks = -(-asked.count() // QUERY_BLOCK)
    schema, context, out = "query_id bigint, id bigint, score double", vectors.sparkSession.sparkContext, None
    for block in range(n_blocks):
        held = asked.filter(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == block).orderBy("id").collect()
        if held:
            shared = context.broadcast(([r["id"] for r in held], unit(np.array([r["v"] for r in held], np.float64))))
            part = rows.mapInArrow(_scan(shared, k), schema)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], schema + ", rank int")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length == 0, 1, length)


def _scan(shared, k: int):
    def run(batches):
        ids, held = shared.value
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            m = unit(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, held.shape[1]))
            own = batch.column(0).to_numpy(zero_copy_only=False)
            scores = held @ m.T
            out = ([], [], [])
            for q, row in zip(ids, scores, strict=True):
                row = np.where(own == q, -np.inf, row)
                # everything that ties with the k-th stays, so that ids decide later
                least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                for i in np.flatnonzero((row >= least) & np.isfinite(row)).tolist():
                    out[0].append(q), out[1].append(int(own[i])), out[2].append(float(row[i]))
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["query_id", "id", "score"])

    return run


# --- index maintenance ------------------------------------------------------


def chunks(notes: DataFrame, max_units: int = 3600) -> DataFrame:
    """``(path, sha256, chunk_no, start_pos, chunk)``: texts cut before headings and blank lines."""
    pattern = rf"(?s).{{1,{max_units}}}\z|.{{1,{max_units}}}(?<=\n)(?=#{{1,6}} )|.{{1,{max_units}}}(?<=\n\n)|.{{1,{max_units}}}(?<=\n)|.{{1,{max_units}}}"
    rows = notes.select("path", F.sha2("content", 256).alias("sha256"), F.regexp_extract_all("content", F.lit(pattern), F.lit(0)).alias("parts"))
    ends = F.aggregate("parts", F.array(F.lit(0)), lambda done, p: F.concat(done, F.array(F.element_at(done, -1) + F.length(p))))
    rows = rows.withColumn("starts", ends).select("path", "sha256", "starts", F.posexplode("parts").alias("chunk_no", "chunk"))
    return rows.select("path", "sha256", "chunk_no", F.expr("starts[chunk_no]").alias("start_pos"), "chunk")


def index_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, state)`` of two sets ``(path, sha256)``: new, updated, unchanged or removed."""
    a, b = old.select("path", F.col("sha256").alias("was")), new.select("path", F.col("sha256").alias("now"))
    state = (
        F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "unchanged").otherwise("updated")
    )
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def current(index: DataFrame) -> DataFrame:
    """Of an index written in parts the newest chunks of each note that is still there."""
    newest = index.groupBy("path").agg(F.max("part").alias("part"))
    return index.join(newest, ["path", "part"]).filter("sha256 IS NOT NULL")


def next_part(spark: SparkSession, path: str) -> int:
    """The number of the index's next part; 0 where there is no index."""
    try:
        last = spark.read.parquet(path).agg(F.max("part")).first()[0]
    except AnalysisException:
        return 0
    return 0 if last is None else int(last) + 1


def write_part(rows: DataFrame, path: str, part: int, anew: bool = False) -> None:
    """Chunks as one part of an index, a folder of its own; writing a part again replaces it, ``anew`` replaces all."""
    how = "static" if anew else "dynamic"
    rows.withColumn("part", F.lit(part)).write.mode("overwrite").option("partitionOverwriteMode", how).partitionBy("part").parquet(path)


def update_counts(diff: DataFrame) -> DataFrame:
    def count(*states: str) -> Column:
        return F.count_if(F.col("state").isin(*states))

    return diff.agg(
        count("new").alias("indexed"), count("updated").alias("updated"), count("unchanged").alias("unchanged"),
        count("removed").alias("removed"), count("new", "updated").alias("needs_embedding"),
    )


def embedded(parts: DataFrame, embed: Callable[[Sequence[str]], np.ndarray], dimension: int) -> DataFrame:
    """Chunks with vectors of a pluggable embedder, a batch at a time."""
    schema = parts.schema.simpleString()[7:-1] + ", embedding:array<float>"

    def run(batches):
        for batch in batches:
            vectors = np.asarray(embed(batch.column("chunk").to_pylist()), np.float32).reshape(-1, dimension)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, vectors.size + 1, dimension), pa.int32()), pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], [*batch.schema.names, "embedding"])

    return parts.mapInArrow(run, schema.replace(":", " ", schema.count(":")).replace("array<float>", "array<float>"))


# --- hits -------------------------------------------------------------------


def live_hits(hits: DataFrame, notes: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Hits ``(path, sha256, score)`` whose note still has that content, with the note's columns.

    The threshold is applied here, after the store's top-k. A path that several notes
    bear is no unique match and drops out.
    """
    if not 0 <= min_score <= 1:
        raise ValueError("a score is from 0 to 1")
    now = notes.withColumn("sha256", F.sha2("content", 256))
    once = now.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("path")
    return hits.filter(F.col("score") >= min_score).join(now.join(once, "path", "left_semi"), ["path", "sha256"])


def snippet_offset(body: Column, query: str, chunk_start: Column | None = None) -> Column:
    """Where a hit's snippet begins: its chunk, else the longest query term's first place, else 0 (from 0)."""
    words = sorted({w for w in re.findall(r"[^\W_]{2,}", query.lower())}, key=lambda w: (-len(w), w))
    low = F.lower(body)
    found = F.lit(0)
    for word in reversed(words):
        at = F.locate(word, low)
        found = F.when(at > 0, at - 1).otherwise(found)
    if chunk_start is None:
        return found
    return F.when(chunk_start.between(0, F.length(body)), chunk_start).otherwise(found)


def snippet(body: Column, offset: Column, before: int = 180, after: int = 600) -> Column:
    start = F.greatest(offset - before, F.lit(0))
    end = F.least(offset + after, F.length(body))
    shown = F.trim(F.regexp_replace(F.substr(body, start + 1, end - start), r"\s+", " "))
    return F.concat(F.when(start > 0, "…").otherwise(""), shown, F.when(end < F.length(body), "…").otherwise(""))


def hit_line(body: Column, offset: Column) -> Column:
    head = F.substr(body, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def path_handle(path: str) -> str:
    """The store's handle of a path: lower case, words joined by ``-``, symbols as their code."""
    import regex

    parts = path.lower().replace("___", "/").split("/")
    out = []
    for i, part in enumerate(parts):
        stem, dot, ext = part.rpartition(".") if i == len(parts) - 1 and "." in part[1:] else (part, "", "")
        stem = regex.sub(r"\p{So}+", lambda m: "-".join(f"{ord(c):x}" for c in m.group()), stem)
        out.append(regex.sub(r"[^\p{L}\p{N}$]+", "-", stem).strip("-") + dot + ext)
    return "/".join(p for p in out if p)


def index_location(root: str, cache: str) -> str:
    import hashlib

    return f"{cache.rstrip('/')}/{hashlib.sha256(root.encode()).hexdigest()[:20]}"
