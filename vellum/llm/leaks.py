"""Evaluation passages inside corpus documents.

The n-grams of the test items, as numbers of their normalised words, form a hash set that
every worker holds; the corpus is scanned once. All windows of a batch get a rolling hash
at once, hits in the set are verified word by word, and windows that follow each other in
document and item join into one span, whose text can be cut out.

A word is a run of letters and digits (a combining accent belongs to its letter), case and
accent composition ignored; what stands between words does not count. Items shorter than
the n-gram cannot be found. Null and empty texts hold nothing; an item or passage that is
repeated comes out once per document and item. Extra columns are ignored.

The set is held only up to ``BLOCK_CHARS`` of item text; a larger test set is scanned for
in as many blocks as it takes, with the same result.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.sources.tables import table

#: Consecutive words that make a passage.
N_WORDS = 12
#: Characters of item text whose n-grams a worker holds at a time.
BLOCK_CHARS = 4_000_000
_KEPT_WORDS = 500_000

_MARK = re.compile("[̀-ͯ]")
_PLAIN = re.compile(r"[^\W_]+")
_MARKED = re.compile("(?:[^\\W_]|[̀-ͯ])+")


def words_of(text: str) -> re.Pattern:
    return _MARKED if _MARK.search(text) else _PLAIN


def folded(word: str) -> str:
    return unicodedata.normalize("NFC", word).casefold()


class Grams:
    """The verified hash set of the n-grams of items ``(item_id, text)``."""

    def __init__(self, items: list[tuple[int, str]], n: int = N_WORDS) -> None:
        self.n = n
        self.numbers: dict[str, int] = {}
        self.seen: dict[str, int] = {}
        weight = np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            self.weights = np.cumprod(np.full(n, weight, np.uint64))
        hashes, self.items, self.places, arrays = [], [], [], []
        for item_id, text in items:
            found = [self.numbers.setdefault(folded(w), len(self.numbers) + 1) for w in words_of(text).findall(text)]
            ids = np.array(found, np.uint64)
            if len(ids) >= n:
                hashes.append(self.rolled(ids))
                arrays.append(ids)
                self.items += [(item_id, len(arrays) - 1)] * len(hashes[-1])
                self.places += range(len(hashes[-1]))
        self.arrays = arrays
        hashed = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.order = np.argsort(hashed, kind="stable")
        self.hashes = hashed[self.order]

    def rolled(self, ids: np.ndarray) -> np.ndarray:
        windows = len(ids) - self.n + 1
        out = np.zeros(max(0, windows), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.n if windows > 0 else 0):
                out += ids[k : k + windows] * self.weights[k]
        return out

    def number(self, word: str) -> int:
        if len(self.seen) > _KEPT_WORDS:
            self.seen.clear()
        return self.seen.setdefault(word, self.numbers.get(folded(word), 0))

    def ids(self, text: str) -> list[int]:
        known = self.seen
        return [known[w] if w in known else self.number(w) for w in words_of(text).findall(text)]

    def spans(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """``(index of the text, item_id, first word, words)`` of every passage."""
        flat: list[int] = []
        starts = []
        for text in texts:
            starts.append(len(flat))
            if text:
                flat += self.ids(text)
            flat += [0]
        ids, begins = np.array(flat, np.uint64), np.array(starts)
        rolled = self.rolled(ids)
        if not len(self.hashes) or not len(rolled):
            return []
        left = np.searchsorted(self.hashes, rolled, "left")
        hits = np.flatnonzero(self.hashes[np.minimum(left, len(self.hashes) - 1)] == rolled)
        runs: dict[tuple[int, int, int], list[int]] = {}
        for at in hits.tolist():
            doc = int(np.searchsorted(begins, at, "right")) - 1
            k = int(left[at])
            while k < len(self.hashes) and self.hashes[k] == rolled[at]:
                gram = int(self.order[k])
                (item, array), place = self.items[gram], self.places[gram]
                if np.array_equal(ids[at : at + self.n], self.arrays[array][place : place + self.n]):
                    runs.setdefault((doc, item, at - place), []).append(at - starts[doc])
                k += 1
        out = []
        for (doc, item, _), ats in runs.items():
            ats.sort()
            first = last = ats[0]
            for at in ats[1:]:
                if at != last + 1:
                    out.append((doc, item, first, last - first + self.n))
                    first = at
                last = at
            out.append((doc, item, first, last - first + self.n))
        return sorted(out)


def _blocks(items: DataFrame, id_col: str, text_col: str) -> list[list[tuple[int, str]]]:
    """Item texts in blocks of about ``BLOCK_CHARS``, one read at a time."""
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter("t IS NOT NULL")
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    for b in range(n):
        yield [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).orderBy("i").collect()]


def leak_spans(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, n: int = N_WORDS) -> DataFrame:
    """``(doc_id, item_id, first_word, n_words, start_pos, end_pos)`` of every passage of an item in a document.

    Positions are code points of the text; the end is exclusive.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
    schema = T.StructType(
        [rows.schema["doc_id"], T.StructField("item_id", items.schema[item_id].dataType)]
        + [T.StructField(c, T.IntegerType()) for c in ("first_word", "n_words", "start_pos", "end_pos")]
    )

    def scan(grams):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                keys, texts = batch.column(0), batch.column(1).to_pylist()
                found = []
                for doc, item, first, count in grams.value.spans(texts):
                    text = texts[doc]
                    places = [m.span() for m in words_of(text).finditer(text)]
                    found.append((doc, item, first, count, places[first][0], places[first + count - 1][1]))
                columns = list(zip(*found, strict=True)) or [()] * 6
                arrays = [keys.take(pa.array(columns[0], pa.int64()))]
                arrays += [pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

        return run

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in schema.fields[1:]]
    out = None
    for block in _blocks(items, item_id, item_text):
        grams = docs.sparkSession.sparkContext.broadcast(Grams(block, n))
        part = rows.mapInArrow(scan(grams), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "eval_items")
    return leak_spans(docs, "doc_id", "text", items, "item_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _spans(spark, folder).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Every passage with its place in the document."""
    return _spans(spark, folder)


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold passages, with the passages cut out of their texts."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    spans = _spans(spark, folder).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start_pos", "end_pos"))).alias("spans"))
    return without_spans(docs.join(spans, "doc_id"))


def without_spans(docs: DataFrame) -> DataFrame:
    """``text`` without its sorted, possibly overlapping ``spans``."""
    nothing = F.struct(F.lit(0).alias("at"), F.lit("").alias("kept"))

    def step(state, span):
        upto = F.greatest(state["at"], span["start_pos"])
        kept = F.concat(state["kept"], F.substr("text", state["at"] + 1, upto - state["at"]))
        return F.struct(F.greatest(state["at"], span["end_pos"]).alias("at"), kept.alias("kept"))

    cut = F.aggregate("spans", nothing, step, lambda s: F.concat(s["kept"], F.substr("text", s["at"] + 1, F.length("text"))))
    return docs.select("doc_id", cut.alias("text"), F.size("spans").alias("n_spans"))
