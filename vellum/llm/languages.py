"""The language of documents and of the paragraphs of mixed ones, by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is bound from its letters'
vectors, each permuted (rotated) by its place, by multiplication; a text is the sum of its
trigrams. Language prototypes are weighted sums over texts of known label, and a text is
given the language whose prototype has the largest cosine with it. Random vectors are
nearly orthogonal, so a text's length is taken as the root of its squared trigram counts
times the dimension. The product of each trigram with all prototypes is kept in a table,
so that a text costs a look-up and a sum for each letter.

A cosine times the root of the trigrams it rests on is the evidence for a language. A
paragraph differs from its document's main language where its own evidence leads by
``SWITCH``; a document with such a paragraph is mixed, and each of its paragraphs gets the
best of the languages found in it. The confidence is a logistic curve over the lead of the
best evidence over the next. Null, empty and letterless texts have no language and give no
row. Ties go to the language first in the alphabet. Languages are those that labels name: the usual ones
however rare, any other with ``LABELLED`` documents; a label of a rarer one is let stand. Repeated rows each come out.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.sources.tables import table

#: Codes with the names and longer codes that also mean them (fixed values).
LANGUAGES = {
    "da": ("dan", "danish", "dansk"),
    "de": ("deu", "ger", "german", "deutsch"),
    "en": ("eng", "english"),
    "es": ("spa", "spanish", "español", "espanol", "castellano"),
    "fr": ("fra", "fre", "french", "français", "francais"),
    "it": ("ita", "italian", "italiano"),
    "ja": ("jpn", "japanese", "日本語"),
    "nl": ("nld", "dut", "dutch", "nederlands"),
    "pl": ("pol", "polish", "polski"),
    "pt": ("por", "portuguese", "português", "portugues"),
    "ru": ("rus", "russian", "русский"),
    "sv": ("swe", "swedish", "svenska"),
    "uk": ("ukr", "ukrainian", "українська"),
}
#: Other two-letter codes of languages (fixed values, ISO 639-1).
CODES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy dv dz ee el eo et eu fa ff fi fj fo fy ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is iu "
    "jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg mh mi mk ml mn mr ms mt my na nb nd ne ng nn no nr nv ny oc oj om or os pa pi ps qu rm rn ro rw sa sc sd se sg si sk sl sm sn so "
    "sq sr ss st su sw ta te tg th ti tk tl tn to tr ts tt tw ty ug ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()
#: Labelled documents that one of those needs to have a prototype.
LABELLED = 20
DIMENSION = 2048
#: Lead of evidence by which a paragraph leaves its document's main language; evidence a text needs to have one.
SWITCH, LEAST = 1.25, 0.5
#: Steepness of the confidence curve.
STEEP = 3.0
#: Labelled documents that a prototype is fitted on at most, and characters of each that is taken.
TRAIN_DOCS, TRAIN_CHARS = 150, 20_000
#: Letters by character; others of a script share one.
_SPANS = ((0x61, 0x7B), (0xDF, 0x180), (0x430, 0x460), (0x490, 0x492), (0x3041, 0x3097), (0x30A1, 0x30FD))
_SHARED = ((0x4E00, 0xA000), (0x370, 0x400), (0x400, 0x530), (0x590, 0x700), (0xAC00, 0xD7A4), (0x900, 0xE80))


def _letters() -> tuple[np.ndarray, int]:
    """A number for every character below U+10000: 0 for what is no letter."""
    kind = np.zeros(0x10000, np.int32)
    n = 1
    for c in range(0x80, 0x10000):
        if chr(c).isalpha():
            kind[c] = 1
    for a, b in _SHARED:
        n += 1
        kind[a:b] = np.where(kind[a:b] > 0, n, 0)
    for a, b in _SPANS:
        for c in range(a, b):
            if chr(c).isalpha():
                n += 1
                kind[c] = n
    return kind, n + 1


_KIND, _N = _letters()
_BREAK = re.compile(r"\n\s*\n")
_NOISE = re.compile(r"https?://\S+|\S+@\S+")


def label_code(label: Column) -> Column:
    """The two-letter code that a label means, or null: names, three-letter codes and regions count."""
    plain = F.lower(F.trim(label))
    base = F.split_part(F.regexp_replace(plain, "_", "-"), F.lit("-"), F.lit(1))
    codes = {x: code for code, names in LANGUAGES.items() for x in (code, *names)}
    known = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(known[plain], known[base], F.when(base.isin(CODES), base))


def paragraphs(text: str) -> list[str]:
    """The parts between lines of white space only."""
    return [p for p in _BREAK.split(text) if p and not p.isspace()]


@dataclass
class Profiles:
    """Prototypes of languages, with the table of trigram products that grows as trigrams are met."""

    names: list[str]
    prototypes: np.ndarray
    index: np.ndarray = field(default=None, repr=False)
    rows: np.ndarray = field(default=None, repr=False)
    used: int = 1

    def __getstate__(self):
        return self.names, self.prototypes

    def __setstate__(self, state):
        self.names, self.prototypes = state
        self.index, self.rows, self.used = None, None, 1

    def table(self, ids: np.ndarray) -> np.ndarray:
        """Row numbers of the products of trigrams."""
        if self.index is None:
            self.index = np.zeros(_N**3, np.int32)
            self.rows = np.zeros((1 << 15, len(self.names)), np.float32)
        found = self.index[ids]
        if (fresh := found == 0).any():
            new = np.unique(ids[fresh])
            while self.used + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for at in range(0, len(new), 2048):
                part = new[at : at + 2048]
                self.rows[self.used : self.used + len(part)] = bound(part).astype(np.float32) @ self.prototypes.T / DIMENSION**0.5
                self.index[part] = np.arange(self.used, self.used + len(part))
                self.used += len(part)
            found = self.index[ids]
        return found

    def cosines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of each text with every prototype; how many trigrams it has."""
        out, sizes = np.zeros((len(texts), len(self.names)), np.float32), np.zeros(len(texts), np.int64)
        for at, ids, owners in trigrams(texts):
            if not len(ids):
                continue
            rows = self.table(ids)
            firsts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
            own = owners[firsts]
            sums = np.add.reduceat(self.rows[rows], firsts)
            # counts of equal trigrams within a text, for its length
            key = np.sort(owners.astype(np.int64) * (1 << 32) + rows)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            squares = np.bincount(key[starts] >> 32, np.diff(np.r_[starts, len(key)]).astype(np.float64) ** 2)
            out[at + own] = sums / np.sqrt(squares[own])[:, None]
            sizes[at + own] = np.diff(np.r_[firsts, len(owners)])
        return out, sizes

    def evidence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cosines, sizes = self.cosines(texts)
        return cosines * np.sqrt(np.maximum(sizes, 1))[:, None], sizes

    def confidence(self, evidence: np.ndarray, lang: int) -> float:
        others = np.delete(evidence, lang)
        lead = float(evidence[lang] - (others.max() if len(others) else 0))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, STEEP * lead))))

    def judged(self, texts: list[str | None]) -> list[list[tuple[int, str, float]]]:
        """For each text ``(para_no, language, confidence)``: 0 for all of it, 1... only where it is mixed."""
        parts = [paragraphs(t) if t else [] for t in texts]
        flat = [p for ps in parts for p in ps]
        evidence, sizes = self.evidence(flat)
        out, at = [], 0
        for ps in parts:
            own, size = evidence[at : at + len(ps)], sizes[at : at + len(ps)]
            at += len(ps)
            total = own.sum(0) if len(ps) else np.zeros(len(self.names))
            if not size.sum() or total.max() < LEAST:
                out.append([])
                continue
            main = int(total.argmax())
            tops = own.argmax(1)
            found = {main, *(int(t) for t, e in zip(tops, own, strict=True) if e[t] - e[main] > SWITCH)}
            rows = []
            if len(found) > 1:
                among = sorted(found)
                chars = dict.fromkeys(among, 0)
                for k, (e, p) in enumerate(zip(own, ps, strict=True), 1):
                    best = among[int(e[among].argmax())]
                    # a paragraph that tells too little is in the main language
                    best = best if e[best] - e[main] > SWITCH / 4 else main
                    chars[best] += len(p)
                    rows.append((k, self.names[best], self.confidence(e, best)))
                main = max(among, key=lambda x: chars[x])
            share = chars[main] / sum(chars.values()) if rows else 1.0
            out.append([(0, self.names[main], share * max(0.5, self.confidence(total, main))), *rows])
        return out


def letter_vectors() -> np.ndarray:
    return np.random.default_rng(20_24).integers(0, 2, (_N, DIMENSION), np.int8) * 2 - 1


_VECTORS: list[np.ndarray] = []


def bound(ids: np.ndarray) -> np.ndarray:
    """The vectors of trigrams: their letters' vectors rotated by place and multiplied."""
    if not _VECTORS:
        first = letter_vectors()
        _VECTORS.extend([np.roll(first, 2, 1), np.roll(first, 1, 1), first])
    a, b, c = _VECTORS
    return a[ids // (_N * _N)] * b[ids // _N % _N] * c[ids % _N]


def trigrams(texts: list[str], chars: int = 1_000_000):
    """``(first text, ids, owners)`` in blocks: trigrams of letters and single gaps, in order."""
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) < chars):
            size += len(texts[end]) + 2
            end += 1
        part = [_NOISE.sub(" ", t).lower() for t in texts[at:end]]
        codes = np.frombuffer("".join(f" {t} " for t in part).encode("utf-32-le", "replace"), np.uint32)
        owners = np.repeat(np.arange(len(part), dtype=np.int32), [len(t) + 2 for t in part])
        kinds = _KIND[np.where(codes < 0x10000, codes, 0)]
        keep = np.r_[True, (kinds[1:] > 0) | (kinds[:-1] > 0) | (owners[1:] != owners[:-1])]  # a text begins with its own gap
        keep[2:] &= (kinds[2:] == 0) | (kinds[2:] != kinds[1:-1]) | (kinds[2:] != kinds[:-2])  # long runs of a letter are none of a language
        kinds, owners = kinds[keep], owners[keep]
        ids = (kinds[:-2].astype(np.int64) * _N + kinds[1:-1]) * _N + kinds[2:]
        # a lone gap in the middle tells nothing of its own; no trigram spans two texts
        inside = (owners[:-2] == owners[2:]) & (kinds[1:-1] > 0)
        yield at, ids[inside], owners[:-2][inside]
        at = end


def fitted(labelled: list[tuple[str, str]], rounds: int = 2) -> Profiles:
    """Prototypes of labelled texts; texts that their own label does not win are left out the second time."""
    names = sorted({lang for lang, _ in labelled})
    number = {x: i for i, x in enumerate(names)}
    texts, langs = [t for _, t in labelled], np.array([number[x] for x, _ in labelled], np.int64)
    kept = np.ones(len(texts), bool)
    profiles = None
    for _ in range(rounds):
        ids, owners = [], []
        for at, found, own in trigrams(texts):
            ids.append(found)
            owners.append(own + at)
        ids, owners = np.concatenate(ids), np.concatenate(owners)
        use = kept[owners]
        known, place = np.unique(ids[use], return_inverse=True)
        counts = np.zeros((len(names), len(known)))
        np.add.at(counts, (langs[owners[use]], place), 1)
        share = counts / np.maximum(1, counts.sum(1, keepdims=True))
        mean = share.mean(0)
        weight = (share - mean) / np.sqrt(mean + 1e-5)
        prototypes = np.zeros((len(names), DIMENSION), np.float32)
        for at in range(0, len(known), 2048):
            prototypes += weight[:, at : at + 2048].astype(np.float32) @ bound(known[at : at + 2048]).astype(np.float32)
        prototypes /= np.maximum(1e-9, np.linalg.norm(prototypes, axis=1, keepdims=True))
        profiles = Profiles(names, prototypes)
        kept = profiles.cosines(texts)[0].argmax(1) == langs
        for lang in range(len(names)):
            if not kept[langs == lang].any():
                kept |= langs == lang
    return profiles


def training_rows(df: DataFrame, id_col: str, text_col: str, label: Column) -> list[tuple[str, str]]:
    """At most ``TRAIN_DOCS`` labelled texts of each language, drawn by a hash of their ids."""
    rows = df.select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"), label.alias("code"))
    rows = rows.filter(F.col("code").isNotNull() & F.length("text").between(40, TRAIN_CHARS))
    counts = {r["code"]: r["count"] for r in rows.groupBy("code").count().collect()}  # a row a language
    counts = {code: n for code, n in counts.items() if code in LANGUAGES or n >= LABELLED}
    draw, chosen = F.pmod("h", F.lit(1 << 30)), F.lit(False)
    for code, n in counts.items():
        chosen |= (F.col("code") == code) & (draw < int(min(1.0, 3 * TRAIN_DOCS / n) * (1 << 30)))
    order = Window.partitionBy("code").orderBy("h", "text")
    drawn = rows.filter(chosen).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= TRAIN_DOCS)
    return [(r["code"], r["text"]) for r in drawn.orderBy("code", "k").collect()]


def languages(df: DataFrame, id_col: str, text_col: str, profiles: Profiles, *keep: str) -> DataFrame:
    """``(row_id, para_no, lang, confidence)`` and the columns of ``keep``, which must have other names."""
    rows = df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"), *keep)
    fields = [("para_no", T.IntegerType()), ("lang", T.StringType()), ("confidence", T.DoubleType())]
    schema = T.StructType([rows.schema["row_id"], *[T.StructField(n, t) for n, t in fields], *[rows.schema[k] for k in keep]])
    shared = df.sparkSession.sparkContext.broadcast(profiles)  # a vector for each known language

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            judged = shared.value.judged(batch.column(1).to_pylist())
            place = pa.array([i for i, rows in enumerate(judged) for _ in rows], pa.int64())
            flat = [r for rows in judged for r in rows]
            columns = [pa.array([r[k] for r in flat], t) for k, t in enumerate((pa.int32(), pa.string(), pa.float64()))]
            kept = [batch.column(i).take(place) for i in (0, *range(2, batch.num_columns))]
            yield pa.RecordBatch.from_arrays([kept[0], *columns, *kept[1:]], schema.names)

    return rows.mapInArrow(run, schema)


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", label_code(F.col("lang")).alias("label"))
    labelled = training_rows(docs, "doc_id", "text", F.col("label"))
    if not labelled:
        schema = "doc_id bigint, para_no int, lang string, confidence double, label string, judged boolean"
        return spark.createDataFrame([], schema)
    known = sorted({code for code, _ in labelled})
    # a label of a language without a prototype cannot be told wrong
    docs = docs.withColumn("judged", F.col("label").isNull() | F.col("label").isin(known))
    return languages(docs, "doc_id", "text", fitted(labelled), "label", "judged").withColumnRenamed("row_id", "doc_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without a right label (para_no 0) and the paragraphs of mixed documents."""
    wrong = F.col("label").isNull() | (F.col("judged") & (F.col("label") != F.col("lang")))
    return _judged(spark, folder).filter((F.col("para_no") > 0) | wrong).select("doc_id", "para_no", "lang")


def p9_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's language, and every paragraph's of mixed ones, with confidence."""
    return _judged(spark, folder).drop("label", "judged")
