"""Personal information in free text: found, typed and replaced by placeholders.

What reveals a person is estimated from the corpus, as information. The protected
entities are the authors. Names: the terms of author names are counted in all texts, and
how often each stands in a name's form beside a verified term of the other role (given
name or initial, family name). With ``p`` the share of all words that stand so, a term's
disclosure is its pointwise mutual information with that context over the context's own
information, ``1 - log(share) / log(p)``: 0 for a term that stands in names as often as
any word, 1 for one that always does. Author terms from ``DISCLOSURE`` on reveal a
person; ordinary words in nicknames do not. Terms of people who wrote nothing are found
by what they stand beside: a term beside accepted given names (or before accepted family
names, and not, as titles do, before given names), with the same measure. A term that no
text holds is known from its bearer alone and counts half an occurrence. Counts are
exact: pairs are counted as they stand and joined with the terms. The map of terms that
workers hold only spares work; it has bits by the number of terms, ``MAP_BITS`` at most,
and what passes it is verified by joins, also when it is full.

Contact data (email, phone, identity number, street address) has forms, which give
candidates. A value's disclosure is the share of the uncertainty about the author that
it takes away, ``1 - H(author | value) / H(author)``; values below ``SPREAD``, which all
authors use alike, tell nothing of anyone and stay.

Defined results: null and empty fields hold nothing; a value that occurs several times in
a field comes out once for each place; of overlapping values the one that begins first,
then the longer, holds. Positions are code points. Repeated rows each come out; extra
columns are ignored. A handle holds a name where it has both names of the row's author.
People of whose names neither term is an author's are not found.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.lookalikes import skeleton
from vellum.session import written
from vellum.sources.tables import table

#: Disclosure from which a term reveals a person, and from which a value is private.
DISCLOSURE, SPREAD = 0.85, 0.1
#: Bits of the map of terms a term, and at most.
TERM_BITS, MAP_BITS = 64, 1 << 25

_DOT = r"(?:\.| ?\[dot\] ?| ?\(dot\) ?| dot )"
_EMAIL = re.compile(
    rf"[\w.+-]*\w(?: ?[@＠] ?| ?\[at\] ?| ?\(at\) ?| at (?=[\w-]+ dot ))[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w-])"
)
_PHONE = re.compile(
    r"(?<![\w.+/-])(?:"
    r"\+\d{1,3}(?:[ .-]?\(?\d{1,9}\)?){1,6}"
    r"|00\d{2}[ -]\d{2,4}[ -]\d{5,9}"
    r"|\(\d{3}\) ?\d{3}[ -]\d{4}"
    r"|\d{3}-\d{3}-\d{4}"
    r"|0\d{2,4}/\d{6,9}"
    r"|0\d{4} \d{3} ?\d{3}"
    r")(?![\w/-]|\.\d)"
)
_ID = re.compile(
    r"(?<![\w.+/-])(?<!\d )(?:"
    r"[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]"
    r"|\d{3}-\d{2}-\d{4}"
    r"|\d{3}\.\d{3}\.\d{3}-\d{2}"
    r"|\d{8}-?[A-Z]"
    r"|\d{2} \d{6} [A-Z] \d{3}"
    r"|[A-Z]{2}\d{7}"
    r"|\d{11}"
    r")(?![\w/-]|\.\d)"
)
_NAMED = r"(?:[A-Z][\w'’]+[ ]){1,3}"
_TOWN = r"(?:,[ ]?|\n)(?:\d{4,6} )?[A-Z]\w+"
_ADDRESS = re.compile(
    r"(?<![\w.])(?:"
    rf"(?:(?:Flat|Apt\.?|Apartment|Unit) \d+\w?, ?)?\d{{1,4}}[a-z]? {_NAMED}"
    rf"(?:Road|Street|Lane|Avenue|Close|Drive|Court|Way|Place|Terrace|Square|Row|Ave\.|Rd\.|St\.|Ln\.)(?:,? Apt\.? \d+\w?)?{_TOWN}"
    rf"|\d{{1,4}}[a-z]? (?:rue|avenue|boulevard|chemin|place) (?:(?:de la|des|du|de) |d['’])?(?:[A-Z][\w'’]+[ ]){{0,2}}[A-Z][\w'’]+{_TOWN}"
    rf"|[A-Z]\w+(?:straße|strasse|weg|gasse|platz|allee|str\.) \d{{1,4}}[a-z]?{_TOWN}"
    rf"|(?:Calle|Avenida|Via|Viale|Rua|Plaza) {_NAMED}\d{{1,4}}[a-z]?{_TOWN}"
    r")"
)
_FORMS = (("email", _EMAIL), ("street_address", _ADDRESS), ("phone", _PHONE), ("id_number", _ID))
#: A phone number as a handle holds it: digits only, after a word or alone.
_HANDLE_PHONE = re.compile(r"(?:^|(?<=[A-Za-z][_.-]))(?:\+|00)?0?[1-9]\d{8,13}$")
_WORD = re.compile(r"[^\W\d_]+")
#: An initial before a word.
_INITIALED = re.compile(r"(?<![^\W\d_])[^\W\d_]\. (?=[^\W\d_])")
#: Without these no address or number is there; phone and identity numbers have six digits at least, close together.
_MAIL_SIGN, _DIGIT, _LONG = re.compile(r"[@＠]|at\]|at\)| dot "), re.compile(r"\d"), re.compile(r"\d(?:[ .()/-]{0,3}\d){5}")


def _digits(text: str) -> int:
    return sum(c.isdigit() for c in text)


def formed(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of contact data with a form of its own, none overlapping."""
    found = []
    digit = _DIGIT.search(text)
    there = {"email": _MAIL_SIGN.search(text), "street_address": digit, "phone": digit and _LONG.search(text, digit.start())}
    there["id_number"] = there["phone"]
    for kind, form in _FORMS:
        if there[kind]:
            for m in form.finditer(text):
                if kind != "phone" or 9 <= _digits(m.group()) <= 15:
                    found.append((m.start(), m.end(), kind))
    return _apart(found)


def without_mail(text: str) -> str:
    return _EMAIL.sub(" ", text) if _MAIL_SIGN.search(text) else text


def _apart(found: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def folded(word: str) -> str:
    return (word if word.isascii() else skeleton(word)).casefold()


GIVEN, FAMILY, CAPITAL, INITIAL = 1, 2, 4, 8


class Terms:
    """A bitmap of terms by role; ``flags`` may show a role of a term that has none, never miss one."""

    def __init__(self, bits: dict[str, np.ndarray]) -> None:
        self.bits, self.known = bits, {}
        self.plain: set[str] = set()

    def _has(self, role: str, word: str) -> bool:
        place = xxhash.xxh64_intdigest(word.encode(), 42) % (len(self.bits[role]) * 8)  # as xxhash64 of the JVM
        return bool(self.bits[role][place >> 3] >> (place & 7) & 1)

    def flags(self, word: str) -> int:
        """The roles a word may have, whether it begins with a capital, whether it is an initial."""
        known = self.known.get(word)
        if known is None:
            if len(self.known) > 500_000:
                self.known.clear()
                self.plain.clear()
            low, capital = folded(word), word[:1].isupper()
            known = (INITIAL if capital else 0) if len(word) == 1 else GIVEN * self._has("given", low) | FAMILY * self._has("family", low) | CAPITAL * capital
            self.known[word] = known
            if not known & (GIVEN | FAMILY):
                self.plain.add(word)
        return known

    def any(self, words: list[str], roles: int) -> bool:
        """Whether one of the words may have one of the roles; words without any are known at once."""
        return any(self.flags(w) & roles for w in set(words).difference(self.plain))


def pairs_of(text: str, found: list[str], terms: Terms) -> list[tuple[str, str]]:
    """``(given, family)`` of neighbours in a name's form of which one may be a known term; given is empty for an initial.

    ``found`` are the words of the text. A word before a given name comes out as ``(word, None)``.
    """
    flags = terms.flags
    if not terms.any(found, GIVEN | FAMILY) and not _INITIALED.search(text):
        return []
    words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
    out = []
    for at, ((_, end, left), (start, _, right)) in enumerate(zip(words, words[1:], strict=False)):
        gap, a, b = text[end:start], flags(left), flags(right)
        if gap == "-" and at > 0 and out and b & (FAMILY | CAPITAL) and text[words[at - 1][1] : words[at][0]] in (" ", ". ") and out[-1][1] == left:
            out.append((out[-1][0], right))  # the second part of a double name
        elif gap == " ":
            if (a & GIVEN and b & (FAMILY | CAPITAL)) or (a & CAPITAL and b & FAMILY):
                out.append((left, right))
        elif gap == ". " and a & INITIAL and b & (FAMILY | CAPITAL):
            out.append(("", right))
            if at and text[words[at - 1][1] : words[at][0]] == " " and flags(words[at - 1][2]) & (GIVEN | CAPITAL):
                out.append((words[at - 1][2], right))
        elif gap == ", " and a & FAMILY and b & GIVEN:
            out.append((right, left))
        if gap in (" ", ". ") and a & CAPITAL and b & GIVEN:
            out.append((left, None))
    return out


def names(text: str, terms: Terms, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str | None, str, str | None]]:
    """``(start, end, given, family, second)`` of candidate names outside ``taken``; given is None for an initial.

    Forms: Given Family, Given I. Family, I. Family, Family, Given; a family name may be double
    (``second``). Candidates may overlap: which of them hold is told when their terms are verified.
    """
    flags = terms.flags
    if not terms.any(_WORD.findall(text), FAMILY):
        return []
    words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
    out: list[tuple[int, int, str | None, str, str | None]] = []
    edges = [(s, e) for s, e, _ in taken]

    def gap(i: int) -> str:
        return text[words[i][1] : words[i + 1][0]] if 0 <= i < len(words) - 1 else "\0"

    for i, (start, end, word) in enumerate(words):
        if not flags(word) & FAMILY or any(s < end and start < e for s, e in edges):
            continue
        found = []
        if gap(i - 1) == " " and flags(words[i - 1][2]) & GIVEN:
            found.append((words[i - 1][0], words[i - 1][2]))
        elif gap(i - 1) == ". " and flags(words[i - 1][2]) & INITIAL:
            found.append((words[i - 1][0], None))
            if gap(i - 2) == " " and flags(words[i - 2][2]) & GIVEN:
                found.append((words[i - 2][0], words[i - 2][2]))
        second = words[i + 1] if gap(i) == "-" and flags(words[i + 1][2]) & FAMILY else None
        for first, given in found:
            out.append((first, end, given, word, None))
            if second:
                out.append((first, second[1], given, word, second[2]))
        if gap(i) == ", " and flags(words[i + 1][2]) & GIVEN:
            out.append((start, words[i + 1][1], words[i + 1][2], word, None))
    return out


def _roles(rows: DataFrame) -> DataFrame:
    """``(role, term)`` of author names of two words or more; the last is the family name."""
    parts = F.split(F.trim("author"), r"\s+")
    pairs = rows.filter(F.size(parts) >= 2).select(parts[0].alias("g"), F.element_at(parts, -1).alias("f")).distinct()
    both = F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("term")) for r, c in (("given", "g"), ("family", "f"))]))

    @F.pandas_udf(T.StringType())
    def fold(terms: pd.Series) -> pd.Series:
        return terms.map(folded)

    return pairs.select(both).distinct().select("role", fold("term").alias("term")).distinct()


def _bitmap(terms: DataFrame) -> Terms:
    """The map of terms: ``TERM_BITS`` bits a term, at most ``MAP_BITS`` a role."""
    n = terms.count()
    size = min(MAP_BITS, 1 << max(16, (n * TERM_BITS - 1).bit_length()))
    bits = {r: np.zeros(size // 8, np.uint8) for r in ("given", "family")}
    # a row an octet: at most size / 8 rows a role
    places = terms.select("role", F.pmod(F.xxhash64("term"), F.lit(size)).cast("int").alias("place"))
    octets = places.groupBy("role", F.shiftright("place", 3).alias("octet")).agg(F.expr("bit_or(shiftleft(1, place & 7))").alias("bits")).toPandas()
    for role, own in octets.groupby("role"):
        bits[role][own["octet"].to_numpy()] = own["bits"].to_numpy().astype(np.uint8)
    return Terms(bits)


def _counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``(kind, a, b, n)``: how often a word occurs (``seen``), a pair stands as a name (``pair``), a word before a given name (``before``)."""
    shared = texts.sparkSession.sparkContext.broadcast(_bitmap(terms))

    def count(batches):
        known = shared.value
        for batch in batches:
            seen, beside = Counter(), Counter()
            for text in batch.column(0).to_pylist():
                text = without_mail(text)
                words = _WORD.findall(text)
                seen.update(words)
                beside.update(pairs_of(text, words, known))
            rows: Counter = Counter()
            for word, n in seen.items():
                rows["seen", folded(word), ""] += n
            for (a, b), n in beside.items():
                rows[("before", folded(a), "") if b is None else ("pair", folded(a), folded(b))] += n
            keys = list(rows)
            columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([rows[k] for k in keys], pa.int64())], ["kind", "a", "b", "n"])

    counts = texts.filter("text IS NOT NULL").mapInArrow(count, "kind string, a string, b string, n long")
    return written(counts.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")), "name-counts")


def disclosing(rows: DataFrame) -> DataFrame:
    """``(role, term)`` of terms that reveal a person, by their co-occurrence with author terms in all texts."""
    terms = written(_roles(rows), "author-terms")
    counts = _counts(rows.select("text"), terms)
    seen = counts.filter("kind = 'seen'").select(F.col("a").alias("term"), F.col("n").alias("seen"))
    ends = [F.struct(F.lit(r).alias("role"), F.col(c).alias("term"), F.lit(o).alias("other_role"), F.col(d).alias("other")) for r, c, o, d in (("given", "a", "family", "b"), ("family", "b", "given", "a"))]
    sides = counts.filter("kind = 'pair'").select("n", F.inline(F.array(*ends))).filter("term != ''")
    initial = rows.sparkSession.createDataFrame([("given", "")], "other_role string, other string")

    def partnered(known: DataFrame) -> DataFrame:
        """``(role, term, beside)``: how often terms stand in a role beside verified terms of the other, or an initial."""
        firm = known.select(F.col("role").alias("other_role"), F.col("term").alias("other")).unionByName(initial)
        return sides.join(firm, ["other_role", "other"], "left_semi").groupBy("role", "term").agg(F.sum("n").alias("beside"))

    own = written(terms.join(partnered(terms), ["role", "term"], "left").join(seen, "term", "left"), "term-counts")
    words = seen.agg(F.sum("seen")).first()[0] or 0
    standing = own.filter("role = 'family'").agg(F.sum("beside")).first()[0] or 0
    # how many of all words stand in names: the context's own information
    usual = min(max(2 * standing, 1) / max(words, 1), 0.5)

    def disclosing_terms(counted: DataFrame, add: float) -> DataFrame:
        share = F.least((F.coalesce("beside", F.lit(0)) + add) / (F.coalesce("seen", F.lit(0)) + 1), F.lit(1.0))
        return counted.filter(1 - F.ln(share) / float(np.log(usual)) >= DISCLOSURE).select("role", "term")

    accepted = written(disclosing_terms(own, 0.5), "accepted-terms")
    titles = counts.filter("kind = 'before'").select(F.lit("given").alias("role"), F.col("a").alias("term"))
    strangers = partnered(accepted).join(terms.unionByName(titles), ["role", "term"], "left_anti").join(seen, "term", "left")
    return accepted.unionByName(disclosing_terms(strangers, 0.0))


_CANDIDATES = T.StructType(
    [
        T.StructField("field_name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("start_pos", T.IntegerType()),
        T.StructField("end_pos", T.IntegerType()),
        T.StructField("given", T.StringType()),
        T.StructField("family", T.StringType()),
        T.StructField("second", T.StringType()),
        T.StructField("value", T.LongType()),
        T.StructField("uid", T.LongType()),
        T.StructField("who", T.LongType()),
    ]
)


def _in_handle(handle: str, author: str | None) -> list[tuple]:
    m = _EMAIL.fullmatch(handle.strip())
    at = len(handle) - len(handle.lstrip())
    if m:
        return [("handle", "email", at, at + len(m.group()), None, None)]
    found = [("handle", kind, s, e, None, None) for s, e, kind in formed(handle)]
    if not found and (m := _HANDLE_PHONE.search(handle)):
        found = [("handle", "phone", m.start(), m.end(), None, None)]
    if found:
        return found
    parts = (author or "").split()
    if len(parts) >= 2:
        given, family, low = folded(parts[0]), folded(parts[-1]), folded(handle)
        if len(low) == len(handle):
            for a, b in ((given, family), (family, given)):
                i = low.find(a)
                j = low.find(b, i + len(a)) if i >= 0 else -1
                if j >= 0:
                    return [("handle", "name", i, j + len(b), given, family)]
    return []


def _hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def _separate(named: DataFrame) -> DataFrame:
    """Of the verified names of each field those that overlap no earlier one; of one begin the longest."""
    found = F.array_sort(F.collect_list(F.struct("start_pos", (-F.col("end_pos")).alias("until"), "row_id")))
    start = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<struct<start_pos:int,end_pos:int,row_id:{named.schema['row_id'].dataType.simpleString()}>>").alias("kept"))

    def step(s, x):
        own = F.struct(x["start_pos"].alias("start_pos"), (-x["until"]).alias("end_pos"), x["row_id"].alias("row_id"))
        return F.when(x["start_pos"] >= s["end"], F.struct((-x["until"]).alias("end"), F.concat(s["kept"], F.array(own)).alias("kept"))).otherwise(s)

    # a field's own candidates, as many as it has names
    kept = named.groupBy("uid", "field_name").agg(F.aggregate(found, start, step)["kept"].alias("kept"))
    return kept.select("field_name", F.lit("name").alias("kind"), F.inline("kept")).select("row_id", "field_name", "kind", "start_pos", "end_pos")


def _spread(values: DataFrame, rows: DataFrame) -> DataFrame:
    """``(kind, value)`` that take away less than ``SPREAD`` of the uncertainty about the author."""

    def entropy(counts: DataFrame, *keys: str) -> DataFrame:
        return counts.groupBy(*keys).agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("h"))

    who = F.coalesce("author", "handle")
    prior = entropy(rows.filter(who.isNotNull()).groupBy(F.xxhash64(who).alias("who")).agg(F.count(F.lit(1)).alias("n"))).first()["h"] or 0.0
    counts = values.filter("who IS NOT NULL").groupBy("kind", "value", "who").agg(F.count(F.lit(1)).alias("n"))
    return entropy(counts, "kind", "value").filter((F.col("h") > 0) & (F.col("h") > (1 - SPREAD) * prior)).select("kind", "value")


def personal_values(df: DataFrame, id_col: str, text_col: str, handle_col: str, author_col: str) -> DataFrame:
    """``(row_id, field_name, kind, start_pos, end_pos)`` of every value of personal information."""
    rows = df.select(*[F.col(c).alias(n) for c, n in ((id_col, "row_id"), (text_col, "text"), (handle_col, "handle"), (author_col, "author"))])
    terms = written(disclosing(rows), "name-terms")
    shared = df.sparkSession.sparkContext.broadcast(_bitmap(terms))  # MAP_BITS bits a role at most
    schema = T.StructType([rows.schema["row_id"], *_CANDIDATES.fields])

    def run(batches):
        known = shared.value
        for batch in batches:
            owners, found = [], []
            columns = [batch.column(i).to_pylist() for i in range(1, 6)]
            for k, (text, handle, author, uid, who) in enumerate(zip(*columns, strict=True)):
                own = []
                if text:
                    fixed = formed(text)
                    own += [("text", kind, s, e, None, None, None, _hashed("".join(folded(text[s:e]).split()))) for s, e, kind in fixed]
                    for s, e, g, f, second in names(text, known, fixed):
                        own.append(("text", "name", s, e, folded(g) if g else None, folded(f), folded(second) if second else None, None))
                if handle:
                    own += [(*x, None, _hashed(folded(handle))) for x in _in_handle(handle, author)]
                found += [(*x, uid, who) for x in own]
                owners += [k] * len(own)
            arrays = [batch.column(0).take(pa.array(owners, pa.int64()))]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * 3]
            arrays += [pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    numbered = rows.withColumns({"uid": F.monotonically_increasing_id(), "who": F.xxhash64(F.coalesce("author", "handle"))})
    numbered = numbered.withColumn("who", F.when(F.coalesce("author", "handle").isNotNull(), F.col("who")))
    values = written(numbered.mapInArrow(run, schema), "personal-values")
    plain = values.filter("kind != 'name'")
    plain = plain.join(_spread(plain, rows), ["kind", "value"], "left_anti")
    # what the bitmap let pass is verified against the terms themselves; terms are distinct, so no join repeats a row
    named = values.filter("kind = 'name'")
    for column, role in (("family", "family"), ("given", "given"), ("second", "family")):
        firm = terms.filter(F.col("role") == role).select(F.col("term").alias(column), F.lit(True).alias("firm"))
        named = named.join(firm, column, "left").filter(F.col(column).isNull() | F.col("firm")).drop("firm")
    return plain.select("row_id", "field_name", "kind", "start_pos", "end_pos").unionByName(_separate(named))


def _values(spark: SparkSession, folder: str) -> DataFrame:
    return personal_values(table(spark, folder, "captured_entries"), "entry_row_id", "text", "handle", "author_name")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _values(spark, folder).select(F.col("row_id").alias("entry_row_id"), "field_name", "kind", "start_pos")


def p4_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry with placeholders such as ``[EMAIL]`` in place of personal information."""
    entries = table(spark, folder, "captured_entries").select("entry_row_id", "text", "handle")
    spans = _values(spark, folder).groupBy(F.col("row_id").alias("entry_row_id")).agg(
        F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "kind", "field_name"))).alias("spans")
    )
    rows = entries.join(spans, "entry_row_id", "left")

    def own(column: str):
        return F.filter("spans", lambda s: s["field_name"] == column)

    cleaned = {c: replaced(F.col(c), own(c)) for c in ("text", "handle")}
    return rows.select("entry_row_id", *[v.alias(c) for c, v in cleaned.items()])


def replaced(text, spans):
    """``text`` with each of its sorted, separate spans replaced by the placeholder of its kind."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(s, span):
        mark = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        return F.struct(
            span["end_pos"].alias("at"), F.concat(s["done"], F.substr(text, s["at"] + 1, span["start_pos"] - s["at"]), mark).alias("done")
        )

    done = F.aggregate(spans, start, step, lambda s: F.concat(s["done"], F.substr(text, s["at"] + 1, F.length(text))))
    return F.coalesce(done, text)
