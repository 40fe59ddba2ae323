"""Splitting oversized texts at natural boundaries, entirely in JVM expressions.

A text larger than a profile's limit is cut by one regular expression with bounded
quantifiers: its alternatives, strongest boundary first (heading, blank line, line
end, sentence, blank, character), each consume up to the limit. The lengths of the
matches give the cuts; a look back from each cut supplies the overlap.

Defined results: null, empty and fitting texts give no pieces (a text of exactly the
limit fits); repeated rows each give theirs; a text without any boundary is cut at
characters, never inside a code point. Pieces never exceed ``max_size``. Successive
pieces share exactly ``overlap_size`` units; in bytes at most 3 less where that many
bytes would begin inside a character. Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources.tables import table

#: Blanks: what separates words.
BLANK = r"\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Stands for a line end inside fenced code.
_HELD = "\x01"
MAX_PROFILES = 1000


@dataclass(frozen=True)
class Profile:
    profile_id: int
    size_unit: str
    max_size: int
    overlap_size: int

    def __post_init__(self) -> None:
        if self.size_unit not in ("chars", "bytes", "words"):
            raise ValueError(f"profile {self.profile_id}: unknown size unit {self.size_unit!r}")
        if self.overlap_size < 0 or self.step < (4 if self.size_unit == "bytes" else 1):
            raise ValueError(f"profile {self.profile_id}: overlap leaves no room for new text")

    @property
    def step(self) -> int:
        """New units that a piece takes at most, besides its overlap."""
        return self.max_size - self.overlap_size

    @property
    def pattern(self) -> str:
        """Alternatives by falling boundary strength; every one consumes at most ``step`` units."""
        n = self.step
        half, quarter = max(1, n // 2), max(1, n // 4)
        if self.size_unit == "words":
            marks = [f".{{{half},{n}}}(?<={c})" for c in "\x02\x03\x04\x05"]
            return f"(?s).{{1,{n}}}\\z|" + "|".join(marks) + f"|.{{1,{n}}}"
        blank = r"[\s\x01]" if self.size_unit == "bytes" else rf"[{BLANK}\x01]"
        stop = r"[.!?]\s" if self.size_unit == "bytes" else rf"[.!?][{BLANK}]|[\x{{3002}}\x{{FF01}}\x{{FF1F}}]"
        inside = r"[\x{80}-\x{BF}]" if self.size_unit == "bytes" else r"[\p{M}\x{200D}]"
        return "(?s)" + "|".join(
            [
                rf".{{1,{n}}}\z",
                rf".{{{half},{n}}}(?<=\n)(?=#{{1,6}} )",
                rf".{{{half},{n}}}(?<=\n\r?\n)",
                rf".{{{half},{n}}}(?<=\n)",
                rf".{{{half},{n}}}(?<={stop})",
                rf".{{{quarter},{n}}}(?<={blank})",
                rf".{{{quarter},{n}}}(?!{inside})",
                rf".{{1,{n}}}" + (rf"(?!{inside})" if self.size_unit == "bytes" else ""),
            ]
        )


def profiles(df: DataFrame) -> list[Profile]:
    """The profiles of a small parameter table; more than ``MAX_PROFILES`` rows are an error."""
    rows = df.select("profile_id", "size_unit", "max_size", "overlap_size").distinct().limit(MAX_PROFILES + 1).collect()
    if len(rows) > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} split profiles")
    return sorted((Profile(*r) for r in rows), key=lambda p: p.profile_id)


def held(text: Column) -> Column:
    """``text`` with the line ends of fenced code replaced, so that they are no boundary there."""
    state = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast("array<boolean>").alias("inside"))

    def step(s: Column, part: Column) -> Column:
        mark = F.nullif(F.regexp_extract(part, r"^ {0,3}(```|~~~)", 1), F.lit(""))
        within = F.when(mark.isNull(), s["open"].isNotNull()).otherwise(s["open"].isNull() | (s["open"] != mark))
        opened = F.when(mark.isNull() | (s["open"].isNotNull() & (s["open"] != mark)), s["open"]).when(s["open"].isNull(), mark)
        return F.struct(opened.alias("open"), F.concat(s["inside"], F.array(within)).alias("inside"))

    parts = F.split(text, r"(?m)^(?=[ ]{0,3}(?:```|~~~))")
    inside = F.aggregate(parts, state, step)["inside"]
    joined = F.array_join(F.zip_with(parts, inside, lambda p, i: F.when(i, F.translate(p, "\n", _HELD)).otherwise(p)), "")
    return F.when(text.contains("```") | text.contains("~~~"), joined).otherwise(text)


def latin(text: Column) -> Column:
    """UTF-8 bytes of a text, a character for each."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def word_marks(text: Column) -> Column:
    """A mark for each word, telling how strong the boundary after it is.

    The first step leaves one letter for each run of ordinary characters, so that the
    others read a short string.
    """
    text = F.regexp_replace(text, r"[!-\"$-\-/->@-~]+", "w")
    text = F.regexp_replace(text, r"[^\x00-\x7F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", "w")
    text = F.regexp_replace(text, rf"[{BLANK}\x01&&[^ \n]]+", " ")
    text = F.regexp_replace(text, r"[\x00-\x08\x0E-\x1B\x7F]+", "w")
    text = F.regexp_replace(text, "^[ \n]+|[ \n]+$", "")
    text = F.regexp_replace(text, r" *\n[\n ]*(?=#{1,6} )", "\x02")
    text = F.regexp_replace(text, r" *\n *\n[\n ]*", "\x03")
    text = F.regexp_replace(text, r" *\n *", "\x04")
    text = F.regexp_replace(text, r"(?<=[.!?]) +", "\x05")
    text = F.regexp_replace(text, " +", "\x06")
    return F.concat(F.regexp_replace(text, r"[^\x02-\x06]+", ""), F.lit("\x06"))


def cuts(df: DataFrame, id_col: str, text_col: str, known: list[Profile]) -> DataFrame:
    """Each row and profile where the text is too large, with ``steps``: the sizes of its cuts."""
    rows = df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))
    if not known:
        return rows.limit(0).select("row_id", F.lit(0).alias("profile_id"), "text", F.array().cast("array<int>").alias("steps"))
    text, words = F.col("text"), [p.max_size for p in known if p.size_unit == "words"]
    # n words take 2n - 1 characters at least: most texts need no counting
    marks = F.when(F.length("text") > 2 * min(words), word_marks(F.col("held"))) if words else F.lit("")
    size = {"chars": F.length("text"), "bytes": F.octet_length("text"), "words": F.coalesce(F.length("marks"), F.lit(0))}
    fits = F.array(*[F.when(size[p.size_unit] > p.max_size, F.lit(p.profile_id)) for p in known])
    rows = (
        rows.filter(text.isNotNull() & (F.octet_length("text") > min(p.max_size for p in known)))
        .select("row_id", "text", held(text).alias("held"))
        .select("*", marks.alias("marks"))
        .select("*", F.explode_outer(fits).alias("profile_id"))
        .filter(F.col("profile_id").isNotNull())
    )
    subject = {"chars": F.col("held"), "bytes": latin(F.col("held")), "words": F.col("marks")}
    found = F
    for p in known:
        cores = F.regexp_extract_all(subject[p.size_unit], F.lit(p.pattern), F.lit(0))
        found = found.when(F.col("profile_id") == p.profile_id, F.transform(cores, F.length))
    return rows.select("row_id", "profile_id", "text", found.alias("steps"))


def pieces(df: DataFrame, id_col: str, text_col: str, known: list[Profile]) -> DataFrame:
    """``(row_id, profile_id, piece_no, start_pos, n_units, piece)`` of every text over its limit.

    ``start_pos`` counts from 0 in the profile's unit and includes the overlap, as ``n_units``.
    """
    unit, overlap = F, F
    for p in known:
        here = F.col("profile_id") == p.profile_id
        unit, overlap = unit.when(here, F.lit(p.size_unit)), overlap.when(here, F.lit(p.overlap_size))
    ends = F.aggregate(
        "steps",
        F.array(F.lit(0)).cast("array<int>"),
        lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)),
    )
    rows = cuts(df, id_col, text_col, known).select("row_id", "profile_id", unit.alias("unit"), overlap.alias("overlap"), ends.alias("ends"), "text")
    tokens = F.regexp_extract_all("text", F.lit(rf"^[{BLANK}]*[^{BLANK}]+[{BLANK}]*|[^{BLANK}]+[{BLANK}]*"), F.lit(0))
    # code points of four bytes each, bytes, or words: a slice is found by its place and not by walking from the start
    octets = F.when(F.col("unit") == "bytes", F.encode("text", "UTF-8")).when(F.col("unit") == "chars", F.encode("text", "UTF-32"))
    rows = rows.select("row_id", "profile_id", "unit", "overlap", "ends", F.when(F.col("unit") == "words", tokens).alias("words"), octets.alias("octets"))
    # pieces are made inside of the row; only they leave it, not the text
    made = F.transform(F.slice("ends", F.lit(1), F.size("ends") - 1), _piece)
    rows = rows.select("row_id", "profile_id", F.posexplode(made).alias("piece_no", "p"))
    return rows.select("row_id", "profile_id", "piece_no", "p.start_pos", "p.n_units", "p.piece")


def _piece(cut: Column, i: Column) -> Column:
    """The piece from a cut on, with the overlap before it, to the next cut."""
    stop = F.get("ends", i + 1)
    start = F.greatest(cut - F.col("overlap"), F.lit(0))
    # an overlap that would begin inside a character begins after it
    torn = F.length(F.regexp_extract(F.decode(F.substring(F.col("octets"), start + 1, F.lit(3)), "ISO-8859-1"), r"^[\x{80}-\x{BF}]+", 0))
    skipped = F.when(F.col("unit") == "bytes", torn).otherwise(0)
    text = (
        F.when(F.col("unit") == "bytes", F.decode(F.substring(F.col("octets"), start + skipped + 1, stop - start - skipped), "UTF-8"))
        .when(F.col("unit") == "chars", F.decode(F.substring(F.col("octets"), start * 4 + 1, (stop - start) * 4), "UTF-32"))
        .otherwise(F.array_join(F.slice("words", start + 1, stop - start), ""))
    )
    return F.struct((start + skipped).alias("start_pos"), (stop - start - skipped).alias("n_units"), text.alias("piece"))


def _known(spark: SparkSession, folder: str) -> list[Profile]:
    return profiles(table(spark, folder, "split_profiles"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Notes that a profile cuts into several pieces."""
    found = cuts(table(spark, folder, "notes"), "note_row_id", "content", _known(spark, folder))
    return found.filter(F.size("steps") > 1).select(F.col("row_id").alias("note_row_id"), "profile_id")


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every oversized note."""
    return pieces(table(spark, folder, "notes"), "note_row_id", "content", _known(spark, folder)).withColumnRenamed("row_id", "note_row_id")
