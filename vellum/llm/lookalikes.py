"""One form for texts that look the same: skeletons of look-alike characters.

A text is decomposed, every character replaced by its prototype from a look-alike table
and decomposed again. The table takes width variants, styled letters, joined letters and
Roman numerals from the Unicode data, and lists the twins of Latin letters in other
scripts; blanks and hyphens become one, invisible characters nothing. Texts with equal
skeletons look the same. Different printable ASCII characters keep different skeletons,
as do texts that differ in case, word or punctuation.

Defined results: a null text has a null skeleton and looks like nothing; rows without an
id are left out, as no pair could name them; an empty text
looks like a text of invisible characters only; exact copies are one form, whose rows are
listed but not paired with each other. Ties have no order to break. Extra columns are
ignored. Texts are read whole.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.session import written
from vellum.sources.tables import table

#: Prototypes (fixed values). Each line: characters of one script, then what they look like, in order.
_TWINS = (
    ("АВЕЅІЈКМНОРСТХУԌԚԜӀԀҮ", "ABESIJKMHOPCTXYGQWIDY"),
    ("асеһіјорѕхуԁԛԝѵӏү", "acehijopsxydqwvly"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺ", "ABEZHIKMNOPTYXCM"),
    ("αινορυγϲϳ", "aivopuycj"),
    ("ՕՍՏԼօսհոցզյ", "OUSLouhngqj"),
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),
    ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),
    ("ⲂⲤⲈⲎⲒⲔⲘⲚⲞⲢⲦⲬ", "BCEHIKMNOPTX"),
    ("ıɡɑℓ", "igal"),
)
_HYPHENS = [0x2010, 0x2011, 0x2043, 0xFE63, 0xFF0D]
_BLANKS = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
_INVISIBLE = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFEFF, 0xFFA0]
_INVISIBLE += [*range(0x180B, 0x1810), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070)]
_INVISIBLE += [*range(0xFE00, 0xFE10), *range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)]
#: Kinds of compatibility forms that look like their plain letters.
_LOOKING = ("<wide>", "<narrow>", "<noBreak>", "<font>")


def _table() -> dict[int, str]:
    out = {c: "" for c in _INVISIBLE}
    for c in range(0x80, 0x30000):
        kind, _, rest = unicodedata.decomposition(chr(c)).partition(" ")
        joined = kind == "<compat>" and (0xFB00 <= c <= 0xFB4F or 0x2160 <= c <= 0x217F or chr(c) in "ĲĳŉǄǅǆǇǈǉǊǋǌǱǲǳ…‥")
        if kind in _LOOKING or joined:
            out[c] = "".join(chr(int(x, 16)) for x in rest.split())
    out |= dict.fromkeys(_BLANKS, " ") | dict.fromkeys(_HYPHENS, "-")
    for twins, plain in _TWINS:
        out |= {ord(a): b for a, b in zip(twins, plain, strict=True)}
    # a prototype may itself have one
    return {k: "".join(out.get(ord(x), x) for x in v) for k, v in out.items()}


TABLE = _table()


def skeleton(text: str | None) -> str | None:
    """Equal for texts that look the same; idempotent."""
    if text is None or text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(TABLE))


def uniform(text: str | None) -> str | None:
    """The readable form: the skeleton, composed."""
    shape = skeleton(text)
    return shape if shape is None else unicodedata.normalize("NFC", shape)


def skeletons(df: DataFrame, id_col: str, text_col: str, source: str = "") -> DataFrame:
    """``(tbl, row_id, text, skeleton)`` of every row with a text. ASCII texts stay in the JVM."""
    rows = df.select(F.lit(source).alias("tbl"), F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))
    rows = rows.filter("text IS NOT NULL AND row_id IS NOT NULL")
    plain = F.octet_length("text") == F.length("text")

    @F.pandas_udf(T.StringType())
    def shape(texts: pd.Series) -> pd.Series:
        return texts.map(skeleton)

    ascii_rows = rows.filter(plain).withColumn("skeleton", F.col("text"))
    return ascii_rows.unionByName(rows.filter(~plain).withColumn("skeleton", shape("text")))


def forms(df: DataFrame) -> DataFrame:
    """``(tbl, skel, form, row_id)``: rows of :func:`skeletons` whose skeleton occurs in several forms.

    ``skel`` and ``form`` are 128-bit hashes of skeleton and text, written once, so texts are
    read and folded once. The smallest and the largest form of a skeleton, combined before
    the shuffle, tell whether there are several; a text that occurs in one form only,
    however often, leaves there.
    """
    hashes = {f"{n}_{k}": F.xxhash64(F.lit(k), "tbl", c) for n, c in (("s", "skeleton"), ("f", "text")) for k in (0, 1)}
    rows = written(df.select("tbl", "row_id", *[h.alias(n) for n, h in hashes.items()]), "look-alikes")
    ends = [f("f_" + k).alias(n + k) for k in "01" for n, f in (("least_", F.min), ("most_", F.max))]
    several = rows.groupBy("s_0", "s_1").agg(*ends).filter("least_0 != most_0 OR least_1 != most_1").select("s_0", "s_1")
    many = rows.join(several, ["s_0", "s_1"], "left_semi")
    return many.select("tbl", F.struct("s_0", "s_1").alias("skel"), F.struct("f_0", "f_1").alias("form"), "row_id")


def pairs(many: DataFrame) -> DataFrame:
    """``(tbl, row_id_a, row_id_b)``, smaller first: rows of :func:`forms` with one skeleton but two forms.

    Pairs are made between the forms and then given their rows, so copies of one form are
    never compared with each other and the work follows the pairs that come out.
    """
    many = written(many, "look-alike-rows")
    each = many.select("skel", "form").distinct()
    twos = each.withColumnRenamed("form", "form_a").join(each.withColumnRenamed("form", "form_b"), "skel").filter("form_a < form_b")
    side = {k: many.select("tbl", F.col("form").alias(f"form_{k}"), F.col("row_id").alias(f"row_{k}")) for k in "ab"}
    # the text of one form may hold much of the rows: the few pairs of forms meet them, split where that is skewed
    rows = twos.join(side["a"], "form_a").join(side["b"].drop("tbl"), "form_b")
    return rows.select("tbl", F.least("row_a", "row_b").alias("row_id_a"), F.greatest("row_a", "row_b").alias("row_id_b"))


_SOURCES = (("pdf_fragments", "fragment_id"), ("captured_entries", "entry_row_id"))


def _all(spark: SparkSession, folder: str) -> DataFrame:
    one, two = (skeletons(table(spark, folder, name), key, "text", name) for name, key in _SOURCES)
    return one.unionByName(two)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs(forms(_all(spark, folder)))


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each row that has look-alikes, with its class and the smallest row of that class."""
    many = forms(_all(spark, folder))
    return many.join(many.groupBy("tbl", "skel").agg(F.min("row_id").alias("class_id")), ["tbl", "skel"]).select("tbl", "row_id", "class_id")


def p3_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every text in its one form."""

    @F.pandas_udf(T.StringType())
    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: unicodedata.normalize("NFC", x))

    rows, plain = _all(spark, folder), F.octet_length("skeleton") == F.length("skeleton")
    done = rows.filter(plain).select("tbl", "row_id", F.col("skeleton").alias("text"))
    return done.unionByName(rows.filter(~plain).select("tbl", "row_id", composed("skeleton").alias("text")))
