"""Path and link-target expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ECMAScript white space, spelled out because Java's \s is ASCII.
SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trim(text: Column) -> Column:
    """Trim every ECMAScript blank from both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def percent_decoded(text: Column) -> Column:
    """Percent-decoding; the input itself where it is malformed. ``+`` stays ``+``."""
    decoded = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    sound = F.when(~decoded.contains(chr(0xFFFD)) | text.contains(chr(0xFFFD)), decoded)
    return F.when(text.contains("%"), F.coalesce(sound, text)).otherwise(text)


def normalized(path: Column) -> Column:
    """POSIX normalisation of a relative path: ``.``, ``..`` and empty parts resolved."""
    folded = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when((part == "") | (part == "."), done)
        .when(
            (part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."),
            F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
        )
        .otherwise(F.concat(done, F.array(part))),
    )
    joined = F.array_join(folded, "/")
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def without_markdown_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"(?i)\.md$", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The folder part, ``''`` for a path without one."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/+$", "")


def extension(path: Column) -> Column:
    """The extension of the last part with its dot; ``''`` for none or for a leading dot only."""
    last = basename(F.regexp_replace(path, r"/+$", ""))
    found = F.regexp_extract(last, r"^.+(\.[^.]*)$", 1)
    return F.when(last == "..", F.lit("")).otherwise(found)


def link_address(target: Column) -> Column:
    """The address of a link target: anchor and block reference cut, trimmed, decoded, ``/`` only."""
    cut = F.substring_index(F.substring_index(target, "#", 1), "^", 1)
    return F.regexp_replace(percent_decoded(trim(cut)), r"\\", "/")


def is_attachment(address: Column) -> Column:
    found = F.lower(extension(address))
    return (found != "") & (found != ".md")


def joined(folder: Column, relative: Column) -> Column:
    """``relative`` read from ``folder``, normalised."""
    return normalized(F.concat_ws("/", F.nullif(folder, F.lit("")), relative))
