"""Bounded and escaped texts, sizes, times, sniffed types."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.markdown import clipped, units


def bounded(text: str, limit: int, marker: str = "…") -> str:
    """At most ``limit`` UTF-16 units, the marker included, no character cut."""
    return text if units(text) <= limit else clipped(text, max(0, limit - units(marker))) + marker


def utf8_prefix(text: str, limit: int) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    return text if len(raw) <= limit else raw[:limit].decode("utf-8", "ignore")


def utf8_bounded(text: str, limit: int, marker: str) -> str:
    raw = text.encode()
    return text if len(raw) <= limit else utf8_prefix(text, max(0, limit - len(marker.encode()))) + utf8_prefix(marker, limit)


def yaml_string(text: str, limit: int = 16_384) -> str:
    """A one-line double-quoted YAML scalar."""
    named = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}

    def escaped(c: str) -> str:
        code = ord(c)
        if c in named:
            return named[c]
        if code < 0x20 or 0x7F <= code <= 0x9F or code in (0x2028, 0x2029, 0xFEFF):
            return f"\\u{code:04x}"
        return c

    return '"' + "".join(map(escaped, clipped(text, limit))) + '"'


def first_line(text: str, limit: int) -> str:
    return bounded(text.strip().split("\n", 1)[0].strip(), limit)


def escaped_markdown(text: str) -> str:
    """Text that Markdown shows as it is."""
    return re.sub(r"([\\`*_~\[\]])", r"\\\1", text).replace("<", "&lt;").replace(">", "&gt;")


_SIZES = {"": 1, "b": 1, "k": 1024, "kb": 1024, "m": 1024**2, "mb": 1024**2, "g": 1024**3, "gb": 1024**3}


def byte_size(text: str) -> int:
    """``25mb`` as bytes."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]*)\s*", text)
    if not m or m.group(2).lower() not in _SIZES or not int(m.group(1)):
        raise ValueError(f"no size: {text!r}")
    return int(m.group(1)) * _SIZES[m.group(2).lower()]


def iso_time(text: str | None) -> str | None:
    """Any ISO-like date as UTC text with milliseconds, or None."""
    try:
        moment = datetime.fromisoformat((text or "").strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    moment = moment if moment.tzinfo else moment.replace(tzinfo=UTC)
    return moment.astimezone(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def decode_bytes(data: bytes, content_type: str | None) -> str:
    """Latin charsets as Windows-1252, everything else as UTF-8 with replacements."""
    charset = re.search(r"charset\s*=\s*\"?([\w-]+)", content_type or "", re.I)
    latin = charset and charset.group(1).lower() in ("iso-8859-1", "latin1", "latin-1", "windows-1252", "cp1252")
    return data.decode("cp1252" if latin else "utf-8", "replace")


def duration(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("bigint"), F.pmod((s / 60).cast("bigint"), F.lit(60)), F.pmod(s, F.lit(60)))


def image_type(content: Column) -> Column:
    """The file extension that an image's first bytes tell, or null."""

    def begins(offset: int, *heads: str) -> Column:
        return F.hex(F.substr(content, F.lit(offset + 1), F.lit(len(heads[0]) // 2))).isin(*heads)

    return (
        F.when(begins(0, "89504E470D0A1A0A"), "png")
        .when(begins(0, "FFD8FF"), "jpg")
        .when(begins(0, "474946383761", "474946383961"), "gif")
        .when(begins(0, "52494646") & begins(8, "57454250"), "webp")
        .when(begins(4, "66747970") & begins(8, "61766966", "61766973"), "avif")
    )


def media_type(content: Column, extension: Column) -> Column:
    """The media type that first bytes and extension agree on, or null."""

    def begins(offset: int, *heads: str) -> Column:
        return F.hex(F.substr(content, F.lit(offset + 1), F.lit(len(heads[0]) // 2))).isin(*heads)

    ext = F.lower(extension)
    return (
        F.when(ext.isin("mp4", "m4v", "m4a", "mov") & begins(4, "66747970"), F.when(ext == "m4a", "audio/mp4").otherwise("video/mp4"))
        .when(ext.isin("webm", "mkv") & begins(0, "1A45DFA3"), "video/webm")
        .when((ext == "mp3") & (begins(0, "494433") | begins(0, "FFFB", "FFF3", "FFF2")), "audio/mpeg")
        .when(ext.isin("ogg", "opus") & begins(0, "4F676753"), "audio/ogg")
        .when((ext == "wav") & begins(0, "52494646") & begins(8, "57415645"), "audio/wav")
        .when((ext == "flac") & begins(0, "664C6143"), "audio/flac")
    )
