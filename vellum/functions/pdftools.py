"""Output of PDF tools as rows: layout XML, document facts, annotations."""

from __future__ import annotations

import html
import json
import re
import unicodedata
from typing import Any

_TAG = re.compile(r"<(/?)(page|fontspec|text|image)\b([^>]*)>", re.I)
_ATTRIBUTE = re.compile(r'([\w-]+)="([^"]*)"')
_JOINED = {0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0xFB03: "ffi", 0xFB04: "ffl", 0xFB05: "st", 0xFB06: "st"}
MAX_PAGES, MAX_FRAGMENTS, MAX_XML = 10_000, 500_000, 128 << 20


def readable(text: str) -> str:
    return unicodedata.normalize("NFC", html.unescape(text).translate(_JOINED))


def parse_layout(xml: str) -> tuple[list[dict], list[dict], list[dict]]:
    """Pages, fragments and images in order; a font's last definition before a text holds."""
    if len(xml) > MAX_XML:
        raise ValueError("the layout is too large")
    pages, fragments, images = [], [], []
    fonts: dict[str, dict[str, str]] = {}
    page: int | None = None
    for m in _TAG.finditer(xml):
        closing, tag, attributes = m.group(1), m.group(2).lower(), dict(_ATTRIBUTE.findall(m.group(3)))
        if closing:
            page = None if tag == "page" else page
        elif tag == "page":
            page = int(attributes["number"])
            pages.append({"page_no": page, "width": float(attributes["width"]), "height": float(attributes["height"])})
            if len(pages) > MAX_PAGES:
                raise ValueError("the layout has too many pages")
        elif tag == "fontspec":
            fonts[attributes["id"]] = attributes
        elif page is None:
            raise ValueError(f"<{tag}> outside a page")
        elif tag == "image":
            images.append({"page_no": page, "src": attributes["src"], **{k: float(attributes[k]) for k in ("top", "left", "width", "height")}})
        else:
            end = xml.find("</text>", m.end())
            inner = xml[m.end() : end if end >= 0 else None]
            font = fonts.get(attributes.get("font", ""), {})
            shown = readable(re.sub(r"<[^>]*>", "", inner))
            if shown.strip():
                fragments.append(
                    {
                        "page_no": page, "ordinal": len(fragments), **{k: float(attributes[k]) for k in ("top", "left", "width", "height")},
                        "font_id": attributes.get("font"), "font_size": float(font.get("size") or attributes["height"]), "text": shown,
                        "bold": "<b>" in inner or "bold" in font.get("family", "").lower(), "italic": "<i>" in inner or "italic" in font.get("family", "").lower(),
                    }
                )
            if len(fragments) > MAX_FRAGMENTS:
                raise ValueError("the layout has too many fragments")
    return pages, fragments, images


def parse_facts(text: str) -> dict[str, str]:
    """``Key: value`` lines, the first of a key; the page count must be there."""
    facts: dict[str, str] = {}
    for line in text.splitlines():
        key, colon, value = line.partition(":")
        if colon and key.strip():
            facts.setdefault(key.strip().lower().replace(" ", "_"), value.strip())
    if not facts.get("pages", "").isdigit():
        raise ValueError("no page count")
    return facts


def parse_annotations(text: str) -> list[dict[str, Any]]:
    """Image notes ``{imageId, sha256, description, text?}``; ids are unique, anything else an error."""
    rows = json.loads(text)
    rows = rows.get("images") if isinstance(rows, dict) else rows
    if not isinstance(rows, list):
        raise ValueError("annotations are a list")
    seen: set[str] = set()
    for row in rows:
        if not isinstance(row, dict) or not all(isinstance(row.get(k), str) and row[k] for k in ("imageId", "sha256", "description")):
            raise ValueError("an annotation needs imageId, sha256 and description")
        if not re.fullmatch("[0-9a-f]{64}", row["sha256"]) or row["imageId"] in seen:
            raise ValueError(f"annotation of {row['imageId']} is repeated or has a bad hash")
        seen.add(row["imageId"])
    return rows
