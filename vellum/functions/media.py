"""Captions, page observations, media metadata."""

from __future__ import annotations

import html
import json
import re
from dataclasses import dataclass

from vellum.functions.text import escaped_markdown, utf8_prefix

MAX_OVERLAP_WORDS = 256
_STAMP = re.compile(r"(?:(\d{2}):)?([0-5]\d):([0-5]\d)[.,]\d{3}")


def stamp_seconds(text: str) -> int | None:
    """``[HH:]MM:SS.mmm`` in whole seconds."""
    m = _STAMP.fullmatch((text.split() or [""])[0])
    return None if not m else int(m.group(1) or 0) * 3600 + int(m.group(2)) * 60 + int(m.group(3))


def stamp_text(seconds: int) -> str:
    hours, rest = divmod(seconds, 3600)
    return (f"{hours:02d}:" if hours else "") + f"{rest // 60:02d}:{rest % 60:02d}"


def new_words(previous: str | None, current: str) -> str | None:
    """What a rolling caption adds to the one before; None for nothing."""
    if previous is None:
        return current
    if current in previous:
        return None
    old, new = previous.split(" "), current.split(" ")
    for n in range(min(len(old), len(new), MAX_OVERLAP_WORDS), 0, -1):
        if old[-n:] == new[:n]:
            return " ".join(new[n:]).strip() or None
    return current


@dataclass(frozen=True)
class Captions:
    markdown: str
    cues: int
    truncated: bool


def parse_captions(text: str, max_bytes: int = 8 << 20, max_cues: int = 20_000) -> Captions:
    """WebVTT as timestamped lines without what rolling captions repeat."""
    cut = len(text.encode()) > max_bytes
    lines = (utf8_prefix(text, max_bytes) if cut else text).replace("\r\n", "\n").replace("\r", "\n").split("\n")
    out, size, previous, i = [], 0, None, 0
    while i < len(lines):
        head, arrow, _ = lines[i].partition("-->")
        i += 1
        if not arrow:
            continue
        body = []
        while i < len(lines) and lines[i].strip() and "-->" not in lines[i]:
            body.append(lines[i])
            i += 1
        at = stamp_seconds(head)
        cue = " ".join(html.unescape(re.sub(r"<[^>\n]{0,512}>", "", " ".join(body))).split())[:16_384]
        if at is None or not cue:
            continue
        added, previous = new_words(previous, cue), cue
        if added is None:
            continue
        line = f"- [{stamp_text(at)}] {escaped_markdown(added)}"
        size += len(line.encode()) + 1
        if len(out) >= max_cues or size > max_bytes:
            cut = True
            break
        out.append(line)
    return Captions("".join(f"{x}\n" for x in out), len(out), cut)


def overlap(source: list[str], prefix: list[str]) -> int:
    """The longest end of ``source`` that begins ``prefix``, in linear time by the border table of both."""
    joined = [*prefix, None, *source[-len(prefix) :]] if prefix and source else []
    border = [0] * len(joined)
    for i in range(1, len(joined)):
        k = border[i - 1]
        while k and joined[i] != joined[k]:
            k = border[k - 1]
        border[i] = k + (joined[i] is not None and joined[i] == joined[k])
    return border[-1] if joined else 0


def merged_snapshots(snapshots: list[str], max_bytes: int) -> tuple[str, bool, int]:
    """Observations of one page as one text: shared heads once, overlaps joined; cut or not; lines added."""
    if max_bytes < 0:
        raise ValueError("a limit is 0 or more")
    merged: list[str] = []
    added = 0
    for n, text in enumerate(snapshots):
        lines = re.sub(r"\r\n?", "\n", text).strip("\n").split("\n")
        while lines and not lines[0].strip():
            lines.pop(0)
        while lines and not lines[-1].strip():
            lines.pop()
        if not lines:
            continue
        if not merged:
            merged = lines
            continue
        same = next((k for k, (a, b) in enumerate(zip(merged, lines, strict=False)) if a != b), min(len(merged), len(lines)))
        rest = lines[same:]
        shared = overlap(merged, rest)
        fresh = rest[shared:]
        if fresh:
            if not same and not shared and merged[-1] != "":
                merged.append("")
            merged += fresh
            added += len(fresh)
    whole = "\n".join(merged)
    bounded = utf8_prefix(whole, max_bytes)
    return bounded, bounded != whole, added


_MEDIA_FIELDS = ("id", "title", "uploader", "channel", "upload_date", "duration", "webpage_url", "extractor", "description", "ext", "filesize")


def media_metadata(output: str, prefix: str = "METADATA ") -> dict | None:
    """The allowed fields of the last prefixed JSON line of a tool's output."""
    for line in reversed(output.split("\n")):
        if line.startswith(prefix):
            try:
                data = json.loads(line[len(prefix) :])
            except ValueError:
                continue
            if isinstance(data, dict):
                return {k: data[k] for k in _MEDIA_FIELDS if isinstance(data.get(k), (str, int, float))}
    return None


def media_outcome(stderr: str) -> str:
    """A tool's failure as a status."""
    rules = (
        (r"unsupported url|no suitable extractor", "unsupported"), (r"\bdrm\b", "drm-protected"),
        (r"log ?in|sign in|cookies|private video|members[- ]only", "auth-required"), (r"requested format|no video formats", "no-format"),
    )
    return next((status for pattern, status in rules if re.search(pattern, stderr, re.I)), "failed")
