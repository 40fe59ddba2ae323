"""Pure-Python scanners of Markdown notes: metadata, prose, links, headings, summaries."""

from __future__ import annotations

import json
import math
import posixpath
import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field
from typing import Any

try:
    import yaml
except ImportError:  # notes without frontmatter can still be read
    yaml = None

MAX_SAFE_INTEGER = 2**53 - 1
MAX_ALIASES = 50
SUMMARY_UNITS = 180


class NoteError(ValueError):
    """A note that cannot be read; names its path."""


# --- metadata ---------------------------------------------------------------

if yaml is not None:

    class _CoreLoader(yaml.SafeLoader):
        """YAML 1.2 core scalars only; repeated keys are errors."""

        yaml_implicit_resolvers: dict = {}

        def construct_mapping(self, node, deep=False):
            self.flatten_mapping(node)
            out: dict = {}
            for key_node, value_node in node.value:
                key = self.construct_object(key_node, deep=True)
                name = key if isinstance(key, str) else number_text(key) if isinstance(key, (int, float)) else json.dumps(key)
                if name in out:
                    raise yaml.YAMLError(f"repeated key {name!r}")
                out[name] = self.construct_object(value_node, deep=True)
            return out

    for _tag, _pattern, _first in (
        ("null", r"(?:~|null|Null|NULL|)$", "~nN\0"),
        ("bool", r"(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
        ("int", r"(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", "-+0123456789"),
        ("float", r"(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", "-+.0123456789"),
    ):
        _CoreLoader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), [*(c if c != "\0" else "" for c in _first)])

    def _integer(loader, node):
        text = loader.construct_scalar(node)
        sign = -1 if text.startswith("-") else 1
        body = text.lstrip("+-")
        return sign * int(body, 8 if body.startswith("0o") else 16 if body.startswith("0x") else 10)

    def _real(loader, node):
        text = loader.construct_scalar(node).lower().replace(".inf", "inf").replace(".nan", "nan")
        return float(text)

    _CoreLoader.add_constructor("tag:yaml.org,2002:int", _integer)
    _CoreLoader.add_constructor("tag:yaml.org,2002:float", _real)
    _CoreLoader.add_constructor("tag:yaml.org,2002:bool", lambda loader, node: loader.construct_scalar(node).lower() == "true")
    _CoreLoader.add_constructor("tag:yaml.org,2002:map", lambda loader, node: loader.construct_mapping(node, deep=True))


def number_text(value: float) -> str:
    """A number as its shortest text: integral values without a fraction."""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(int(value)) if float(value).is_integer() and abs(value) < 1e21 else repr(float(value))


def narrowed(value: Any) -> Any:
    """The value if it is JSON-like with finite, safe numbers; raises ValueError otherwise."""
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, (int, float)):
        if not math.isfinite(value) or (float(value).is_integer() and abs(value) > MAX_SAFE_INTEGER):
            raise ValueError("a number is out of range")
        return value
    if isinstance(value, list):
        return [narrowed(x) for x in value]
    if isinstance(value, dict) and all(isinstance(k, str) for k in value):
        return {k: narrowed(v) for k, v in value.items()}
    raise ValueError(f"{type(value).__name__} is no metadata")


def parse_metadata(source: str) -> dict[str, Any]:
    if not source.strip():
        return {}
    if yaml is None:
        raise ValueError("no YAML reader is installed")
    aliases = sum(isinstance(event, yaml.AliasEvent) for event in yaml.parse(source, Loader=_CoreLoader))
    if aliases > MAX_ALIASES:
        raise ValueError("too many aliases")
    loaded = yaml.load(source, Loader=_CoreLoader)  # noqa: S506 - a SafeLoader
    if loaded is None:
        return {}
    if not isinstance(loaded, dict):
        raise ValueError("metadata is no mapping")
    return narrowed(loaded)


def normal(text: str) -> str:
    """How texts are compared: composed and lower-cased."""
    return unicodedata.normalize("NFC", text).lower()


def normal_tag(tag: str) -> str:
    return normal(tag.strip().lstrip("#"))


def unique_key(mapping: dict[str, Any], name: str) -> str | None:
    """The key ``name`` itself, else the only one that equals it but for case and composition."""
    if name in mapping:
        return name
    alike = [k for k in mapping if normal(k) == normal(name)]
    return alike[0] if len(alike) == 1 else None


# --- prose ------------------------------------------------------------------

_FENCE = re.compile(r"\s{0,3}(`{3,}|~{3,})")
_BLOCK = re.compile(r"\s{0,3}(?:#{1,6}(?:\s|$)|>|(?:[-+*]|\d+[.)])\s+)")
_TICKS = re.compile(r"`+")
_CODE_TAG = re.compile(r"<(/?)(pre|code|script|style)\b[^>]*>", re.I)
_INK = re.compile(r"[^\n]")


def _without_blocks(lines: list[str]) -> list[str]:
    """Lines with frontmatter, fenced and indented code and comments blanked."""
    out, fence, comment = [], "", False
    header = bool(lines) and lines[0].strip() == "---"
    for number, line in enumerate(lines):
        kept = ""
        mark = _FENCE.match(line)
        if header:
            header = number == 0 or line.strip() != "---"
        elif fence:
            if mark and mark.group(1).startswith(fence) and not line[mark.end() :].strip("\t ") and set(mark.group(1)) == {fence[0]}:
                fence = ""
        elif mark and (mark.group(1)[0] == "~" or "`" not in line[mark.end() :]):
            fence = mark.group(1)
        elif not line.startswith(("    ", "\t")):
            rest = line
            while rest:
                if comment:
                    _, found, rest = rest.partition("-->")
                    comment = not found
                else:
                    before, found, rest = rest.partition("<!--")
                    kept += before
                    comment = bool(found)
        out.append(kept)
    return out


def _without_html_code(text: str) -> str:
    parts, at, open_tag, depth = [], 0, None, 0
    for tag in _CODE_TAG.finditer(text):
        piece = text[at : tag.start()]
        parts.append(_INK.sub("", piece) if open_tag else piece)
        closing, name = tag.group(1) == "/", tag.group(2).lower()
        if open_tag is None and not closing:
            open_tag, depth = name, 1
        elif open_tag == name:
            depth += -1 if closing else 1
            open_tag = name if depth else None
        parts.append(_INK.sub("", tag.group()))
        at = tag.end()
    tail = text[at:]
    return "".join(parts) + (_INK.sub("", tail) if open_tag else tail)


def _escaped(text: str, at: int) -> bool:
    slashes = at - len(text[:at].rstrip("\\"))
    return slashes % 2 == 1


def _without_spans(text: str) -> str:
    """Text of one block without code spans: a run of backticks pairs with the next of its length."""
    if "`" not in text:
        return text
    runs = [m.span() for m in _TICKS.finditer(text) if not _escaped(text, m.start())]
    starts: dict[int, list[int]] = {}
    for a, b in runs:
        starts.setdefault(b - a, []).append(a)
    out, at = [], 0
    for a, b in runs:
        if a < at:
            continue
        same = starts[b - a]
        k = bisect_right(same, a)
        if k < len(same):
            end = same[k] + (b - a)
            out += [text[at:a], _INK.sub("", text[b : same[k]])]
            at = end
    return "".join(out) + text[at:]


def _without_inline_code(lines: list[str]) -> list[str]:
    out: list[str] = []
    block: list[str] = []

    def close() -> None:
        if block:
            out.extend(_without_spans("\n".join(block)).split("\n"))
            block.clear()

    for line in lines:
        if not line.strip():
            close()
            out.append("")
        elif _BLOCK.match(line):
            close()
            out.append(_without_spans(line))
        else:
            block.append(line)
    close()
    return out


def prose(content: str) -> str:
    """The text with metadata, code and comments blanked; line ends stay, so line numbers hold."""
    bare = _without_html_code("\n".join(_without_blocks(content.split("\n"))))
    return "\n".join(_without_inline_code(bare.split("\n")))


_WIKI = re.compile(r"(!?)\[\[([^\]\n]+)\]\]")


def wiki_links(searchable: str) -> list[tuple[str, int, bool]]:
    """``(target, line, embedded)`` of each link, in order."""
    breaks = [m.start() for m in re.finditer("\n", searchable)]
    return [
        (m.group(2).partition("|")[0].strip(), bisect_right(breaks, m.start()) + 1, m.group(1) == "!")
        for m in _WIKI.finditer(searchable)
        if not _escaped(searchable, m.start())
    ]


def plain(text: str) -> str:
    """Readable text: no images, link targets, wiki syntax or emphasis marks; blanks collapsed."""
    text = re.sub(r"!\[[^\]]*\]\([^)]*\)", "", text)
    text = re.sub(r"\[([^\]]+)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"\[\[([^|\]#]+)(?:#[^|\]]+)?(?:\|([^\]]+))?\]\]", lambda m: m.group(2) or posixpath.basename(m.group(1)), text)
    return " ".join(re.sub(r"[*_~]", "", text).split())


def units(text: str) -> int:
    """Length in UTF-16 code units."""
    return len(text) + sum(ord(c) > 0xFFFF for c in text)


def clipped(text: str, limit: int) -> str:
    """At most ``limit`` code units, no character cut in two."""
    if units(text) <= limit:
        return text
    return text.encode("utf-16-le", "surrogatepass")[: 2 * limit].decode("utf-16-le", "ignore")


def concise(text: str, limit: int = SUMMARY_UNITS) -> str:
    text = plain(text)
    if units(text) <= limit:
        return text
    space = clipped(text, limit + 1).rfind(" ")
    head = text[:space] if space >= int(limit * 0.65) else clipped(text, limit)
    return head.rstrip() + "…"


def first_heading(searchable: str) -> str | None:
    found = re.search(r"^#\s+(.+?)\s*$", searchable, re.M)
    return plain(found.group(1)) if found else None


def first_paragraph(searchable: str) -> str:
    for part in re.split(r"\n\s*\n", searchable):
        lines = (line.strip() for line in part.split("\n"))
        text = plain(" ".join(x for x in lines if x and not x.startswith(("#", "- ", "* ", "|", ">"))))
        if text:
            return text
    return ""


# --- notes ------------------------------------------------------------------


@dataclass
class Note:
    path: str
    id: str
    title: str
    content: str
    summary: str
    searchable: str
    aliases: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    properties: dict[str, str] = field(default_factory=dict)
    metadata: dict[str, Any] = field(default_factory=dict)
    links: list[tuple[str, int, bool]] = field(default_factory=list)


def vault_path(path: str) -> str:
    return posixpath.normpath(path.replace("\\", "/")).removeprefix("./")


def without_extension(path: str) -> str:
    return path[:-3] if path.lower().endswith(".md") else path


def frontmatter(content: str, path: str) -> dict[str, Any]:
    lines = content.split("\n")
    if lines[0].strip() != "---":
        return {}
    end = next((i for i, line in enumerate(lines) if i and line.strip() == "---"), None)
    if end is None:
        raise NoteError(f"{path}: metadata has no end")
    try:
        metadata = parse_metadata("\n".join(lines[1:end]))
    except Exception as error:
        raise NoteError(f"{path}: {error}") from error
    if len({k.lower() for k in metadata}) < len(metadata):
        raise NoteError(f"{path}: metadata keys differ by case only")
    return metadata


def _strings(value: Any) -> list[str]:
    return [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, str)]


def scalar_text(value: Any) -> str | None:
    if value is None:
        return "null"
    if isinstance(value, str):
        return value
    return number_text(value) if isinstance(value, (bool, int, float)) else None


def parse_note(path: str, content: str) -> Note:
    """The typed view of a note; raises :class:`NoteError` for malformed metadata."""
    path = vault_path(path)
    metadata = frontmatter(content, path)
    by_name = {k.lower(): k for k in metadata}

    def get(name: str) -> Any:
        key = by_name.get(name)
        return metadata.get(key) if key else None

    texts = {k: scalar_text(metadata[key]) for k, key in by_name.items() if k != "aliases"}
    properties = {k: v for k, v in texts.items() if v}
    searchable = prose(content)
    note_id = without_extension(path)
    heading = first_heading(searchable)
    title = properties.get("title", heading if heading is not None else posixpath.basename(note_id).replace("-", " "))
    return Note(
        path=path,
        id=note_id,
        title=title,
        content=content,
        summary=concise(properties.get("description", first_paragraph(searchable))),
        searchable=searchable,
        aliases=[x for x in _strings(get("aliases")) if x.strip()],
        tags=list(dict.fromkeys(t for t in map(normal_tag, _strings(get("tags"))) if t)),
        properties=properties,
        metadata=metadata,
        links=wiki_links(searchable),
    )
