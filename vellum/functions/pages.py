"""HTML pages to articles in Markdown, safe source HTML, and links and images of Markdown."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DROPPED = {"script", "style", "noscript", "template", "iframe", "object", "svg", "form", "nav", "footer", "aside", "button", "head"}
BLOCKS = {"p", "div", "section", "article", "main", "header", "ul", "ol", "table", "tr", "blockquote", "pre", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "li", "hr", "br"}
MAX_DEPTH = 512


@dataclass
class Article:
    title: str | None = None
    author: str | None = None
    published: str | None = None
    description: str | None = None
    content: str = ""


@dataclass
class _Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)


class _Tree(HTMLParser):
    """A page as nodes; depth is bounded, stray ends are ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs})
        if tag in ("p", "li", "tr", "td", "th", "option") and self.open[-1].tag == tag:
            self.open.pop()
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < MAX_DEPTH:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parsed(source: str) -> _Node:
    tree = _Tree()
    tree.feed(source)
    tree.close()
    return tree.root


def _walk(node: _Node):
    stack = [node]
    while stack:
        top = stack.pop()
        yield top
        stack += [c for c in reversed(top.children) if isinstance(c, _Node)]


def _text(node: _Node) -> str:
    return "".join(c if isinstance(c, str) else "" if c.tag in DROPPED else _text(c) for c in node.children)


def _first(root: _Node, *tags: str) -> _Node | None:
    return next((n for n in _walk(root) if n.tag in tags), None)


def _meta(root: _Node, *names: str) -> str | None:
    for node in _walk(root):
        if node.tag == "meta" and (node.attrs.get("name") or node.attrs.get("property", "")).lower() in names and node.attrs.get("content", "").strip():
            return node.attrs["content"].strip()
    return None


def _inline(node: _Node) -> str:
    marks = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}
    out = ""
    for child in node.children:
        if isinstance(child, str):
            out += re.sub(r"\s+", " ", child)
        elif child.tag in DROPPED:
            continue
        elif child.tag == "br":
            out += "\n"
        elif child.tag == "img":
            out += f"![{child.attrs.get('alt', '')}]({child.attrs.get('src', '')})" if child.attrs.get("src") else ""
        elif child.tag == "a" and child.attrs.get("href"):
            out += f"[{_inline(child).strip()}]({child.attrs['href']})"
        else:
            inner = _inline(child)
            mark = marks.get(child.tag, "")
            out += f"{mark}{inner.strip()}{mark}" if mark and inner.strip() else inner
    return out


def _markdown(node: _Node, depth: int = 0) -> list[str]:
    out, run = [], _Node("span")

    def close() -> None:
        text = _inline(run).strip()
        if text:
            out.append(text)
        run.children.clear()

    for child in node.children:
        if isinstance(child, str) or child.tag not in BLOCKS | DROPPED or child.tag == "br":
            run.children.append(child)
            continue
        close()
        tag = child.tag
        if tag in DROPPED:
            continue
        if re.fullmatch("h[1-6]", tag):
            out.append("#" * int(tag[1]) + " " + _inline(child).strip())
        elif tag == "pre":
            out.append("```\n" + _text(child).strip("\n") + "\n```")
        elif tag == "blockquote":
            out.append("\n".join("> " + line for line in "\n\n".join(_markdown(child, depth)).split("\n")))
        elif tag in ("ul", "ol"):
            items = [c for c in child.children if isinstance(c, _Node) and c.tag == "li"]
            lines = []
            for k, item in enumerate(items, 1):
                body = "\n".join(_markdown(item, depth + 1)).replace("\n", "\n  ")
                lines.append((f"{k}. " if tag == "ol" else "- ") + body)
            out.append("\n".join(lines))
        elif tag == "table":
            rows = [n for n in _walk(child) if n.tag == "tr"]
            cells = [[_inline(c).strip().replace("|", "\\|") for c in r.children if isinstance(c, _Node) and c.tag in ("td", "th")] for r in rows]
            cells = [c for c in cells if c]
            if cells:
                width = max(map(len, cells))
                shown = ["| " + " | ".join(c + [""] * (width - len(c))) + " |" for c in cells]
                out.append("\n".join([shown[0], "|" + " --- |" * width, *shown[1:]]))
        elif tag == "hr":
            out.append("---")
        else:
            out += _markdown(child, depth)
    close()
    return [x for x in out if x.strip()]


def extract_article(source: str) -> Article:
    """The main part of a page: its article or main element, else the element with most paragraph text."""
    root = parsed(source)
    title = _meta(root, "og:title", "twitter:title") or (_text(t).strip() if (t := _first(root, "title")) else None)
    main = _first(root, "article") or _first(root, "main")
    if main is None:
        scores = {id(n): (sum(len(_text(c)) for c in n.children if isinstance(c, _Node) and c.tag == "p"), n) for n in _walk(root)}
        best = max(scores.values(), key=lambda s: s[0], default=(0, root))
        main = best[1] if best[0] else _first(root, "body") or root
    return Article(title, _meta(root, "author", "article:author"), _meta(root, "article:published_time", "date"), _meta(root, "description", "og:description"), "\n\n".join(_markdown(main)))


# --- safe source ------------------------------------------------------------

# What a kept page may hold (fixed values).
ALLOWED = {
    "a", "abbr", "article", "aside", "b", "blockquote", "body", "br", "caption", "cite", "code", "col", "colgroup", "dd", "del", "details", "dfn", "div", "dl", "dt",
    "em", "figcaption", "figure", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "i", "img", "ins", "kbd", "li", "main", "mark", "nav", "ol",
    "p", "pre", "q", "s", "samp", "section", "small", "span", "strong", "sub", "summary", "sup", "table", "tbody", "td", "tfoot", "th", "thead", "time", "tr", "u", "ul",
}
KEPT_ATTRIBUTES = {"alt", "cite", "colspan", "datetime", "dir", "headers", "lang", "rowspan", "scope", "title"}
POLICY = "<meta http-equiv=\"Content-Security-Policy\" content=\"default-src 'none'\">"


def safe_html(source: str) -> str:
    """The page without anything that acts or loads: known elements, plain attributes, addresses as text."""

    def emit(node: _Node) -> str:
        out = []
        for child in node.children:
            if isinstance(child, str):
                out.append(html.escape(child, quote=False))
            elif child.tag in ("script", "style", "noscript", "template", "iframe", "object", "embed", "svg", "math", "form", "head", "title"):
                continue
            elif child.tag not in ALLOWED or child.tag in ("html", "body"):
                out.append(emit(child))
            else:
                kept = {k: v for k, v in child.attrs.items() if k in KEPT_ATTRIBUTES}
                kept |= {f"data-{k}": v for k, v in child.attrs.items() if k in ("href", "src") and re.match("(?i)https?://", v)}
                shown = "".join(f' {k}="{html.escape(v)}"' for k, v in kept.items())
                out.append(f"<{child.tag}{shown}>" + ("" if child.tag in VOID else emit(child) + f"</{child.tag}>"))
        return "".join(out)

    return f"<!doctype html><html><head><meta charset=\"utf-8\">{POLICY}</head><body>{emit(parsed(source))}</body></html>"


# --- Markdown addresses -----------------------------------------------------

_CODE = re.compile(r"(^[ \t]{0,3}(`{3,}|~{3,}).*?(?:^[ \t]{0,3}\2[`~]*[ \t]*$|\Z))|(`+)(?!`).*?(?<!`)\3(?!`)", re.M | re.S)
_INLINE = re.compile(r"(!?)\[([^\]\n]*)\]\(\s*<?([^\s)>]+)>?(\s+\"[^\"\n]*\")?\s*\)")
_DEFINITION = re.compile(r"^[ ]{0,3}\[([^\]\n]+)\]:[ \t]*<?(\S+?)>?[ \t]*(?:\"[^\"\n]*\")?[ \t]*$", re.M)
_REFERENCE = re.compile(r"!\[([^\]\n]*)\]\[([^\]\n]*)\]")
_IMG = re.compile(r"<img\b[^>]*?\bsrc\s*=\s*[\"']([^\"']+)[\"'][^>]*>", re.I)
MAX_ADDRESS_UNITS = 8192


def remote(address: str, base: str) -> str | None:
    """An address against its page, if it is a web address of bounded length."""
    if len(address) > MAX_ADDRESS_UNITS:
        return None
    try:
        full = urljoin(base, html.unescape(address))
        parts = urlsplit(full)
    except ValueError:
        return None
    return full if parts.scheme in ("http", "https") and parts.hostname else None


def _outside_code(text: str):
    at = 0
    for m in _CODE.finditer(text):
        yield text[at : m.start()], m.group()
        at = m.end()
    yield text[at:], ""


def image_sources(text: str, base: str, limit: int = 1000) -> list[str]:
    """Web addresses of a text's images, in order and once: Markdown, references that are used, and HTML."""
    found: dict[str, None] = {}
    definitions = {m.group(1).strip().lower(): m.group(2) for part, _ in _outside_code(text) for m in _DEFINITION.finditer(part)}
    for part, _ in _outside_code(text):
        hits = [(m.start(), m.group(3)) for m in _INLINE.finditer(part) if m.group(1)]
        hits += [(m.start(), definitions.get((m.group(2) or m.group(1)).strip().lower(), "")) for m in _REFERENCE.finditer(part)]
        hits += [(m.start(), m.group(1)) for m in _IMG.finditer(part)]
        for _, address in sorted(hits):
            if address and (full := remote(address, base)) and len(found) < limit:
                found.setdefault(full)
    return list(found)


def rewritten(text: str, base: str, local: dict[str, str]) -> str:
    """Markdown with images at their local paths or absolute, links absolute, others inert; code stays as it is."""

    def address(m: re.Match) -> str:
        image, label, target = m.group(1), m.group(2), m.group(3)
        if target.startswith("#") and not image:
            return m.group()
        full = remote(target, base)
        if full is None:
            return label
        return f"{image}[{label}]({local.get(full, full) if image else full}{m.group(4) or ''})"

    def element(m: re.Match) -> str:
        full = remote(m.group(1), base)
        return f"![]({local.get(full, full)})" if full else ""

    def definition(m: re.Match) -> str:
        full = remote(m.group(2), base)
        return f"[{m.group(1)}]: {local.get(full, full)}" if full else ""

    return "".join(_DEFINITION.sub(definition, _IMG.sub(element, _INLINE.sub(address, part))) + code for part, code in _outside_code(text))
