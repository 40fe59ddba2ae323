"""Conversation trees as flat rows: parsers, linking, depths, counts, rendering."""

from __future__ import annotations

import html
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import iso_time
from vellum.session import written

MAX_DEPTH = 64
ENTRY_FIELDS = (
    ("entry_id", "string"), ("parent_id", "string"), ("relation", "string"), ("tree_depth", "int"), ("ordinal", "int"), ("kind", "string"),
    ("author_name", "string"), ("handle", "string"), ("created_at", "string"), ("source_url", "string"), ("text", "string"), ("reason", "string"),
    ("likes", "bigint"), ("replies", "bigint"), ("reposts", "bigint"), ("quotes", "bigint"), ("title", "string"), ("media", "array<struct<kind:string,url:string>>"),
)
MAX_WARNINGS = 100


@dataclass(frozen=True)
class Limits:
    depth: int = 24
    items: int = 1000
    text: int = 100_000
    media: int = 32

    def __post_init__(self) -> None:
        if not (1 <= self.depth <= MAX_DEPTH and 1 <= self.items <= 10_000 and 1 <= self.text <= 1_000_000 and 0 <= self.media <= 128):
            raise ValueError("limits are out of range")


# --- linking ----------------------------------------------------------------


def distinct_entries(entries: DataFrame) -> DataFrame:
    """One row an entry: of repeated records the one captured first, then with the smallest row id; entries without id stay apart."""
    columns = [c for c in entries.columns if c not in ("thread_id", "entry_id")]
    first = F.min_by(F.struct(*columns), F.struct("captured_at", "entry_row_id"))
    own = F.when(F.col("entry_id").isNull(), F.col("entry_row_id")).alias("own")
    return entries.groupBy("thread_id", "entry_id", own).agg(first.alias("e")).select("thread_id", "entry_id", "e.*")


def linked(entries: DataFrame, cut_every: int = 8) -> DataFrame:
    """Entries with their ``depth`` from the root and ``path`` of ordinals, parents before children.

    A level joins the last one with its children on thread and parent; every few levels
    are written to the shared folder. Entries whose parent is unknown, and those in
    cycles, become roots of depth 0. Levels go on until one is empty; entries are distinct (:func:`distinct_entries`).
    """
    keys = entries.select("thread_id", "entry_id", "parent_id", "ordinal")
    ids = keys.select("thread_id", F.col("entry_id").alias("parent_id")).distinct().withColumn("there", F.lit(True))
    keys = keys.join(ids, ["thread_id", "parent_id"], "left")
    step = F.coalesce("ordinal", F.lit(0))
    level = keys.filter("there IS NULL").select("thread_id", "entry_id", F.lit(0).alias("depth"), F.array(step).alias("path"))
    children = keys.filter("there").select("thread_id", "parent_id", "entry_id", step.alias("step"))
    levels = [level]
    for depth in itertools.count(1):
        up = levels[-1].select("thread_id", F.col("entry_id").alias("parent_id"), F.col("path").alias("up"))
        level = children.join(up, ["thread_id", "parent_id"]).select("thread_id", "entry_id", F.lit(depth).alias("depth"), F.concat("up", F.array("step")).alias("path"))
        if depth % cut_every == 0:
            level = written(level, "thread-level")
            if level.isEmpty():
                break
        levels.append(level)
    placed = reduce(DataFrame.unionByName, levels)
    placed = placed.filter(F.col("entry_id").isNotNull()).withColumnRenamed("thread_id", "placed_thread").withColumnRenamed("entry_id", "placed_entry")
    same = F.col("thread_id").eqNullSafe(F.col("placed_thread")) & (F.col("entry_id") == F.col("placed_entry"))
    rows = entries.join(placed, same, "left").drop("placed_thread", "placed_entry")
    return rows.withColumns({"path": F.coalesce("path", F.array(step)), "depth": F.coalesce("depth", F.lit(0))})


def thread_counts(entries: DataFrame) -> DataFrame:
    """Items, unavailable and unloaded entries and the deepest level of each thread, and its status."""
    counts = entries.groupBy("thread_id").agg(
        F.count_if(F.col("kind") == "content").alias("n_content"),
        F.count_if(F.col("kind") == "unavailable").alias("n_unavailable"),
        F.count_if(F.col("kind") == "more").alias("n_more"),
        F.max("tree_depth").alias("max_depth"),
        F.sum(F.when((F.col("kind") == "content") & F.col("parent_id").isNull(), F.col("replies"))).alias("declared"),
    )
    captured = F.col("n_content") + F.col("n_unavailable")
    expected = F.greatest(captured, F.coalesce("declared", F.lit(0)) + 1)
    status = F.when(F.col("n_content") == 0, "unsupported").when((F.col("n_more") > 0) | (captured < expected), "partial").otherwise("complete")
    return counts.withColumns({"captured": captured, "expected": expected, "status": status})


def rendered(entries: DataFrame) -> DataFrame:
    """``(thread_id, n_lines, markdown)``: replies as nested bullets in path order, quotes marked.

    A thread is one document, so its lines meet in one row; entries stay apart until then.
    """
    who = F.coalesce("author_name", "handle", F.lit("unknown"))
    said = F.when(F.col("kind") == "content", F.regexp_replace(F.coalesce("text", F.lit("")), r"\s*\n\s*", " "))
    said = said.when(F.col("kind") == "more", F.lit("_more replies_")).otherwise(F.concat(F.lit("_unavailable"), F.coalesce(F.concat(F.lit(": "), F.col("reason")), F.lit("")), F.lit("_")))
    mark = F.when(F.col("relation") == "quote", "> ").otherwise("- ")
    indent = F.repeat(F.lit("  "), F.least(F.col("depth"), F.lit(MAX_DEPTH)))
    line = F.concat(indent, mark, F.lit("**"), who, F.lit("**: "), said)
    rows = entries.select("thread_id", "path", "entry_id", line.alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("path", "entry_id", "line")))
    return rows.groupBy("thread_id").agg(lines.alias("lines")).select(
        "thread_id", F.size("lines").alias("n_lines"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("markdown")
    )


# --- parsers of public formats ---------------------------------------------


def comment_markdown(source: str | None) -> str | None:
    """The HTML of a comment as Markdown: paragraphs, emphasis, links and code."""
    if source is None:
        return None
    text = re.sub(r"(?i)<pre><code>(.*?)</code></pre>", lambda m: "\n\n```\n" + m.group(1).rstrip("\n") + "\n```\n\n", source, flags=re.S)
    text = re.sub(r"(?i)<p>|<br\s*/?>", lambda m: "\n\n" if m.group().lower() == "<p>" else "\n", text)
    for tag, mark in (("i", "*"), ("em", "*"), ("b", "**"), ("strong", "**"), ("code", "`")):
        text = re.sub(rf"(?i)</?{tag}>", mark, text)
    text = re.sub(r"""(?is)<a\s[^>]*?href=["']([^"']*)["'][^>]*>(.*?)</a>""", lambda m: f"[{m.group(2)}](<{m.group(1)}>)" if _web(m.group(1)) else m.group(2), text)
    text = html.unescape(re.sub(r"<(?!https?://)[^<>]*>", "", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


@dataclass
class Node:
    """One entry of a conversation as its platform gives it: its fields, and what it refers to."""

    key: str | None
    fields: dict
    replies: list = field(default_factory=list)
    quoted: list = field(default_factory=list)


def walked(roots: list, read, limits: Limits) -> Iterator[dict]:
    """Entries of a conversation depth first, quotes before replies; ``read`` gives the :class:`Node` of a reference.

    An entry that comes back, or lies beyond a limit, is a row of kind ``boundary`` with its
    reason; what was cut or skipped is told once in a row of kind ``warning``.
    """
    stack = [(ref, None, "root", 0) for ref in reversed(roots)]
    seen: set[str] = set()
    warnings: dict[str, None] = {}
    n = 0
    while stack:
        ref, parent, relation, depth = stack.pop()
        node = read(ref)
        if node is None:
            warnings["a malformed entry was skipped"] = None
            continue
        edge = "cycle" if node.key is not None and node.key in seen else "depth-limit" if depth > limits.depth else "item-limit" if n >= limits.items else None
        place = {"entry_id": node.key, "parent_id": parent, "relation": relation, "tree_depth": depth}
        if edge:
            warnings[{"cycle": f"a cycle at entry {node.key} was cut", "depth-limit": f"replies below level {limits.depth} were truncated", "item-limit": f"the conversation was truncated to {limits.items} entries"}[edge]] = None
            yield {**place, "kind": "boundary", "reason": edge}
            if edge == "item-limit":
                break
            continue
        if node.key is not None:
            seen.add(node.key)
        n += 1
        text, media = node.fields.get("text"), node.fields.get("media") or []
        if text is not None and len(text) > limits.text:
            warnings[f"a text was truncated to {limits.text} characters"] = None
            text = text[: limits.text] + " […]"
        if len(media) > limits.media:
            warnings[f"media of an entry were truncated to {limits.media}"] = None
        yield {**place, "kind": "content", **node.fields, "text": text, "media": media[: limits.media]}
        below = [(r, node.key, "quote", depth + 1) for r in node.quoted] + [(r, node.key, "reply", depth + 1) for r in node.replies]
        stack += reversed(below)
    for warning in list(warnings)[:MAX_WARNINGS]:
        yield {"kind": "warning", "reason": warning}


def _number(value) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) and abs(value) < 1 << 53 else None


def _key(value) -> str | None:
    """An id of a platform: a text or a whole number."""
    return str(value) if (isinstance(value, str) and value.strip()) or _number(value) is not None else None


def _time(value: str | None) -> str | None:
    """A time in any of the platforms' spellings as ISO text."""
    if not isinstance(value, str):
        return None
    try:
        return datetime.strptime(value, "%a %b %d %H:%M:%S %z %Y").astimezone(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    except ValueError:
        return iso_time(value)


def _web(url) -> str | None:
    return url if isinstance(url, str) and url.startswith(("http://", "https://")) else None


def hacker_news(raw: str, limits: Limits) -> Iterator[dict]:
    """A root item and the items below it: ``{root, descendants}``, ``{rootItem, items}``, a list that begins with the root, or ``{root: id, items: {id: item}}``."""
    data = json.loads(raw)
    if isinstance(data, list):
        root, rest = data[0], data[1:]
    else:
        root = data["root"] if "root" in data else data["rootItem"]
        rest = data.get("descendants", data.get("items", []))
        rest = list(rest.values()) if isinstance(rest, dict) else rest
    items = {k: i for i in [*([root] if isinstance(root, dict) else []), *rest] if isinstance(i, dict) and (k := _key(i.get("id")))}
    if isinstance(data, dict) and isinstance(data.get("items"), dict):
        items = {**{str(k): v for k, v in data["items"].items()}, **items}
    start = _key(root["id"] if isinstance(root, dict) else root)
    if start is None:
        raise ValueError("the root has no id")

    def read(key: str) -> Node:
        item = items.get(key)
        gone = "not-found" if item is None else "deleted" if item.get("deleted") else "dead" if item.get("dead") else None
        item = item or {}
        linked_page = _web(item.get("url"))
        text = "\n\n".join(x for x in (comment_markdown(item.get("text")), f"[Linked article](<{linked_page}>)" if linked_page else None) if x)
        return Node(
            key,
            {
                "kind": "unavailable" if gone else "content", "reason": gone, "author_name": item.get("by"), "handle": item.get("by"), "created_at": epoch(item.get("time")),
                "source_url": f"https://news.ycombinator.com/item?id={key}", "likes": _number(item.get("score")), "replies": _number(item.get("descendants")),
                "title": item.get("title"), "text": None if gone else text,
            },
            [k for k in map(_key, item.get("kids") or []) if k],
        )

    return walked([start], read, limits)


def reddit(raw: str, limits: Limits) -> Iterator[dict]:
    """The two listings of a comments page; a ``more`` entry keeps how many it stands for in ``replies``."""
    post_list, comments = json.loads(raw)[:2]
    post = post_list["data"]["children"][0]

    def read(node: dict) -> Node | None:
        data = node.get("data") if isinstance(node, dict) else None
        if not isinstance(data, dict) or node.get("kind") not in ("t1", "t3", "more"):
            return None
        top = node["kind"] == "t3"
        body = data.get("selftext") if top else data.get("body")
        gone = {"[deleted]": "deleted", "[removed]": "removed"}.get(body)
        more = node["kind"] == "more"
        kind = "more" if more else "unavailable" if gone else "content"
        linked_page = _web(data.get("url")) if top else None
        said = "\n\n".join(x for x in (body, f"[Linked page](<{linked_page}>)" if linked_page else None) if x)
        below = data.get("replies")
        below = comments["data"]["children"] if top else below["data"]["children"] if isinstance(below, dict) else []
        return Node(
            _key(data.get("id")),
            {
                "kind": kind, "reason": gone, "author_name": data.get("author"), "handle": data.get("author"), "created_at": epoch(data.get("created_utc")),
                "source_url": f"https://www.reddit.com{data['permalink']}" if data.get("permalink") else None, "likes": _number(data.get("score")), "title": data.get("title"),
                "replies": _number(data.get("count")) if more else _number(data.get("num_comments")), "text": said if kind == "content" else None,
            },
            below,
        )

    return walked([post], read, limits)


def bluesky(raw: str, limits: Limits) -> Iterator[dict]:
    """A thread view: its ancestors from the top, then the post with its quotes and replies."""
    top = json.loads(raw)["thread"]
    chain, up = [], top.get("parent")
    while isinstance(up, dict) and len(chain) < limits.depth:
        chain.append(up)
        up = up.get("parent")
    parent = None
    for node in reversed(chain):
        entry = _bluesky_node(node)
        yield {"entry_id": entry.key, "parent_id": parent, "relation": "ancestor" if parent else "root", "tree_depth": 0, "kind": "content", **entry.fields}
        parent = entry.key
    for entry in walked([top], _bluesky_node, limits):
        yield {**entry, "parent_id": parent, "relation": "reply" if parent else "root"} if entry.get("relation") == "root" else entry


def _bluesky_node(node: dict) -> Node:
    post = node.get("post") or {}
    gone = "not-found" if node.get("notFound") else "blocked" if node.get("blocked") else None
    author, record = post.get("author") or {}, post.get("record") or node.get("value") or {}
    uri = post.get("uri") or node.get("uri") or ""
    author = author or node.get("author") or {}
    embed = post.get("embed") or {}
    shown = embed.get("media") or embed
    media = [{"kind": "image", "url": u} for i in shown.get("images") or [] if (u := _web(i.get("fullsize") or i.get("thumb")))]
    media += [{"kind": "video", "url": u} for u in (_web(shown.get("playlist")),) if u]
    quoted = embed.get("record") or {}
    quoted = quoted.get("record") if isinstance(quoted.get("record"), dict) else quoted
    handle, key = author.get("handle"), uri.rpartition("/")[2]
    return Node(
        key or None,
        {
            "kind": "unavailable" if gone else "content", "reason": gone, "author_name": author.get("displayName"), "handle": handle, "created_at": _time(record.get("createdAt")),
            "source_url": f"https://bsky.app/profile/{handle}/post/{key}" if handle else None, "text": record.get("text"), "media": media,
            "likes": _number(post.get("likeCount")), "replies": _number(post.get("replyCount")), "reposts": _number(post.get("repostCount")), "quotes": _number(post.get("quoteCount")),
        },
        node.get("replies") or [],
        [quoted] if quoted.get("uri") else [],
    )


def x_posts(raw: str, limits: Limits) -> Iterator[dict]:
    """Posts as ``{tweets: []}``, ``{tweet: {}}``, a list or one post, linked by ``inReplyToStatusId``; repeated ids once."""
    data = json.loads(raw)
    values = data if isinstance(data, list) else data["tweets"] if isinstance(data.get("tweets"), list) else [data.get("tweet", data)]
    posts: dict[str, dict] = {}
    notes = []
    for place, post in enumerate(values[: limits.items]):
        key = _key(post.get("id")) if isinstance(post, dict) and isinstance(post.get("text"), str) else None
        if key is None or key in posts:
            notes.append({"kind": "warning", "reason": f"malformed post {place} was skipped" if key is None else f"repeated post {key} was skipped"})
        else:
            posts[key] = post
    if len(values) > limits.items:
        notes.append({"kind": "warning", "reason": f"posts were truncated to {limits.items}"})
    if not posts:
        raise ValueError("no valid post")
    below: dict[str, list[dict]] = {}
    up = {k: _key(p.get("inReplyToStatusId")) for k, p in posts.items()}
    for k, parent in up.items():
        if parent in posts:
            below.setdefault(parent, []).append(posts[k])

    def read(post: dict) -> Node | None:
        key = _key(post.get("id")) if isinstance(post, dict) else None
        if key is None:
            return None
        author, quoted, article = post.get("author") or {}, post.get("quotedTweet"), post.get("article") or {}
        handle = author.get("username")
        media = [{"kind": m.get("type"), "url": u} for m in post.get("media") or [] if isinstance(m, dict) and (u := _web(m.get("videoUrl") or m.get("url") or m.get("previewUrl")))]
        return Node(
            key,
            {
                "author_name": author.get("name"), "handle": handle, "created_at": _time(post.get("createdAt")), "source_url": f"https://x.com/{handle}/status/{key}" if handle else None,
                "text": post.get("text"), "title": article.get("title"), "media": media, "likes": _number(post.get("likeCount")), "replies": _number(post.get("replyCount")),
                "reposts": _number(post.get("retweetCount")), "quotes": _number(post.get("quoteCount")),
            },
            below.get(key, []),
            [quoted] if isinstance(quoted, dict) else [],
        )

    roots = [p for k, p in posts.items() if up[k] not in posts]
    # a ring of replies has no root: its first post stands for one
    held = set()
    for k in posts:
        ring, at = [], k
        while at in posts and at not in held and at not in ring:
            ring.append(at)
            at = up[at]
        if at in ring:
            roots.append(posts[at])
        held.update(ring)
    return itertools.chain(walked(roots, read, limits), notes)


PARSERS = {"hacker-news": hacker_news, "reddit": reddit, "bluesky": bluesky, "x": x_posts}


def epoch(seconds: float | None) -> str | None:
    """Seconds since 1970 as ISO text with milliseconds, within the years 1970 to 9999."""
    if not isinstance(seconds, (int, float)) or not 0 <= seconds <= 253_402_300_799:
        return None
    return datetime.fromtimestamp(seconds, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def parse_threads(rows: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Entries of ``rows(thread_id, platform, raw)``; malformed or unknown input gives one boundary row with its reason."""
    limits = limits or Limits()
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "array<struct<kind:string,url:string>>": pa.list_(pa.struct([("kind", pa.string()), ("url", pa.string())]))}

    def entries(platform: str, raw: str | None) -> list[dict]:
        parser = PARSERS.get(platform)
        if parser is None or raw is None:
            return [{"kind": "boundary", "reason": "unsupported platform" if parser is None else "no content"}]
        try:
            return list(parser(raw, limits))
        except (ValueError, KeyError, TypeError, IndexError, AttributeError) as error:
            return [{"kind": "boundary", "reason": f"malformed: {type(error).__name__}"}]

    def run(batches):
        for batch in batches:
            owners, found = [], []
            for i, (platform, raw) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own = entries(platform, raw)
                found += [{**e, "ordinal": k} for k, e in enumerate(own)]
                owners += [i] * len(own)
            arrays = [batch.column(0).take(pa.array(owners, pa.int64()))]
            arrays += [pa.array([e.get(n) for e in found], kinds[t]) for n, t in ENTRY_FIELDS]
            yield pa.RecordBatch.from_arrays(arrays, ["thread_id", *[n for n, _ in ENTRY_FIELDS]])

    schema = "thread_id string, " + ", ".join(f"{n} {t}" for n, t in ENTRY_FIELDS)
    return rows.select("thread_id", "platform", "raw").mapInArrow(run, schema)
