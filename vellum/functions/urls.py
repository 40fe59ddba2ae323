"""URL expressions: platforms, canonical forms, slugs' parts. All JVM-side but for slugs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query keys that track or authenticate (fixed values).
TRACKING = ("fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "mibextid")
#: Words of query keys that authenticate (fixed values); their parts may be joined by a dash, an underscore or nothing.
CREDENTIAL_WORDS = (
    "access token", "refresh token", "auth", "authorization", "api key", "credential", "csrf", "xsrf", "jwt", "pass", "password", "passwd", "secret", "session id", "signature",
    "sig", "code", "ticket", "otp", "nonce", "key", "magic link", "one time",
)
CREDENTIAL_KEY = "(?i)(?:^|[-_])(?:" + "|".join(w.replace(" ", "[-_]?") for w in CREDENTIAL_WORDS) + ")(?:$|[-_])"
PLATFORMS = (
    "x", "hacker-news", "reddit", "bluesky", "substack", "instagram", "linkedin", "facebook", "tiktok", "threads", "whatsapp", "youtube",
    "github", "discourse", "generic",
)


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def path_parts(url: Column) -> Column:
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")
    return F.transform(parts, lambda p: F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p))


def parameter(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))


def within(name: Column, *domains: str) -> Column:
    """A host that is one of the domains or below it; look-alikes are not."""
    out = F.lit(False)
    for d in domains:
        out = out | (name == d) | name.endswith("." + d)
    return out


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def classified(url: Column) -> Column:
    """``struct(platform, content_id, href)`` of a web address; null for anything else."""
    name, parts = host(url), path_parts(url)
    web = url.rlike("(?i)^https?://[^/?#]+") & name.isNotNull()

    def part(i: int) -> Column:
        return F.get(parts, i)

    def after(word: str, steps: int = 1) -> Column:
        at = F.array_position(parts, word)
        return F.when(at > 0, F.get(parts, (at - 1 + steps).cast("int")))

    def is_id(c: Column, pattern: str) -> Column:
        return F.coalesce(c.rlike(f"^(?:{pattern})$"), F.lit(False))

    plain = without_fragment(url)

    def kind(platform: str, content_id: Column, href: Column = plain) -> Column:
        return F.struct(F.lit(platform).alias("platform"), content_id.cast("string").alias("content_id"), href.alias("href"))

    none = F.lit(None)
    item = parameter(url, "id")
    comment = after("comments", 3)
    topic = F.when(is_id(part(1), r"\d+"), part(1)).when(is_id(part(2), r"\d+"), part(2))
    forum = F.arrays_overlap(F.split(name, r"\."), F.array(*map(F.lit, ("discourse", "discuss", "forum", "community"))))
    github = is_id(part(0), r"[A-Za-z0-9_.-]+") & is_id(part(1), r"[A-Za-z0-9_.-]+") & part(2).isin("issues", "pull", "discussions") & is_id(part(3), r"\d+")
    activity = F.get(F.filter(parts, lambda p: p.rlike(r"(?:activity|ugcPost|share)[:-]?\d+")), 0)
    video = F.coalesce(parameter(url, "v"), F.when(part(0).isin("shorts", "live"), part(1)))
    return (
        F.when(~web | web.isNull(), none)
        .when(
            within(name, "x.com", "twitter.com") & (part(1) == "status") & is_id(part(0), r"[a-zA-Z0-9_]{1,32}") & is_id(part(2), r"\d+"),
            kind("x", part(2), F.concat(F.lit("https://x.com/"), part(0), F.lit("/status/"), part(2))),
        )
        .when(
            (name == "news.ycombinator.com") & (F.try_parse_url(url, F.lit("PATH")) == "/item") & is_id(item, r"\d+"),
            kind("hacker-news", item, F.concat(F.lit("https://news.ycombinator.com/item?id="), item)),
        )
        .when(
            within(name, "reddit.com") & is_id(after("comments"), "[a-zA-Z0-9]+"),
            kind("reddit", F.when(is_id(comment, "[a-zA-Z0-9]+"), comment).otherwise(after("comments"))),
        )
        .when((name == "redd.it") & is_id(part(0), "[a-zA-Z0-9]+"), kind("reddit", part(0)))
        .when(
            (name == "bsky.app") & (part(0) == "profile") & (part(2) == "post") & part(3).isNotNull(),
            kind("bluesky", part(3), F.concat(F.lit("https://bsky.app/profile/"), F.url_encode(part(1)), F.lit("/post/"), F.url_encode(part(3)))),
        )
        .when(within(name, "substack.com"), kind("substack", none))
        .when(within(name, "instagram.com"), kind("instagram", F.when(part(0).isin("p", "reel", "tv"), part(1))))
        .when(within(name, "linkedin.com"), kind("linkedin", F.coalesce(activity, part(1))))
        .when(
            within(name, "facebook.com") | name.isin("fb.com", "fb.watch"),
            kind("facebook", F.coalesce(parameter(url, "story_fbid"), parameter(url, "v"), F.try_element_at(parts, F.lit(-1)))),
        )
        .when(within(name, "tiktok.com"), kind("tiktok", F.when(F.array_position(parts, "video") > 0, after("video")).otherwise(part(0))))
        .when(within(name, "threads.com", "threads.net"), kind("threads", after("post")))
        .when(name == "web.whatsapp.com", kind("whatsapp", none))
        .when(name == "youtu.be", kind("youtube", part(0)))
        .when(within(name, "youtube.com"), kind("youtube", video))
        .when((name == "github.com") & github, kind("github", part(3)))
        .when(forum & (part(0) == "t") & topic.isNotNull(), kind("discourse", topic))
        .otherwise(kind("generic", none))
    )


def canonical(url: Column) -> Column:
    """The address without fragment and without parameters that track or authenticate; hosts of X are one."""
    bare = without_fragment(url)
    bare = F.when(within(host(url), "twitter.com", "x.com"), F.regexp_replace(bare, r"(?i)^(https?://)(?:[a-z0-9-]+\.)*(?:twitter|x)\.com(?=[/?:]|$)", "$1x.com")).otherwise(bare)
    head, query = F.substring_index(bare, "?", 1), F.regexp_extract(bare, r"\?(.*)$", 1)
    on_x = within(host(url), "x.com", "twitter.com")

    def kept(pair: Column) -> Column:
        key = F.substring_index(pair, "=", 1)
        low = F.lower(key)
        return (pair != "") & ~low.startswith("utm_") & ~low.isin(*TRACKING) & ~key.rlike(CREDENTIAL_KEY) & ~(on_x & key.isin("s", "t"))

    left = F.array_join(F.filter(F.split(query, "&"), kept), "&")
    return F.when(left == "", head).otherwise(F.concat(head, F.lit("?"), left))


def scope(platform: Column) -> Column:
    """What a capture of a platform's page covers by itself."""
    return F.when(platform.isin("hacker-news", "reddit", "github", "discourse"), "comments").when(platform.isin("x", "bluesky"), "thread").otherwise("page")


def slug(text: str | None) -> str | None:
    """One lower-case path segment of at most 80 characters."""
    if text is None:
        return None
    folded = unicodedata.normalize("NFKC", text[:16384]).lower().replace("'", "").replace("’", "")
    joined = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "N" else "-" for c in folded)
    return re.sub("-+", "-", joined).strip("-")[:80].rstrip("-")


@F.pandas_udf(T.StringType())
def slugs(texts: pd.Series) -> pd.Series:
    return texts.map(slug)


def with_id(base: Column, content_id: Column) -> Column:
    """A slug that ends in its content's id, still within 80 characters."""
    room = F.greatest(F.lit(1), 79 - F.length(content_id))
    head = F.regexp_replace(F.substr(base, F.lit(1), room), "-+$", "")
    named = F.concat(F.when(head == "", "post").otherwise(head), F.lit("-"), content_id)
    same = (base == content_id) | base.endswith(F.concat(F.lit("-"), content_id))
    return F.when(content_id.isNull() | (content_id == "") | same, base).otherwise(named)
