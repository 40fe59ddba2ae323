"""Noise in text from scanned pages: page furniture, page numbers, cut and misread words.

The corpus vocabulary says which words are sound: those that documents without any trace
of recognition errors use about as often as all documents do. What recognition takes for
what is learnt from the corpus: unknown words are compared with the sound ones that differ
in one place, and the pairs that explain ``RATE`` of them at least are its confusions.

Furniture is told by repetition: the lines at a page's edges (``EDGE_LINES`` a side) are
compared, letters only and folded over confusions, with those of other pages. A line is
furniture where it returns at the edges of ``RETURNS`` pages of its document, or of
``DOCUMENTS`` documents and is seldom seen elsewhere, or is almost such a line of its
document; and a number is a page number where its difference to the page is that of
a page next to it or after that, or none (number sequences, also Roman). Lines set larger
than the text are headings, not furniture; a line inside is furniture only where all lines
outside of it are. A hyphen at a line's end cuts a word where the two halves make a sound
word and not a compound. A word is misread where it is not sound but one or two confusions,
a lost blank or an added blank away from sound words; stray marks count too.

Pages are read one at a time from partitions sorted by document and page, documents cut
into runs of pages that bring their neighbours along, so a document is never held whole. Blocks
get the findings of the lines they hold; what no fragment of the page covers of a block is
read as lines of its own, in the places of the fragments without text. The vocabulary
reaches the workers whole: every word that clean documents attest, however rare. Its size
grows with the number of such words.

A repaired document is its paragraphs: what a block leaves open goes on in the next one, also
over a page's end; pages without blocks are read from their fragments.

Defined results: null and empty texts hold nothing; repeated rows each give theirs; lines
without document or page are read alone; ties of order go by text. Extra columns are
ignored.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.lookalikes import uniform
from vellum.session import written
from vellum.sources.tables import table

#: Least occurrences of a word, and in clean documents; share of its usual rate that a sound word has there.
LEAST, CLEAN, FAIR = 4, 3, 0.2
#: Share of explained misreadings that makes a pair a confusion, and words that show it.
RATE, SHOWN = 0.002, 3
#: Lines of a page's edge that are looked at; pages of a document, or documents, at whose edges furniture returns.
EDGE_LINES, RETURNS, DOCUMENTS = 2, 2, 3
#: What a line's type is times the page's text in headings.
LARGER = 1.05
#: Pages of a document that one group of rows holds.
RUN_PAGES = 64
#: Kinds of blocks as numbers; text of kinds from ``RUNNING`` on goes on with what is open before it, or is left open.
KINDS, RUNNING = {"heading": 0, "image": 0, "list-item": 1, "paragraph": 2}, 1

#: What stands in for confusions where a corpus shows none (fixed values): wrong characters, then the right ones.
CONFUSIONS = (("rn", "m"), ("cl", "d"), ("c", "e"), ("b", "h"), ("f", "t"), ("1", "l"), ("l", "i"), ("0", "o"), ("n", "u"), ("vv", "w"))
_STRAY = r"|¦^~\\`"
_TOKEN = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_CODE = re.compile(r"\S*\d[:/.-]\S*")
_CUT = re.compile(rf"([^\W_]+)([-¬=‐\xad])[\s{_STRAY}·]*$")
_CUTS, _AFTER_CUT = frozenset("-¬=‐\xad"), " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0|¦^~\\`·"
_NEXT = re.compile(rf"[\s{_STRAY}]*([^\W_]+)(?: ([^\W\d_]+))?")
_ROMAN = re.compile(r"(?:x{0,3})(?:ix|iv|v?i{0,3})", re.I)
_NUMBER = re.compile(r"(?<![\w])[\dlIO|]*\d[\dlIO]*(?!\w)")
_DIGIT_OF = str.maketrans("lI|OoSZBGgq", "11100528699")
_SET_OFF = re.compile(r"^(\W*\d+) [|¦·/–—-] (?=\w)|(?<=\w) [|¦·/–—-] (\d+\W*)$")
_PAGE_WORDS = ("page", "pages", "of", "p", "pp", "seite", "von", "sur", "de", "pag", "página", "s")
_DOT = re.compile(r"(?<=\w)·|(?<=\w[.,;:?!\])]) ·$|(?<=\w) ·$|\w ·,")
_MARKS = re.compile(rf"[{_STRAY}]")
_ENDED = re.compile(r"[.!?:;。！？…][\"'”’»)\]]*$")
_ITEM = re.compile(r"(?:[•▪◦*–-]|\d{1,3}[.)]|[a-z][.)])\s")
_BETWEEN = ("and", "or", "und", "oder", "bzw", "et", "ou", "y", "e", "o", "u")
_LEADING = re.compile(rf"^[\s{_STRAY}]+")
_TAIL = re.compile(rf"[\s{_STRAY}·]+$")


def _near(a: str, b: str) -> bool:
    """Whether a word is another but for two wrong characters at most, of three or more."""
    if a == b:
        return True
    if len(b) < 4 or abs(len(a) - len(b)) > 1:
        return len(b) == 2 and len(a) == 2 and (a[0] == b[0] or a[1] == b[1])
    return sum(x != y for x, y in zip(a, b, strict=False)) + abs(len(a) - len(b)) <= 2


#: Characters that recognition confuses, as one; those of a line are compared.
_FOLD = str.maketrans("1l!|0cbfnu59", "iiiioehtaasg")
_JOINED = (("ra", "m"), ("ei", "d"), ("vv", "w"), ("ii", "a"), ("ri", "a"))  # rn, cl, vv, ii and ri, so folded


def _folded(text: str) -> str:
    text = text.casefold().translate(_FOLD)
    for bad, good in _JOINED:
        text = text.replace(bad, good)
    return text


def edge_key(text: str) -> str:
    """Equal for lines whose letters differ in usual confusions only; numbers and marks are left out."""
    words = [w for w in _MARKS.sub(" ", text).split() if not _NUMBER.fullmatch(w.strip("[]().,–—-"))]
    return _folded("".join(c for c in "".join(words) if c.isalnum()))


def has_title(text: str) -> bool:
    """Whether a line of page furniture holds more than a page number in any form."""
    bare = " ".join(_MARKS.sub(" ", text).split())
    core = bare.strip(" []()-–—.·")
    if core and _ROMAN.fullmatch(core):
        return False
    number = bool(_NUMBER.search(bare))
    words = re.findall(r"[^\W_]*[^\W\d_][^\W_]*", _NUMBER.sub(" ", bare))
    title = [w for w in words if not (number and len(w) <= 7 and any(_near(_folded(w), _folded(p)) for p in _PAGE_WORDS))]
    return sum(map(len, title)) >= 2


_ROMANS = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def _roman(word: str) -> int:
    values = [_ROMANS[c] for c in word]
    return sum(-v if v < w else v for v, w in zip(values, [*values[1:], 0], strict=True))


def page_numbers(text: str) -> list[int]:
    """The numbers that a line may hold, also Roman or with letters read for digits."""
    # a mark alone may be a one
    words = re.findall(r"[^\W_]+", _MARKS.sub(" ", text)) or ["1"] * (text.strip() in ("|", "¦"))
    out = set()
    for word in words:
        if len(word) > 6:
            continue
        digits = word.translate(_DIGIT_OF)
        if digits.isascii() and digits.isdigit() and (any(c.isdigit() for c in word) or len(words) <= 3):
            out.add(int(digits))
        low = word.casefold().translate(str.maketrans("l1!", "iii"))
        if low and len(words) <= 3 and _ROMAN.fullmatch(low):
            out.add(_roman(low))
    return sorted(out)


class Vocabulary:
    """Sound words with their counts, and what recognition takes for what, the usual first."""

    def __init__(self, sound: dict[str, int], confusions: list[tuple[str, str]] | None = None) -> None:
        self.sound, self.known = sound, {}
        self.confusions = confusions or list(CONFUSIONS)
        self.rights: dict[str, list[str]] = {}
        for bad, good in self.confusions:
            self.rights.setdefault(bad, []).append(good)
        self.usual = {bad: [g for g in goods if (bad, g) in self.confusions[:20]] for bad, goods in self.rights.items()}
        self.ordered, self.reversed = sorted(sound), sorted(w[::-1] for w in sound)
        self.common = sorted(sound.values())[-(len(sound) // 20 + 1)] if sound else 0

    def begins(self, part: str) -> bool:
        """Whether a sound word begins with ``part``."""
        part = part.casefold()
        at = bisect_left(self.ordered, part)
        return at < len(self.ordered) and self.ordered[at].startswith(part)

    def right(self, word: str) -> str | None:
        """The sound word that ``word`` was most likely read from; itself where it is sound, None where unknown."""
        word = word.casefold()
        if word in self.sound:
            return word
        if word not in self.known:
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[word] = self._right(word)
        return self.known[word]

    def _right(self, word: str) -> str | None:
        if len(word) < 2 or word.isdigit():
            return None
        once = _corrected(word, self.rights)
        best = max((w for w in once if w in self.sound), key=self.sound.get, default=None)
        if best is None and len(word) >= 3:
            twice = {x for w in once for x in _corrected(w, self.usual)}
            least = 0 if len(word) > 3 else self.common  # of short words only the commonest are that near
            best = max((w for w in twice if w in self.sound and len(w) > 2 and self.sound[w] >= least), key=self.sound.get, default=None)
        if best is None and len(word) >= 5:
            best = max((w for w in self._edited(word) if len(w) > 4), key=self.sound.get, default=None)
        return best

    def _edited(self, word: str) -> list[str]:
        """Sound words one character away: among those that share its first or its last half, or where these are many, by trying all."""
        half = len(word) // 2
        ranges = []
        for words, part in ((self.ordered, word[:half]), (self.reversed, word[: half - 1 : -1])):
            lo = bisect_left(words, part)
            ranges.append((words, lo, bisect_right(words, part + "\U0010ffff", lo)))
        if sum(hi - lo for _, lo, hi in ranges) > 500:
            edits = {word[:i] + word[i + 1 :] for i in range(len(word))}
            edits |= {word[:i] + c + word[j:] for i in range(len(word) + 1) for j in (i, i + 1) for c in _LETTERS}
            return [w for w in edits if w in self.sound]
        (first, a, b), (last, c, d) = ranges
        return [w for w in {*first[a:b], *(w[::-1] for w in last[c:d])} if _one_off(word, w)]

    def split(self, word: str) -> tuple[str, str] | None:
        """Two sound words that ``word`` runs together."""
        word = word.casefold()
        cuts = [(word[:i], word[i:]) for i in range(1, len(word)) if word[:i] in self.sound and word[i:] in self.sound]
        cuts = [c for c in cuts if min(map(len, c)) > 1 or min(c, key=len) in ("a", "à", "y", "o", "e", "l", "d", "n", "i")]
        return max(cuts, key=lambda c: min(self.sound[c[0]], self.sound[c[1]]), default=None)


_LETTERS = "abcdefghijklmnopqrstuvwxyzéèäüö"


def _one_off(word: str, other: str) -> bool:
    """Whether one character less, more or other of the usual letters makes ``word`` the other."""
    longer = len(other) - len(word)
    if not -1 <= longer <= 1 or word == other:
        return False
    at = next((i for i, (a, b) in enumerate(zip(word, other, strict=False)) if a != b), min(len(word), len(other)))
    if longer < 0:
        return other[at:] == word[at + 1 :]
    return other[at] in _LETTERS and other[at + 1 :] == word[at + (longer == 0) :]


def _corrected(word: str, rights: dict[str, list[str]]) -> set[str]:
    """The words that one confusion away may have been read as ``word``."""
    out = set()
    for i in range(len(word)):
        for j in (i + 1, i + 2):
            for good in rights.get(word[i:j], ()) if j <= len(word) else ():
                out.add(word[:i] + good + word[j:])
    return out


def cut_word(line: str, following: str | None, known: Vocabulary) -> tuple[str, str] | None:
    """The halves of a word cut at the line's end, or None; a compound at its own hyphen is none."""
    if line.rstrip(_AFTER_CUT)[-1:] not in _CUTS:
        return None
    m = _CUT.search(line)
    n = _NEXT.match(following) if m and following else None
    if not m or m.group(1).isdigit():
        return None
    a, mark = m.group(1), m.group(2)
    if n and not n.group(1).isdigit():
        b = n.group(1)
        whole, rest = (a + b).casefold(), b.casefold()
        if whole in known.sound or (n.group(2) and whole + n.group(2).casefold() in known.sound and rest not in known.sound):
            return a, b
        if rest not in known.sound and any(whole[:i] in known.sound and whole[i:] in known.sound for i in range(len(a) + 1, len(whole) - 1)):
            return a, b
        if mark in "¬=\xad":
            return a, b
        compound = f"{a}-{b}".casefold() in known.sound or (known.right(a) is not None and rest in known.sound)
        if not compound and not b[0].isupper() and known.right(a + b) is not None:
            return a, b
    # its other half is lost, but what stands here only begins a word
    return (a, "") if n and len(a) > 2 and known.right(a) is None and known.begins(a) else None


def misread(line: str, known: Vocabulary, skip_first: str | None, skip_last: str | None, furniture: bool) -> bool:
    """Whether recognition left a wrong character, blank or mark in the line."""
    text = _SET_OFF.sub(" ", line) if furniture else line  # a mark may set a page number off
    if _MARKS.search(text) or ("·" in text and _DOT.search(text)):
        return True
    if all(w.isdigit() for w in set(_TOKEN.findall(text.casefold())).difference(known.sound)):
        return False
    text = _CODE.sub(lambda m: " " * len(m.group()), text)
    words = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
    if skip_first and words and words[0][0] == skip_first:
        words = words[1:]
    if skip_last and words and words[-1][0] == skip_last:
        words = words[:-1]
    if furniture:
        words = [w for w in words if not (_ROMAN.fullmatch(w[0]) or w[0].casefold() in _PAGE_WORDS)]
    for k, (word, start, end) in enumerate(words):
        low = word.casefold()
        if low in known.sound or word.isdigit():
            continue
        if "-" in word and all(p in known.sound or p.isdigit() for p in low.split("-")):
            continue
        if "-" in word and any(p not in known.sound and known.right(p) is not None for p in low.split("-")):
            return True
        if k + 1 < len(words) and text[end : words[k + 1][1]] == " " and low + words[k + 1][0].casefold() in known.sound:
            return True
        if k and text[words[k - 1][2] : start] == " " and words[k - 1][0].casefold() + low in known.sound:
            return True
        if known.right(word) is not None or (len(word) > 3 and known.split(word)):
            return True
        if furniture and (any(_near(_folded(low), _folded(p)) and low != p for p in ("page", "seite")) or (low.translate(_DIGIT_OF).isdigit() and any(c.isdigit() for c in low))):
            return True
    return False


def _lines(rows: DataFrame) -> DataFrame:
    """Distinct lines, folded to one form; what recognition and typography share is not its error."""

    @F.pandas_udf(T.StringType())
    def folded(texts: pd.Series) -> pd.Series:
        return texts.map(uniform, na_action="ignore")

    # a soft hyphen that ends a line is seen
    rows = rows.withColumn("text", F.regexp_replace("text", r"\xAD(?=\s|$)", "-"))
    return rows.withColumn("text", F.when(F.octet_length("text") == F.length("text"), F.col("text")).otherwise(folded("text")))


#: The letters of a word at a line's end before a mark that cuts it.
_LINE_CUT = re.compile(r"[-¬=‐\xad]\W*$")
_WORDS = re.compile(r"[^\W_]+(?:-[^\W\d_]+)*")


def vocabulary(lines: DataFrame) -> DataFrame:
    """``(word, n, sound, fair)`` of all words: which may be sound, and which clean documents use as often as others; ``lines`` has ``pdf_id``, ``page_no`` and ``text``."""
    marked = F.col("text").rlike(rf"[{_STRAY}¬]|=$")
    noisy = lines.groupBy("pdf_id").agg((F.sum(marked.cast("int")) > 0).alias("noisy"))

    def count(batches):
        for batch in batches:
            clean: Counter = Counter()
            all_words: Counter = Counter()
            ends: dict[str, list[int]] = {}
            for text, dirty, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = _WORDS.findall(text.lower())
                # a word that a line's end may have cut tells nothing: the first of a line is left out, and the last before a hyphen
                words = words[1 : -1 if _LINE_CUT.search(text) else None]
                if "-" in text:
                    words += [p for w in words if "-" in w for p in w.split("-")]  # the parts of compounds are words too
                all_words.update(words)
                if not dirty:
                    clean.update(words)
                for w in words:
                    end = ends.get(w)
                    if end is None:
                        ends[w] = [page, page]
                    elif page < end[0]:
                        end[0] = page
                    elif page > end[1]:
                        end[1] = page
            keys = list(all_words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), *[pa.array(c, pa.int64()) for c in ([all_words[k] for k in keys], [clean[k] for k in keys], [ends[k][0] for k in keys], [ends[k][1] for k in keys])]],
                ["word", "n", "clean", "first", "last"],
            )

    rows = lines.join(noisy, "pdf_id").select("text", "noisy", F.xxhash64("pdf_id", "page_no"))
    # counts are combined before the shuffle, so no word and no document is hot
    counts = rows.mapInArrow(count, "word string, n long, clean long, first long, last long").groupBy("word").agg(
        F.sum("n").alias("n"), F.sum("clean").alias("clean"), (F.min("first") != F.max("last")).alias("spread")
    )
    counts = written(counts, "scan-words")
    total = counts.agg(F.sum("n").alias("n"), F.sum("clean").alias("clean")).first()
    n, clean = total["n"] or 1, total["clean"] or 0
    if clean >= 0.02 * n:
        sound = F.col("clean") >= CLEAN
        fair = sound & (F.col("clean") / F.lit(float(clean)) >= FAIR * F.col("n") / F.lit(float(n)))
    else:
        sound, fair = F.lit(True), F.lit(False)  # where no document is clean every repeated word may be sound
    firm = F.col("spread") & (F.col("n") >= LEAST)
    return counts.select("word", "n", (firm & sound).alias("sound"), (firm & fair).alias("fair"))


def learnt_confusions(words: DataFrame) -> list[tuple[str, str]]:
    """``(wrong, right)`` that explain unknown words of :func:`vocabulary`, the most frequent first; at most ``1 / RATE``.

    Unknown and sound words meet where they are equal but for one place of one or two
    characters on either side. A word counts once, shared among what explains it.
    """
    whole = F.col("word")

    def cuts(k: int):
        def at(i):
            frame = F.concat(F.substr(whole, F.lit(1), i), F.lit("\1"), F.substr(whole, i + k + 1, F.length(whole)))
            return F.struct(frame.alias("frame"), F.substr(whole, i + 1, F.lit(k)).alias("part"))

        return F.transform(F.sequence(F.lit(0), F.length(whole) - k), at)

    cut = F.concat(cuts(1), cuts(2))
    letters = words.filter((F.length("word") >= 4) & F.col("word").rlike(r"^[\p{L}\p{N}]+$"))
    frames = letters.select("word", "sound", F.inline(cut)).filter(F.length("frame") >= 4)
    bad = frames.filter("NOT sound").select(F.col("word").alias("unknown"), "frame", F.col("part").alias("bad"))
    good = frames.filter("sound").select("frame", F.col("part").alias("good"))
    # what differs in one character is no pair of two
    shared = (F.length("bad") == 2) & (F.length("good") == 2) & ((F.substring("bad", 1, 1) == F.substring("good", 1, 1)) | (F.substring("bad", 2, 1) == F.substring("good", 2, 1)))
    extra = (F.length("bad") != F.length("good")) & (F.col("bad").contains(F.col("good")) | F.col("good").contains(F.col("bad")))
    met = written(bad.join(good, "frame").filter((F.col("bad") != F.col("good")) & ~shared & ~extra).select("unknown", "bad", "good").distinct(), "scan-pairs")
    ways = met.groupBy("unknown").agg((1 / F.count(F.lit(1))).alias("weight"))
    found = met.join(ways, "unknown").groupBy("bad", "good").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("shown"))
    total = found.agg(F.sum("weight")).first()[0] or 1.0
    rows = found.filter((F.col("weight") >= RATE * total) & (F.col("shown") >= SHOWN)).orderBy(F.desc("weight"), "bad", "good").collect()
    return [(r["bad"], r["good"]) for r in rows]


def sound_words(rows: list[tuple[str, int, bool]], confusions: list[tuple[str, str]]) -> dict[str, int]:
    """Of ``(word, n, fair)`` that may be sound the fair ones, and those that are no misreading of a far more frequent one."""
    every = {w: n for w, n, _ in rows}
    sound = {w: n for w, n, fair in rows if fair}
    known = Vocabulary(dict(sound) or every, confusions)
    for word, n, fair in rows:
        if not fair:
            near = known._right(word)
            if near is None or near == word or every[near] < 5 * n:
                sound[word] = n
    return sound


_OUT = T.StructType([T.StructField("tbl", T.StringType()), T.StructField("row_id", T.LongType()), T.StructField("defect", T.StringType()), T.StructField("text", T.StringType())])
_PARTS = T.StructType(
    [
        T.StructField("tbl", T.StringType()), T.StructField("row_id", T.LongType()), T.StructField("pdf_id", T.StringType()), T.StructField("page_no", T.LongType()),
        T.StructField("ordinal", T.LongType()), T.StructField("text", T.StringType()), T.StructField("flag", T.StringType()), T.StructField("run", T.LongType()),
    ]
)


class Page:
    """One page's distinct lines and blocks in order, its furniture told from its content."""

    def __init__(self, rows: list[tuple]) -> None:
        """``rows``: (tbl, row_id, ordinal, text, size); those of ``tbl`` "edges" say that a line (text) returns (ordinal 1), holds a number of a sequence (2), or both."""
        self.lines: dict[tuple, list[int]] = {}
        self.blocks: dict[tuple, list[int]] = {}
        self.kinds: dict[tuple, float] = {}
        sizes: dict[tuple, float | None] = {}
        self.sizes = sizes
        lost: dict[int, float | None] = {}
        self.returns: dict[str, int] = {}
        for tbl, row_id, ordinal, text, size in rows:
            if tbl == "edges":
                self.returns[" ".join(text.split())] = ordinal
            elif text:
                key = (ordinal if ordinal is not None else 1 << 30, text)
                (self.lines if tbl == "pdf_fragments" else self.blocks).setdefault(key, []).append(row_id)
                if tbl == "pdf_fragments":
                    sizes[key] = size
                elif size is not None:
                    self.kinds[key] = size
            elif ordinal is not None:
                lost[ordinal] = size
        order = sorted(self.lines)
        weights: dict[float, int] = {}
        for key in order:
            if sizes[key] is not None:
                weights[sizes[key]] = weights.get(sizes[key], 0) + len(key[1])
        self.body = max(weights, key=lambda s: (weights[s], s)) if weights else None

        for key in self.lines:
            lost.pop(key[0], None)
        self.held = sorted(self.blocks)
        self.block_of = self._placed(order, lost, sizes)
        self.order = sorted({*order, *self.block_of})
        self.edge: set[tuple] = set()
        for side in (self.order, self.order[::-1]) if len(self.order) > 1 else ():
            outside, places = 0, set()
            for key in side:
                places.add(key[0])
                if len(places) > EDGE_LINES or not self.furniture(key):
                    break
                outside += 1
            self.edge.update(side[:outside])
        self.content = [k for k in self.order if k not in self.edge]

    def returned(self, key: tuple) -> int:
        return self.returns.get(" ".join(key[1].split()), 0)

    def furniture(self, key: tuple) -> bool:
        """Whether a line at the edge returns on other pages, or holds nothing but a number of their sequence."""
        mark = self.returned(key)
        return not self.large(key) and bool(mark & 1 or (mark & 2 and not has_title(key[1])))

    def large(self, key: tuple) -> bool:
        """Whether a line is set larger than the page's text, as headings are."""
        return bool(self.body) and self.sizes.get(key) is not None and self.sizes[key] > self.body * LARGER

    def _placed(self, order: list[tuple], lost: dict[int, float | None], sizes: dict[tuple, float | None]) -> dict[tuple, tuple]:
        """The block of each line; what no fragment covers comes in as lines of its own, placed and sized as fragments without text (``lost``) where these stand there."""
        starts, breaks, flat = [], [], " "
        for key in self.held:
            starts.append(len(flat))
            for line in key[1].split("\n"):
                if shown := " ".join(line.split()):
                    breaks.append(len(flat))
                    flat += shown + " "

        def block(at: int) -> tuple:
            return self.held[bisect_right(starts, at) - 1]

        of: dict[tuple, tuple] = {}
        covered: list[tuple[int, int, tuple]] = []
        cursor = 0
        for key in order:
            shown = " ".join(key[1].split())
            whole = f" {shown} "
            at = next((x for x in (flat.find(whole, cursor), flat.find(whole)) if x >= 0), -2) + 1
            at = at if at >= 0 else next((x for x in (flat.find(shown, cursor), flat.find(shown)) if x >= 0), -1)
            if not shown or at < 1:
                continue
            of[key] = block(at)
            cursor = at + len(shown)
            covered.append((at, cursor, key))
        covered.sort()
        free = sorted(lost)
        end, last = 1, None
        for start, stop, key in [*covered, (len(flat), len(flat), None)]:
            if start > end and flat[end:start].strip():
                place = last[0] if last else min([*free[:1], key[0] if key else 0]) - 1
                for begin, piece in _pieces(flat, end, start, breaks):
                    o = next((o for o in free if o > place and (key is None or o < key[0])), None)
                    if o is None:
                        place += 1e-6
                    else:
                        free.remove(o)
                        place = o
                        sizes[place, piece] = lost[o]
                    of[place, piece] = block(begin)
            if stop > end:
                end, last = stop, key
        return of


def _pieces(flat: str, start: int, stop: int, breaks: list[int]):
    """The lines in a stretch: whole words, up to a line's end or a mark that cuts a word."""
    while start < stop and flat[start - 1] != " ":
        start += 1
    while stop > start and stop < len(flat) and flat[stop - 1] != " ":
        stop -= 1
    begin = start
    for m in re.finditer(r"\S+", flat[start:stop]):
        after = start + m.end() + 1
        k = bisect_left(breaks, after)
        if after >= stop or (k < len(breaks) and breaks[k] == after) or _CUT.search(m.group()):
            yield begin, flat[begin : after - 1]
            begin = after


def page_findings(page: Page, before: str | None, after: str | None, known: Vocabulary, repair: bool) -> list[tuple]:
    """Findings of a page between the last line of text before it and the first after it."""
    order, edge, content, lines, blocks = page.order, page.edge, page.content, page.lines, page.blocks
    found: dict[tuple, set[str]] = {k: set() for k in order}
    halves: dict[tuple, list[str | None]] = {k: [None, None] for k in order}
    for i, key in enumerate(content):
        nxt = content[i + 1] if i + 1 < len(content) else None
        if nxt is not None and nxt[0] == key[0]:
            nxt = next((k for k in content[i + 1 :] if k[0] > key[0]), None)
        cut = cut_word(key[1], nxt[1] if nxt else after, known)
        if cut:
            found[key].add("hyphen")
            halves[key][1] = cut[0]
            if nxt:
                halves[nxt][0] = cut[1]
    if content and before is not None and (cut := cut_word(before, content[0][1], known)):
        halves[content[0]][0] = cut[1]
    for key in order:
        if key in edge:
            found[key] |= ({"page_number"} if page.returned(key) & 2 else set()) | ({"header"} if has_title(key[1]) else set())
        if misread(key[1], known, *halves[key], key in edge):
            found[key].add("misread")
    out = [("pdf_fragments", i, d, None) for k in order for d in found[k] for i in lines.get(k, ())]
    of_block: dict[tuple, set[str]] = {k: set() for k in page.held}
    for key, block in page.block_of.items():
        of_block[block] |= found[key]
    if not repair:
        return out + [("pdf_blocks", i, d, None) for k in page.held for d in of_block[k] for i in blocks[k]]
    furniture = {" ".join(k[1].split()) for k in edge}
    return [("pdf_blocks", i, "", repaired(k[1], furniture, known)) for k in page.held for i in blocks[k]]


def repaired(text: str, furniture: set[str], known: Vocabulary) -> str:
    """A block's text without furniture, cut words joined, misread words and marks put right."""
    flat = " ".join(text.split())
    for line in sorted(furniture, key=len, reverse=True):
        flat = flat[len(line) :].lstrip() if flat.startswith(line) else flat
        flat = flat[: -len(line)].rstrip() if flat.endswith(line) else flat

    def join(m: re.Match) -> str:
        cut = cut_word(m.group(1) + m.group(2), m.group(3), known)
        if cut and cut[1]:
            return m.group(1) + m.group(3)
        a, b = m.group(1).casefold(), m.group(3).casefold()
        # a compound, or a code, that breaks at its own hyphen
        own = m.group(2) == "-" and b not in _BETWEEN and (a == "k" or (known.right(a) is not None and known.right(b) is not None))
        return f"{m.group(1)}-{m.group(3)}" if own else m.group()

    flat = re.sub(r"([^\W_]+)([-¬=‐\xad]) ([^\W_]+)", join, flat)
    flat = " ".join(_MARKS.sub(" ", flat).split())

    def put_right(m: re.Match) -> str:
        word = m.group()
        if word.casefold() in known.sound or word.isdigit():
            return word
        good = known.right(word)
        if good is None:
            pair = known.split(word) if len(word) > 3 else None
            good = " ".join(pair) if pair else None
        return word if good is None else good.upper() if word.isupper() and len(word) > 1 else good.capitalize() if word[0].isupper() else good

    return re.sub(r"(?<![\w-])[^\W_]+(?![\w-])", put_right, flat)


class Part:
    """A block's text, or some lines of a page without blocks; later parts that go on with it are added."""

    def __init__(self, tbl: str, ids: list[int], ordinal: int, text: str, runs: bool) -> None:
        self.tbl, self.ids, self.ordinal, self.text, self.runs = tbl, ids, ordinal, text, runs
        self.end = text

    def takes(self, other: Part, turned: bool, known: Vocabulary) -> bool:
        """Whether ``other``, the next part, goes on with this one; ``turned`` at a page's end."""
        end = _TAIL.sub("", self.end)
        if not (self.runs and other.runs and end) or _ITEM.match(other.text) or (_ENDED.search(end) and not _CUT.search(end)):
            return False
        begin = _LEADING.sub("", other.text)
        return turned or begin[:1].islower() or cut_word(end, begin, known) is not None

    def add(self, text: str) -> None:
        self.text, self.end = joined(self.text, text), text


def joined(text: str, more: str) -> str:
    return _TAIL.sub("", text) + " " + _LEADING.sub("", more)


def parts(page: Page) -> list[Part]:
    """The parts of a page's content in order, those of furniture with no text."""
    out = []
    for key in page.held:
        flat = " ".join(key[1].split())
        for line in sorted((" ".join(k[1].split()) for k in page.edge if page.block_of.get(k) == key), key=len, reverse=True):
            if f"{flat} ".startswith(f"{line} "):
                flat = flat[len(line) :].lstrip()
            elif f" {flat}".endswith(f" {line}"):
                flat = flat[: -len(line)].rstrip()
        out.append(Part("pdf_blocks", page.blocks[key], key[0], flat, page.kinds.get(key, RUNNING) >= RUNNING))
    if out:
        return out
    longest = max((len(k[1]) for k in page.content), default=0)
    last = None
    for key in page.content:
        line, large = " ".join(key[1].split()), page.large(key)
        begins = last is None or page.sizes.get(last) != page.sizes.get(key) or _ITEM.match(line) or (_ENDED.search(last[1].rstrip()) and len(last[1]) < 0.8 * longest)
        if begins:
            out.append(Part("pdf_fragments", page.lines[key][:1], key[0], line, not large))
        else:
            out[-1].add(line)
        last = key
    return out


def findings(fragments: DataFrame, blocks: DataFrame, repair: bool = False) -> DataFrame:
    """``(tbl, row_id, defect)`` of both tables, or with ``repair`` every block's text put right by itself."""
    rows, shared = _runs(fragments, blocks)

    def run(batches):
        known = shared.value
        stream = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        found: list[tuple] = []
        for _, group in itertools.groupby(stream, key=lambda r: r[:2]):
            for page, before, after in _neighbours(group):
                found += page_findings(page, before, after, known, repair)
                if len(found) > 20_000:
                    yield _emitted(found)
                    found = []
        yield _emitted(found)

    return rows.mapInArrow(run, _OUT)


def paragraphs(fragments: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(tbl, row_id, pdf_id, page_no, ordinal, text)``: a row a block, and of pages without blocks a row a paragraph.

    A paragraph stands whole at the block in which it begins; blocks that go on with it, and
    those of furniture, have the empty text.
    """
    rows, shared = _runs(fragments, blocks)

    def run(batches):
        known = shared.value
        stream = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        found: list[tuple] = []
        for (pdf, number), group in itertools.groupby(stream, key=lambda r: r[:2]):
            # the part that is still open, its page, and whether it began in this run, before its first page, or in an earlier one
            held, at, began = None, 0, "here"
            turn = None

            def closed(more: bool):
                """The rows of the held paragraph; pieces of one that other runs share are put together later."""
                if held is None or began == "before":
                    return []
                shared_ = began == "earlier" or more
                text = held.text if shared_ else repaired(held.text, set(), known)
                flag = ("goes on" if began == "earlier" else "begins") if shared_ else ""
                return [(held.tbl, i, pdf, at, held.ordinal, text, flag, number) for i in held.ids]

            for no, g in itertools.groupby(group, key=lambda r: r[2]):
                page_rows = list(g)
                own, page = page_rows[0][3], Page([r[4:] for r in page_rows])
                near = turn is not None and no == turn + 1
                if held is not None and not near:
                    found += closed(False)
                    held = None
                first = True
                for part in parts(page):
                    if not part.text:
                        if own:
                            found += [(part.tbl, i, pdf, no, part.ordinal, "", "", number) for i in part.ids]
                        continue
                    goes_on = held is not None and held.takes(part, first and near, known)
                    first = False
                    if not own and held is not None and began != "before":
                        # the page after the run: only whether its first part goes on with the last one
                        found += closed(goes_on)
                        held = None
                        break
                    if goes_on and own and began != "before":
                        held.add(part.text)
                        found += [(part.tbl, i, pdf, no, part.ordinal, "", "", number) for i in part.ids if part.tbl == "pdf_blocks"]
                        continue
                    found += closed(False)
                    held, at, began = part, no, ("earlier" if goes_on and own else "here") if own else "before"
                turn = no
                if first and held is not None:
                    found += closed(False)  # a page without content ends what was open
                    held = None
                if len(found) > 20_000:
                    yield _emitted(found, _PARTS)
                    found = []
            found += closed(False)
        yield _emitted(found, _PARTS)

    pieces = written(rows.mapInArrow(run, _PARTS), "scan-parts")
    # of a run at most its first and its last paragraph are shared with others
    document = Window.partitionBy("pdf_id").orderBy("run", "page_no", "ordinal")
    shared_parts = pieces.filter("flag != ''").groupBy("pdf_id", "run", "page_no", "ordinal", "flag", "tbl").agg(F.collect_list("row_id").alias("ids"), F.first("text").alias("text"))
    chains = shared_parts.withColumn("chain", F.sum((F.col("flag") == "begins").cast("int")).over(document)).groupBy("pdf_id", "chain").agg(
        F.sort_array(F.collect_list(F.struct("run", "page_no", "ordinal", "tbl", "ids", "text"))).alias("parts")
    )

    def put_together(batches):
        for batch in batches:
            found = []
            for pdf, pieces_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = pieces_[0]["text"]
                for piece in pieces_[1:]:
                    text = joined(text, piece["text"])
                for k, x in enumerate(pieces_):
                    shown = "" if k else repaired(text, set(), shared.value)
                    found += [(x["tbl"], i, pdf, x["page_no"], x["ordinal"], shown, "", x["run"]) for i in x["ids"] if not k or x["tbl"] == "pdf_blocks"]
            yield _emitted(found, _PARTS)

    whole = chains.select("pdf_id", "parts").mapInArrow(put_together, _PARTS)
    alone = F.col("pdf_id").startswith("\0")
    return pieces.filter("flag = ''").unionByName(whole).select(
        "tbl", "row_id", F.when(~alone, F.col("pdf_id")).alias("pdf_id"), "page_no", F.when(F.col("ordinal") < 1 << 30, F.col("ordinal")).alias("ordinal"), "text"
    )


def _runs(fragments: DataFrame, blocks: DataFrame):
    """The rows of both tables in runs of pages, and the sound words, which all workers share."""
    def keyed(df: DataFrame, tbl: str, key: str, size) -> DataFrame:
        alone = F.col("pdf_id").isNull() | F.col("page_no").isNull()
        return df.select(
            F.lit(tbl).alias("tbl"), F.col(key).alias("row_id"),
            F.when(alone, F.concat(F.lit("\0"), F.col(key).cast("string"))).otherwise(F.col("pdf_id")).alias("pdf_id"),
            F.coalesce("page_no", F.lit(0)).alias("page_no"), F.col("ordinal").cast("int").alias("ordinal"), "text", size.alias("size"),
        )

    lines = written(_lines(keyed(fragments, "pdf_fragments", "fragment_id", F.col("font_size").cast("double"))), "scan-lines")
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("kind")].cast("double") if "kind" in blocks.columns else F.lit(None).cast("double")
    placed, lines = lines, lines.filter("text IS NOT NULL")  # a fragment without text still has its place
    texts = written(_lines(keyed(blocks.filter("text IS NOT NULL"), "pdf_blocks", "block_id", kind)), "scan-texts")
    words = vocabulary(lines)
    confusions = learnt_confusions(words)
    sound = sound_words([tuple(r) for r in words.filter("sound").select("word", "n", "fair").collect()], confusions)
    shared = fragments.sparkSession.sparkContext.broadcast(Vocabulary(sound, confusions))
    sides = returning(lines, texts).select(
        "pdf_id", "page_no", F.lit("edges").alias("tbl"), F.lit(None).cast("bigint").alias("row_id"), F.col("mark").alias("ordinal"), "text", F.lit(None).cast("double").alias("size")
    )

    # a document is cut into runs of pages; the pages next to a run come with it to be looked at only
    run_no = F.floor(F.col("page_no") / RUN_PAGES)
    near = F.array_distinct(F.array(run_no, F.floor((F.col("page_no") - 1) / RUN_PAGES), F.floor((F.col("page_no") + 1) / RUN_PAGES)))
    columns = ["pdf_id", "page_no", "tbl", "row_id", "ordinal", "text", "size"]
    rows = placed.select(*columns).unionByName(texts.select(*columns)).unionByName(sides.select(*columns))
    rows = rows.withColumn("own", run_no).withColumn("run", F.explode(near))
    rows = rows.select("pdf_id", "run", "page_no", (F.col("own") == F.col("run")).alias("own"), *columns[2:])
    rows = rows.repartition("pdf_id", "run").sortWithinPartitions("pdf_id", "run", "page_no")

    return rows, shared


def returning(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """``(pdf_id, page_no, text, mark)`` of lines at page edges that return (1) or hold a number of a sequence (2), or both (3)."""
    page = Window.partitionBy("pdf_id", "page_no")
    ends = [
        lines.withColumn("rank", F.dense_rank().over(page.orderBy(*(order(c) for c in ("ordinal", "text"))))).filter(F.col("rank") <= EDGE_LINES).select("pdf_id", "page_no", "text")
        for order in (F.asc, F.desc)
    ]
    place = F.struct("ordinal", "text")
    outer = texts.groupBy("pdf_id", "page_no").agg(F.substring_index(F.min_by("text", place), "\n", 1).alias("first"), F.substring_index(F.max_by("text", place), "\n", -1).alias("last"))
    outer = outer.select("pdf_id", "page_no", F.explode(F.array("first", "last")).alias("text"))
    schema = "pdf_id string, page_no long, text string, key string, numbers array<long>"

    def keyed(batches):
        for batch in batches:
            texts_ = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.int64()), batch.column(2), pa.array([edge_key(t) for t in texts_], pa.string()), pa.array([page_numbers(t) for t in texts_], pa.list_(pa.int64()))],
                ["pdf_id", "page_no", "text", "key", "numbers"],
            )

    edges = written(ends[0].unionByName(ends[1]).unionByName(outer).distinct().mapInArrow(keyed, schema), "scan-edges")
    titled = edges.filter(F.length("key") >= 4)
    own = titled.groupBy("pdf_id", "key").agg(F.count_distinct("page_no").alias("pages"), F.count(F.lit(1)).alias("at_edges"))
    many = titled.groupBy("key").agg(F.count_distinct("pdf_id").alias("documents")).filter(F.col("documents") >= DOCUMENTS).select("key", F.lit(True).alias("common"))
    repeated = own.join(many, "key", "left").filter(F.col("common") | (F.col("pages") >= RETURNS))
    # what stands inside of pages more often is text, not furniture, wherever it does
    judged = written(repeated.select("pdf_id", "key", "pages", "common", "at_edges"), "scan-returns")
    keys = judged.select("key").distinct()
    shown = titled.join(keys, "key", "left_semi").select("text", "key").distinct()
    anywhere = lines.select("pdf_id", "page_no", "ordinal", "text").join(shown, "text").groupBy("key").agg(F.count_distinct("pdf_id", "page_no", F.coalesce("ordinal", F.lit(-1)), "text").alias("all_lines"))
    at_edges = own.join(keys, "key", "left_semi").groupBy("key").agg(F.sum("at_edges").alias("at_edges"))
    outside = at_edges.join(anywhere, "key", "left").filter(F.col("at_edges") >= 0.5 * F.coalesce("all_lines", F.lit(0))).select("key")
    returned = judged.join(outside, "key", "left_semi").select("pdf_id", "key").withColumn("same", F.lit(1))
    # almost a returning line of its document: equal at one end, and few letters apart
    rest = titled.join(returned, ["pdf_id", "key"], "left_anti").select("pdf_id", "key").distinct()
    both = [F.substring("key", 1, 6), F.substring("key", -6, 6)]
    ended = [x.select("pdf_id", F.col("key").alias(n), F.explode(F.array(*[F.concat(F.lit(str(i)), e) for i, e in enumerate(both)])).alias("end")) for x, n in ((rest, "key"), (returned, "other"))]
    near = ended[0].join(ended[1], ["pdf_id", "end"]).filter(F.levenshtein("key", "other") <= F.greatest(F.lit(1), (F.length("other") / 5).cast("int")))
    returned = returned.unionByName(near.select("pdf_id", "key").distinct().withColumn("same", F.lit(1)))
    # a number's difference to its page: that of other pages, or none
    numbers = edges.select("pdf_id", "page_no", "text", F.explode(F.transform("numbers", lambda n: n - F.col("page_no"))).alias("ahead"))
    sequence = Window.partitionBy("pdf_id", "ahead").orderBy("page_no")
    near_page = [F.abs(F.col("page_no") - step("page_no").over(sequence)).between(1, 2) for step in (F.lag, F.lead)]
    pages = numbers.select("pdf_id", "ahead", "page_no").distinct().withColumn("goes_on", F.coalesce(near_page[0], F.lit(False)) | F.coalesce(near_page[1], F.lit(False)) | (F.col("ahead") == 0))
    counted = numbers.join(pages.filter("goes_on"), ["pdf_id", "ahead", "page_no"], "left_semi").select("pdf_id", "page_no", "text").distinct().withColumn("number", F.lit(2))
    found = edges.join(returned, ["pdf_id", "key"], "left").join(counted, ["pdf_id", "page_no", "text"], "left")
    mark = F.coalesce("same", F.lit(0)) + F.coalesce("number", F.lit(0))
    return found.select("pdf_id", "page_no", "text", mark.alias("mark")).filter("mark > 0").groupBy("pdf_id", "page_no", "text").agg(F.max("mark").alias("mark"))


def _neighbours(group):
    """Each own page of a run with the text lines that end the page before it and begin the page after."""
    held: list[tuple[int, bool, Page]] = []
    pages = ((no, rows[0][3], Page([r[4:] for r in rows])) for no, g in itertools.groupby(group, key=lambda r: r[2]) if (rows := list(g)))
    for item in itertools.chain(pages, [None]):
        if item is not None:
            held.append(item)
        if len(held) > 1 or item is None:
            # the last but one, or at the end the last
            k = len(held) - (1 if item is None else 2)
            if k >= 0:
                no, own, page = held[k]
                last = next((p for n, _, p in held[:k] if n == no - 1), None)
                first = next((p for n, _, p in held[k + 1 :] if n == no + 1), None)
                if own:
                    yield page, last.content[-1][1] if last and last.content else None, first.content[0][1] if first and first.content else None
        del held[:-2]


def _emitted(found: list[tuple], schema: T.StructType = _OUT) -> pa.RecordBatch:
    kinds = [pa.int64() if f.dataType == T.LongType() else pa.string() for f in schema]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)], schema.names)


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "pdf_fragments"), table(spark, folder, "pdf_blocks")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return findings(*_tables(spark, folder)).select("tbl", "row_id", "defect")


def p2_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every PDF as paragraphs put right, in order of page and ordinal: a row a block, whose text is empty where it only goes on with an earlier one; without ``block_id`` where there are no blocks."""
    fragments, blocks = _tables(spark, folder)
    found = paragraphs(fragments, blocks)
    texts = found.filter("tbl = 'pdf_blocks'").select(F.col("row_id").alias("block_id"), "text")
    places = blocks.select("block_id", "pdf_id", "page_no", "ordinal", "kind")
    lone = found.filter("tbl = 'pdf_fragments'").select(
        F.lit(None).cast("bigint").alias("block_id"), "pdf_id", F.col("page_no").cast("int").alias("page_no"), F.col("ordinal").cast("int").alias("ordinal"), F.lit("paragraph").alias("kind"), "text"
    )
    return places.join(texts, "block_id").unionByName(lone)
