"""A folder of Markdown notes as a batch source, and the files around it."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders that hold no notes (fixed values), besides hidden ones.
IGNORED = ("coverage", "dist", "node_modules")
GUIDE = "AGENTS.md"


def note_files(root: str | os.PathLike, ignored: tuple[str, ...] = IGNORED) -> list[str]:
    """Relative paths of a vault's notes, sorted; no hidden names, links or guides."""
    base = Path(root)
    found = []
    for folder, folders, files in os.walk(base):
        folders[:] = sorted(d for d in folders if not d.startswith(".") and d not in ignored and not os.path.islink(os.path.join(folder, d)))
        for name in files:
            full = Path(folder, name)
            if name.endswith(".md") and not name.startswith(".") and name != GUIDE and not full.is_symlink():
                found.append(full.relative_to(base).as_posix())
    return sorted(found, key=lambda p: [(part.lower(), part) for part in p.split("/")])


@dataclass
class _Slice(InputPartition):
    files: list[tuple[int, str]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.size = int(options.get("filesPerPartition", 2000))
        self.ignored = tuple(x for x in options.get("ignored", ",".join(IGNORED)).split(",") if x)

    def partitions(self) -> list[_Slice]:
        listed = list(enumerate(note_files(self.root, self.ignored)))
        return [_Slice(listed[i : i + self.size]) for i in range(0, len(listed), self.size)] or [_Slice([])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for ordinal, path in partition.files:
            yield ordinal, path, Path(self.root, path).read_text(encoding="utf-8", errors="replace")


class VaultSource(DataSource):
    """``spark.read.format("vault").load(root)``: ``scan_ordinal, path, content``.

    Unlike the file sources it keeps names that begin with an underscore. Listing is done
    once by the driver; contents are read by the tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return "scan_ordinal bigint, path string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_vault(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.dataSource.register(VaultSource)
    return spark.read.format("vault").options(**options).load(str(root))


def saved_pages(spark: SparkSession, folder: str, max_bytes: int = 25 << 20) -> DataFrame:
    """Saved HTML files within a size: ``path, body``."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.htm*")
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")).filter(F.octet_length("body") <= max_bytes)


def pdf_files(spark: SparkSession, folder: str, max_bytes: int = 512 << 20) -> DataFrame:
    """PDF files by signature: ``path, length, sha256``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter(F.col("length") <= max_bytes)
    head = F.hex(F.substr("content", F.lit(1), F.lit(5))) == "255044462D"
    return rows.filter(head).select("path", "length", F.sha2("content", 256).alias("sha256"))


class StaleIndex(RuntimeError):
    """The index changed between reading and writing."""


@dataclass(frozen=True)
class Revision:
    device: int
    inode: int
    content: str


def read_index(root: str | os.PathLike, name: str) -> Revision:
    """The index with its identity; a link, a shared file or one outside the vault is refused."""
    base, place = Path(root).resolve(), Path(root) / name
    if not place.resolve().is_relative_to(base):
        raise ValueError(f"{name} is outside the vault")
    handle = os.open(place, os.O_RDONLY | os.O_NOFOLLOW)
    with os.fdopen(handle, encoding="utf-8") as file:
        facts = os.fstat(file.fileno())
        if facts.st_nlink != 1:
            raise ValueError(f"{name} is linked from elsewhere")
        return Revision(facts.st_dev, facts.st_ino, file.read())


def write_index(root: str | os.PathLike, name: str, seen: Revision, content: str) -> None:
    """Replaces the index by one that was written aside, unless it has changed since it was read."""
    place = Path(root) / name
    if read_index(root, name) != seen:
        raise StaleIndex(name)
    aside = place.with_name(f".{place.name}.{os.getpid()}")
    try:
        with open(aside, "x", encoding="utf-8") as file:
            file.write(content)
            file.flush()
            os.fsync(file.fileno())
        if read_index(root, name) != seen:
            raise StaleIndex(name)
        os.replace(aside, place)
    finally:
        aside.unlink(missing_ok=True)


TEMPLATE = {
    "index.md": "# Index\n\nStart here.\n",
    "inbox/README.md": "# Inbox\n\nNotes that are not yet filed.\n",
    "projects/README.md": "# Projects\n\nOne note a project.\n",
    "areas/README.md": "# Areas\n\nWhat goes on.\n",
    "reference/README.md": "# Reference\n\nWhat is looked up.\n",
    "clips/README.md": "# Clips\n\nCaptured pages.\n",
}


def init_vault(root: str | os.PathLike) -> Path:
    """A new vault with its first files; an existing path is refused, a failure leaves nothing."""
    base = Path(root)
    base.mkdir(parents=True)
    made: list[Path] = []
    try:
        for name, text in TEMPLATE.items():
            place = base / name
            place.parent.mkdir(exist_ok=True)
            place.write_text(text, encoding="utf-8")
            made.append(place)
    except OSError:
        import shutil

        shutil.rmtree(base, ignore_errors=True)
        raise
    return base
