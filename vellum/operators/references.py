"""Orphan references: keys that point at records which are missing, deleted or arrive later.

References and parent spans are brought into one stream, partitioned and sorted by
key and moment, and merged in one linear pass: a running maximum of the span ends
seen so far tells whether any parent is present at a reference's moment. Nothing is
collected per key, so a key of any size is read as a stream. Every key with more than
``SALT_ROWS`` references is salted and its (few) parent rows repeated per salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import paths
from vellum.session import written
from vellum.sources.tables import table

#: References of a hot key that share one salt; keys with more are hot.
SALT_ROWS = 50_000
#: Hot keys up to which their salts are broadcast; more of them are joined by shuffle.
BROADCAST_KEYS = 20_000

_EVER, _FOREVER = "0001-01-01 00:00:00", "9999-12-31 00:00:00"


def parent_spans(df: DataFrame, key: Column, start: Column, end: Column) -> DataFrame:
    """Rows ``(ref_key, start_at, end_at)`` of parents; a null start means since ever, a null end open.

    Rows with a null key are no parents. Repeated spans are kept once.
    """
    ever, forever = (F.lit(x).cast("timestamp_ntz") for x in (_EVER, _FOREVER))
    return (
        df.select(
            key.alias("ref_key"),
            F.coalesce(start.cast("timestamp_ntz"), ever).alias("start_at"),
            F.coalesce(end.cast("timestamp_ntz"), forever).alias("end_at"),
        )
        .filter(F.col("ref_key").isNotNull())
        .distinct()
    )


def hot_salts(references: DataFrame) -> DataFrame:
    """``(ref_key, __salts)`` of every hot key, however many there are; counts are combined before the shuffle."""
    counts = references.groupBy("ref_key").count().filter(F.col("count") > SALT_ROWS)
    return counts.select("ref_key", F.ceil(F.col("count") / SALT_ROWS).cast("int").alias("__salts"))


def orphan_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """The references whose parent is not there at their moment, with the reason.

    ``references``: any columns, with ``ref_key STRING`` and ``moment TIMESTAMP``; ``parents``
    as of :func:`parent_spans`. Returns the references' columns and ``reason``:
    ``missing`` (no parent of that key at all), ``late`` (every span of it begins after
    the moment) or ``deleted``. References with a null key refer to nothing and do not
    come out. With a null moment only ``missing`` can be told. Repeated references each
    come out; ties of moments count as present (starts are inclusive, ends exclusive).
    A column ``reason`` of the references gives way to the result's.
    """
    references = references.filter(F.col("ref_key").isNotNull())
    payload = [c for c in references.columns if c not in ("ref_key", "moment", "reason")]
    references = references.select("ref_key", "moment", *payload)
    salts = written(hot_salts(references), "hot-keys")
    n_hot, n_salts = salts.count(), F.lit(1)
    if n_hot:
        salts = F.broadcast(salts) if n_hot <= BROADCAST_KEYS else salts
        references, parents = (x.join(salts, "ref_key", "left") for x in (references, parents))
        n_salts = F.coalesce("__salts", F.lit(1))

    refs = references.select(
        "ref_key",
        F.when(n_salts > 1, F.pmod(F.xxhash64(*payload, "moment"), n_salts).cast("int")).otherwise(0).alias("salt"),
        F.col("moment").cast("timestamp_ntz").alias("at"),
        F.lit(None).cast("timestamp_ntz").alias("until"),
        F.lit(None).cast("boolean").alias("span"),
        F.struct(*payload, F.col("moment")).alias("ref"),
    )
    # Each parent gives its span and a header that sorts before every moment.
    def event(at: Column, until: Column, span: bool) -> Column:
        return F.struct(at.cast("timestamp_ntz").alias("at"), until.cast("timestamp_ntz").alias("until"), F.lit(span).alias("span"))

    nothing = F.lit(None)
    both = F.array(event(nothing, nothing, False), event(F.col("start_at"), F.col("end_at"), True))
    spans = (
        parents.withColumn("salt", F.explode(F.sequence(F.lit(0), n_salts - 1)))
        .select("ref_key", "salt", F.inline(both))
        .withColumn("ref", F.lit(None).cast(refs.schema["ref"].dataType))
    )
    merged = (
        Window.partitionBy("ref_key", "salt")
        .orderBy(F.col("at").asc_nulls_first(), F.col("ref").isNotNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    known = F.max("span").over(merged)
    reach = F.max("until").over(merged)
    state = refs.unionByName(spans).select("ref_key", "ref", "at", known.alias("known"), reach.alias("reach"))
    reason = (
        F.when(F.col("known").isNull(), "missing")
        .when(F.col("at").isNull(), F.lit(None))
        .when(~F.col("known"), "late")
        .when(F.col("reach") <= F.col("at"), "deleted")
    )
    found = state.withColumn("reason", reason).filter(F.col("ref").isNotNull() & F.col("reason").isNotNull())
    return found.select("ref.*", "ref_key", "reason")


def note_name_spans(notes: DataFrame) -> DataFrame:
    """Parents of every way to name a note: ``id:`` (exact id) and ``name:`` (bare name).

    A bare name means the note whose whole id it is, if there ever was one, else every
    note with that last path part.
    """
    name = paths.basename(F.col("note_id"))
    # names that a note bears as its whole id; distinct, so the join repeats nothing, and no name is gathered
    roots = notes.filter(~F.col("note_id").contains("/")).select(F.col("note_id").alias("name")).distinct().withColumn("rooted", F.lit(True))
    ids = parent_spans(notes, F.concat(F.lit("id:"), F.col("note_id")), F.col("added_at"), F.col("removed_at"))
    slim = (
        notes.filter(F.col("note_id").isNotNull())
        .select("note_id", name.alias("name"), "added_at", "removed_at")
        .join(roots, "name", "left")
        .filter(F.col("rooted").isNull() | (F.col("note_id") == F.col("name")))
    )
    names = parent_spans(slim, F.concat(F.lit("name:"), F.col("name")), F.col("added_at"), F.col("removed_at"))
    files = parent_spans(notes, F.concat(F.lit("path:"), F.col("path")), F.col("added_at"), F.col("removed_at"))
    return ids.unionByName(names).unionByName(files)


def with_target_key(links: DataFrame) -> DataFrame:
    """``links`` with ``target_key``: the parent key that ``target`` means; null for none or an attachment."""
    address = F.col("address")
    links = links.withColumn("address", paths.link_address(F.col("target")))
    links = links.withColumn("bare", F.regexp_replace(paths.without_markdown_extension(address), "^/", ""))
    bare = F.col("bare")
    relative = F.when(bare.startswith("."), paths.joined(paths.dirname(F.col("source_path")), bare))
    links = links.withColumn("relative", relative)
    exact = F.coalesce("relative", F.when(bare.contains("/"), bare))
    key = F.coalesce(F.concat(F.lit("id:"), exact), F.concat(F.lit("name:"), bare))
    return links.withColumn(
        "target_key", F.when((address != "") & ~paths.is_attachment(address), key)
    ).drop("address", "bare", "relative")


def kind_key(kind: Column) -> Column:
    return F.concat(F.lit("kind:"), F.lower(paths.trim(kind)))


def vault_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references of ``wiki_links`` and ``link_issues``, as of the project's link rules."""
    links, issues = table(spark, folder, "wiki_links"), table(spark, folder, "link_issues")
    notes, kinds = table(spark, folder, "notes"), table(spark, folder, "issue_kinds")

    def fields(**keys: Column) -> Column:
        return F.inline(F.array(*[F.struct(F.lit(k).alias("ref_field"), v.alias("ref_key")) for k, v in keys.items()]))

    path_key = F.concat(F.lit("path:"), F.col("source_path"))
    of_links = with_target_key(links).select(
        F.lit("wiki_links").alias("tbl"),
        F.col("link_id").alias("row_id"),
        F.col("seen_at").alias("moment"),
        fields(target=F.col("target_key"), source_path=path_key),
    )
    of_issues = issues.select(
        F.lit("link_issues").alias("tbl"),
        F.col("issue_id").alias("row_id"),
        F.col("reported_at").alias("moment"),
        fields(kind=kind_key(F.col("kind")), source_path=path_key),
    )
    parents = note_name_spans(notes).unionByName(
        parent_spans(kinds, kind_key(F.col("kind")), F.col("valid_from"), F.col("valid_to"))
    )
    return orphan_references(of_links.unionByName(of_issues), parents)


def period(moment: Column) -> Column:
    return F.date_format(moment.cast("date"), "yyyy-MM")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return vault_orphans(spark, folder).select("tbl", "ref_field", "row_id", period(F.col("moment")).alias("ref_period"), "reason")


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references counted by table, field, month and reason."""
    return (
        p6_found(spark, folder)
        .groupBy("tbl", "ref_field", "ref_period", "reason")
        .agg(F.count(F.lit(1)).alias("n_refs"))
    )
