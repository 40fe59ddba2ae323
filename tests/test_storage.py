import json
import os

import pytest
from pyspark.sql import functions as F

from vellum import api, session
from vellum.operators import assets
from vellum.plans import query as q
from vellum.sources import vault
from vellum.streaming import jobs

PNG = b"\x89PNG\r\n\x1a\n"


def test_assets(spark):
    rows = [(0, "p", "a", PNG + b"1"), (1, "p", "b", PNG + b"1"), (2, "p", "c", b"text"), (3, "p", "d", PNG + b"22"), (4, "p", "e", None), (5, "p", "f", PNG + b"x" * 99)]
    df = spark.createDataFrame(rows, "ordinal int, page string, source string, content binary")
    kept = assets.addressed(df, 50)
    assert [r.source for r in kept.orderBy("ordinal").collect()] == ["a", "b", "d"]
    once = assets.deduplicated(kept)
    assert sorted(r.source for r in once.collect()) == ["a", "d"] and all(r.path == f"assets/{r.sha256}.png" for r in once.collect())
    assert [r.source for r in assets.within_budget(once.withColumn("page", F.lit("p")), 12, "page").collect()] == ["a"]
    names = spark.createDataFrame([("p", 0, "A b.png"), ("p", 1, "a-b.png"), ("q", 2, "a-b.png")], "page string, ordinal int, name string")
    assert [r.asset_name for r in assets.asset_names(names, "page").orderBy("ordinal").collect()] == ["a-b.png", "a-b-2.png", "a-b.png"]


def test_manifest(spark, data):
    df = spark.read.parquet(f"{data}/capture_outcomes.parquet")
    row = json.loads(assets.manifest(df).first().manifest)
    assert row["version"] == assets.MANIFEST_VERSION and row["sourceUrl"].startswith("http") and row["capturedAt"].endswith("Z")
    with pytest.raises(Exception, match="bad manifest"):
        assets.manifest(df.withColumn("status", F.lit("odd"))).collect()


def test_capture_document(spark):
    text = assets.capture_document(F.lit('A "t"'), F.lit(None).cast("string"), F.lit("https://a"), F.lit("2024"), F.lit("complete"), F.lit("\nbody\n"))
    assert spark.range(1).select(text.alias("t")).first().t == '---\ntitle: "A \\"t\\""\nsource: "https://a"\ncaptured: "2024"\nstatus: "complete"\n---\n\n# A "t"\n\nbody\n'


def test_bundles(tmp_path, monkeypatch, spark):
    target = tmp_path / "clip"
    b = assets.Bundle(target)
    b.write("manifest.json", json.dumps({"version": assets.MANIFEST_VERSION}).encode())
    with pytest.raises(ValueError):
        b.write("../out", b"")
    with pytest.raises(ValueError):
        b.write("x", b"1", "0" * 64)
    b.commit()
    with pytest.raises(FileExistsError):
        assets.Bundle(target)
    again = assets.Bundle(target, force=True)
    again.write("manifest.json", b'{"version": 3, "n": 2}')
    real = os.replace

    def failing(a, c):
        if str(c) == str(target) and "old" not in str(a):
            raise OSError("no")
        return real(a, c)

    monkeypatch.setattr(os, "replace", failing)
    with pytest.raises(OSError):
        again.commit()
    monkeypatch.undo()
    assert json.loads((target / "manifest.json").read_text()) == {"version": 3} and len(list(tmp_path.iterdir())) == 1
    df = spark.createDataFrame([("one", "# a", '{"version": 3}'), ("two", None, '{"version": 3}')], "slug string, markdown string, manifest string")
    assets.write_bundles(df, str(tmp_path / "all"))
    assert sorted(p.name for p in (tmp_path / "all").iterdir()) == ["one", "two"]
    (tmp_path / "foreign").mkdir()
    with pytest.raises(FileExistsError):
        assets.Bundle(tmp_path / "foreign", force=True)


@pytest.fixture
def root(tmp_path):
    base = vault.init_vault(tmp_path / "v")
    files = {"projects/_draft.md": "---\nstatus: open\npriority: 2\n---\n# Kite\n[[areas/README]] [[gone]]", ".hidden/x.md": "", "node_modules/x.md": "", "AGENTS.md": "", "a.txt": "", "areas/tuned.md": "[[_draft]] a kite string"}
    for name, text in files.items():
        (base / name).parent.mkdir(exist_ok=True)
        (base / name).write_text(text)
    (base / "link.md").symlink_to(base / "index.md")
    return base


def test_vault_commands(spark, root):
    with pytest.raises(FileExistsError):
        vault.init_vault(root)
    assert vault.note_files(root) == ["areas/README.md", "areas/tuned.md", "clips/README.md", "inbox/README.md", "index.md", "projects/_draft.md", "projects/README.md", "reference/README.md"]
    v = api.Vault(spark, str(root))
    assert v.notes.count() == 8 and v.check() == 3
    assert v.refresh() and not v.refresh() and v.check() == 3
    assert "[[projects/_draft|Kite]]" in (root / "index.md").read_text()
    assert [r.path for r in v.list([q.Equals("status", "open")]).collect()] == ["projects/_draft.md"]
    assert v.list(sort=q.Sort("inbound", True), limit=1).first().path in ("areas/README.md", "projects/_draft.md")
    assert [r.source for r in v.backlinks("_draft").collect()] == ["areas/tuned.md"] and v.backlinks("none") is None
    assert {r.path for r in v.links("areas/tuned", depth=2).nodes.collect()} == {"areas/tuned.md", "projects/_draft.md", "areas/README.md"}
    hit = v.search("kite string").first()
    assert hit.path == "areas/tuned.md" and "kite string" in hit.snippet


def test_index_is_guarded(root):
    seen = vault.read_index(root, "index.md")
    (root / "index.md").write_text("changed")
    with pytest.raises(vault.StaleIndex):
        vault.write_index(root, "index.md", seen, "x")
    os.link(root / "index.md", root / "twin.md")
    for bad in ("index.md", "link.md", "../v2.md"):
        with pytest.raises((ValueError, OSError)):
            vault.read_index(root, bad)


def test_other_sources(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.html").write_text("<p>x</p>")
    (tmp_path / "p/b.html").write_text("y" * 100)
    assert [r.body for r in vault.saved_pages(spark, str(tmp_path / "p"), 50).collect()] == ["<p>x</p>"]
    (tmp_path / "f.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "g.pdf").write_bytes(b"no")
    assert [r.length for r in vault.pdf_files(spark, str(tmp_path)).filter("path LIKE '%.pdf'").collect()] == [10]


def test_written_tables(spark):
    df = spark.range(5)
    assert session.written(df, "t").count() == 5 and session.ensure_checkpoint_dir(spark) == session.ensure_checkpoint_dir(spark)


def test_reports(spark):
    assert api.adapters(spark).count() == 16 and api.doctor(spark)["spark"] == spark.version


def test_windows(spark):
    rows = [(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:39:00", "a", 2.0), (1, "2024-01-01 01:10:00", "b", 3.0), (2, "2024-01-01 00:10:00", "a", 4.0)]
    df = spark.createDataFrame(rows, "user_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.window_start.hour, r.event_type, r.n_events, r.sum_value) for r in jobs.tumbling(df).collect()) == [(0, "a", 3, 7.0), (1, "b", 1, 3.0)]
    assert sorted((r.user_id, r.n_events) for r in jobs.sessions(df).collect()) == [(1, 1), (1, 2), (2, 1)]
    assert jobs.sliding(df, "1 hour", "30 minutes").count() == 4


def test_streams(spark, tmp_path):
    notes, index = tmp_path / "notes", tmp_path / "index"
    notes.mkdir()
    (notes / "a.md").write_text("# A\nwords")
    jobs.keep_index(jobs.follow_notes(spark, str(notes)), str(index), str(tmp_path / "ck")).awaitTermination(120)
    (notes / "b.md").write_text("more")
    jobs.keep_index(jobs.follow_notes(spark, str(notes)), str(index), str(tmp_path / "ck")).awaitTermination(120)
    rows = spark.read.parquet(str(index)).collect()
    assert {r.path.rpartition("/")[2] for r in rows} == {"a.md", "b.md"} and len(rows) == 2
    from vellum.operators import search

    (notes / "c.md").write_text("third")
    jobs.keep_index(jobs.follow_notes(spark, str(notes)), str(index), str(tmp_path / "ck")).awaitTermination(120)
    now = search.current(spark.read.parquet(str(index)))
    assert sorted(r.chunk for r in now.collect()) == ["# A\nwords", "more", "third"]


def test_pipeline(spark, tmp_path):
    from vellum.operators import pipeline

    page = "<html><head><title>A page</title><script type='application/ld+json'>{\"a\": [{\"commentCount\": \"7\"}]}</script></head><body><article><h1>A page</h1><p>{}</p><p>token = \"abc\" <a href='/x'>x</a></p></article></body></html>"
    long = page.replace("{}", "words of it " * 40)
    rows = [
        (1, "https://a.org/p?utm_source=x", "text/html", "http", "<p>x</p>", None, False), (2, "https://a.org/p", None, "http", long, None, False), (3, "https://b.org/p", "text/html", "http", long, "T", False),
        (4, "https://c.org/t", "text/plain", "file", "# Plain\nsome plain words here that make up a text", None, True), (5, None, None, None, None, None, None), (6, "https://d.org/", None, None, "", None, None),
    ]
    df = spark.createDataFrame([(*r, ["w", "w"], None) for r in rows], "page_id long, final_url string, content_type string, acquisition_method string, body string, browser_title string, content_truncated boolean, warnings array<string>, fetched_at timestamp")
    got = {r.page_id: r for r in pipeline.extractions(df).collect()}
    assert got[2].status == "complete" and got[2].declared_items == 7 and got[4].status == "partial" and got[6].status == "unsupported" and got[1].status == "unsupported"
    report = {r.page_id: r for r in pipeline.run(df, str(tmp_path / "out")).collect()}
    assert set(report) == {2, 3, 4, 6} and report[2].slug != report[3].slug and report[2].n_redacted == 1
    text = (tmp_path / "out" / report[2].slug / "capture.md").read_text()
    assert "[REDACTED]" in text and "[x](https://a.org/x)" in text and json.loads((tmp_path / "out" / report[2].slug / "manifest.json").read_text())["warnings"] == ["w"]


def test_small_rules(spark):
    from vellum.operators import pipeline

    df = spark.createDataFrame([("a-b", "assets/a.png", 5), ("-a", "../x", 100), ("a b", "a//b", 5000)], "s string, p string, n int")
    rows = df.select(pipeline.is_slug(F.col("s")).alias("s"), pipeline.is_artifact_path(F.col("p")).alias("p"), pipeline.scroll_budget(F.col("n")).alias("n")).collect()
    assert [tuple(r) for r in rows] == [(True, True, 3), (False, False, 5), (False, False, 40)]
    assert spark.range(1).select(pipeline.visible_comments(F.lit("View all 1.2k comments")).alias("c")).first().c == 1200
    images = spark.createDataFrame([("i", "s"), ("j", "t")], "image_id string, sha256 string")
    good = spark.createDataFrame([("i", "s", "d")], "image_id string, sha256 string, description string")
    assert {(r.image_id, r.description) for r in pipeline.annotated(images, good).collect()} == {("i", "d"), ("j", None)}
    with pytest.raises(Exception, match="another image"):
        pipeline.annotated(images, good.withColumn("sha256", F.lit("x"))).collect()


def test_index_in_parts(spark, root, tmp_path):
    place = str(tmp_path / "index")
    assert tuple(api.Vault(spark, str(root)).build_index(place).first()) == (7, 0, 0, 0, 7)
    (root / "areas/tuned.md").write_text("new words")
    (root / "inbox/README.md").unlink()
    assert tuple(api.Vault(spark, str(root)).build_index(place).first()) == (0, 1, 5, 1, 1)
    from vellum.operators import search

    rows = {r.path: r.chunk for r in search.current(spark.read.parquet(place)).collect()}
    assert rows["areas/tuned.md"] == "new words" and "inbox/README.md" not in rows and len(rows) == 6


def test_search_by_meaning(spark, root, tmp_path):
    """Vectors of the index, hits of changed notes left out, degrees and a least score."""
    words = ("oven", "kiln", "glaze", "clay")

    def embed(texts):
        return [[t.lower().count(w) + 0.01 for w in words] for t in texts]

    place = str(tmp_path / "index")
    (root / "areas/pots.md").write_text("# Pots\n\nclay clay glaze")
    (root / "areas/bread.md").write_text("# Bread\n\noven oven oven. See [[pots]].")
    v = api.Vault(spark, str(root), embed=embed, dimension=4)
    v.build_index(place)
    hits = v.search("clay", 2, index=place).collect()
    assert hits[0].path == "areas/pots.md" and (hits[0].inbound, hits[0].outbound) == (1, 0) and hits[0].score > 0.8
    assert v.search("clay", 10, index=place, min_score=0.8).count() == 1
    (root / "areas/pots.md").write_text("changed")
    assert "areas/pots.md" not in {r.path for r in api.Vault(spark, str(root), embed=embed, dimension=4).search("clay", 10, index=place).collect()}
    assert {r.path for r in v.search("oven", 5, mode="keyword").collect()} == {"areas/bread.md"}
    for bad in ({"mode": "x"}, {"mode": "semantic"}):
        with pytest.raises(ValueError):
            v.search("clay", **bad)
