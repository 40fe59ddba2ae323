import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_queries_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and {"p6_found", "edges"} <= set(entry.queries())


def test_flagship(spark, data):
    assert entry.entry(spark).count() > 0


def test_core_stands_alone(tmp_path):
    """Without the optional subpackage the rest imports and lists its queries."""
    import shutil

    shutil.copytree(ROOT / "vellum", tmp_path / "vellum", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p6_found' in q and not [n for n in q if n.startswith('p1_')], list(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_core_does_not_import_the_subpackage():
    for file in (ROOT / "vellum").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            assert "vellum.llm" not in file.read_text(encoding="utf-8"), file
