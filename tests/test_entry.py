"""The driver contract, with and without the optional modules."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).resolve().parent.parent


def test_entry_gives_rows(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["path", "n", "line_nos"] and out.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_optional_modules(tmp_path):
    shutil.copytree(REPO / "corvine", tmp_path / "corvine", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'grouped_matches' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_the_optional_modules():
    for path in (REPO / "corvine").rglob("*.py"):
        if "llm" not in path.parts:
            assert "corvine.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()
