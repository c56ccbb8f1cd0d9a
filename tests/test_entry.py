"""The driver contract, and that the library does without the text subpackage."""

import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_the_text_subpackage():
    for path in (ROOT / "phasegrid").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()


def test_entry_without_the_text_subpackage(tmp_path):
    (tmp_path / "phasegrid").mkdir()
    for p in (ROOT / "phasegrid").iterdir():
        if p.name not in ("llm", "__pycache__"):
            os.symlink(p, tmp_path / "phasegrid" / p.name)
    os.symlink(ROOT / "__spark_entry__.py", tmp_path / "__spark_entry__.py")
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
