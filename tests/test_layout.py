"""The corpus subpackage is optional, and nothing but the entry point knows of it."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_imports_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse", "metastore_db"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(n.startswith('op') and n[2:3].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, timeout=120)


def test_only_the_entry_point_imports_the_corpus_operators():
    for path in (ROOT / "lattica").rglob("*.py"):
        if "llm" in path.relative_to(ROOT / "lattica").parts:
            continue
        assert not re.search(r"^\s*(from|import)\b.*\bllm\b", path.read_text(), re.M), path


def test_no_local_checkpoints():
    for path in [*ROOT.glob("*.py"), *(ROOT / "lattica").rglob("*.py")]:
        assert "localCheckpoint(" not in path.read_text(), path
