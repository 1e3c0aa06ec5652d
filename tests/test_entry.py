"""The driver's contract, with and without the llm folders."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names_match():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and "impact_single" in queries


def test_without_llm(tmp_path):
    for name in ("tributary", "__spark_entry__.py"):
        src = ROOT / name
        if src.is_dir():
            import shutil

            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            (tmp_path / name).write_text(src.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'impact_single' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q), q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_llm():
    for p in (ROOT / "tributary").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "tributary.llm" not in p.read_text(), p
