"""The entry point with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and callable(e.entry); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q))"


@pytest.mark.parametrize("gone", [(), ("kumihimo/llm",), ("kumihimo/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_optional_parts(tmp_path, gone):
    for name in ("kumihimo", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr
    total, optional = map(int, out.stdout.split())
    here = (tmp_path / "kumihimo/llm").is_dir()
    assert total - optional >= 250 and optional == (13 + (tmp_path / "corpus_pipeline.py").exists() if here else 0)
