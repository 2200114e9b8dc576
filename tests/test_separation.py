"""The rest of the library without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_rest_stands_alone(tmp_path):
    for name in ("tilewright", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = "import __spark_entry__ as e; q = e.queries(); assert q.keys() == e.oracle_sql().keys() and len(q) > 100 and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", said], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)


def test_nothing_else_imports_them():
    for path in (ROOT / "tilewright").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "tilewright").parts:
            assert "tilewright.llm" not in path.read_text(), path
