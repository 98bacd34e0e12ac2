"""The library works without the optional operators."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_optional_operators(tmp_path):
    shutil.copytree(os.path.join(REPO, "anchorage"), tmp_path / "anchorage", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(REPO, "__spark_entry__.py"), tmp_path)
    (tmp_path / "anchorage" / "llm" / "__pycache__").mkdir(parents=True)  # as an emptied folder leaves it
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(q) == set(o) and len(q) >= 43, len(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120,
                   env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
