"""The entry works without the optional training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAYS = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()), len(e.oracle_sql()))"


def copy(to, left_out):
    shutil.copytree(ROOT, to, ignore=lambda folder, names: [
        n for n in names if n in (".git", "__pycache__") or str(Path(folder, n).relative_to(ROOT)) in left_out])


@pytest.mark.parametrize("left_out", [("lorespan/llm", "tests/llm"), ("lorespan/llm", "tests/llm", "corpus_pipeline.py")])
def test_import_without_the_optional_folders(tmp_path, left_out):
    copy(tmp_path / "repo", left_out)
    out = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, optional, sql = map(int, out.stdout.split())
    assert optional == 0 and n >= 64 and sql >= 60
