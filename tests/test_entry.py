"""The entry module without the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op') and n[2].isdigit() for n in q), set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("gone", [("tieout/llm", "tests/llm"), ("tieout/llm", "tests/llm", "corpus_pipeline.py")])
def test_imports_without_the_text_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: {n for n in names if n in (".git", "__pycache__") or str(Path(folder, n).relative_to(ROOT)) in gone})
    out = subprocess.run([sys.executable, "-c", ASK], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    count, *rest = out.stdout.split()
    assert int(count) > 100 and rest == ["False", "False", "True"]
