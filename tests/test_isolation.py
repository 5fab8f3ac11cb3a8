"""The rest of the library stands without the training-data operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
#: A child sees its own copy alone, or, as where the path is inherited, this repository behind it.
BARE = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
BEHIND = BARE | {"PYTHONPATH": str(ROOT)}
LIST = "import __spark_entry__ as e; names = set(e.queries()); assert set(e.oracle_sql()) <= names; print(len(names), sum(n.startswith('op') for n in names), 'pipeline' in names)"


@pytest.mark.parametrize("env", [BARE, BEHIND], ids=["bare", "behind"])
@pytest.mark.parametrize("gone", [["lodestone/llm"], ["lodestone/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_queries_without(tmp_path, gone, env):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.parquet"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    out = subprocess.run([sys.executable, "-c", LIST], cwd=copy, capture_output=True, text=True, timeout=120, env=env)
    assert out.returncode == 0, out.stderr
    total, extra, pipeline = out.stdout.split()
    assert int(total) - int(extra) > 100 and pipeline == "False"
    if (ROOT / "lodestone" / "llm").is_dir():
        assert (int(extra) >= 10) == (gone == ["corpus_pipeline.py"])


def test_other_missing_modules_surface(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.parquet"))
    (copy / "corpus_pipeline.py").write_text("import no_such_module_anywhere\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=copy, capture_output=True, text=True, timeout=120, env=BARE)
    assert out.returncode != 0 and "no_such_module_anywhere" in out.stderr
