"""The driver's contract holds where the optional subpackage is missing or half removed."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("left", [None, "__pycache__", "__init__.py"])
def test_entry_without_the_optional_subpackage(tmp_path, left):
    for name in ("martlens", "martlens_oracle"):
        shutil.copytree(REPO / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    if left:
        at = tmp_path / "martlens" / "llm"
        at.mkdir()
        (at / left).touch() if left.endswith(".py") else (at / left).mkdir()
        if (REPO / "corpus_pipeline.py").exists():
            shutil.copy(REPO / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    queries, sql = map(int, done.stdout.split())
    assert queries == sql > 190


def test_an_error_inside_the_subpackage_is_not_hidden(tmp_path):
    for name in ("martlens", "martlens_oracle"):
        shutil.copytree(REPO / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    (tmp_path / "martlens" / "llm").mkdir()
    (tmp_path / "martlens" / "llm" / "queries.py").write_text("import no_such_library")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert "no_such_library" in done.stderr
