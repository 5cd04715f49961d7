"""The entry without the training-data operators: folders deleted, the pipeline deleted or not, a library missing."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), len([k for k in e.queries() if k.startswith('op') or k == 'pipeline']))"


def listed(where, first=""):
    done = subprocess.run([sys.executable, "-B", "-c", first + LIST], cwd=where, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return [*map(int, done.stdout.split())], done.stderr


@pytest.fixture
def copy(tmp_path):
    for name in ("marketspark", "tests"):
        shutil.copytree(REPO / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    return tmp_path


@pytest.mark.parametrize("pipeline", [True, False])
def test_folders_deleted(copy, pipeline):
    from marketspark.plans import queries as market

    if pipeline and (REPO / "corpus_pipeline.py").exists():
        shutil.copy(REPO / "corpus_pipeline.py", copy)
    counts, said = listed(copy)
    assert counts == [len(market.queries()), len(market.oracle_sql()), 0] and "without the training-data operators" in said


def test_a_library_is_missing():
    if not (REPO / "marketspark" / "llm").exists():
        pytest.skip("no training-data operators here")
    counts, said = listed(REPO, "import sys; sys.modules['xxhash'] = None; ")
    assert counts[2] == 0 and counts[0] > 50 and "xxhash" in said
