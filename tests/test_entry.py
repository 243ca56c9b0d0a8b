"""The entry point without the optional parts of the library."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(folder: Path) -> set[str]:
    code = "import __spark_entry__ as e; a, b = e.queries(), e.oracle_sql(); assert set(b) <= set(a); print(*a)"
    return set(subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, check=True).stdout.split())


def copy_without(to: Path, *gone: str) -> Path:
    left_out = {(ROOT / g).resolve() for g in gone} | {ROOT / ".git"}
    shutil.copytree(ROOT, to, ignore=lambda d, found: [x for x in found if Path(d, x).resolve() in left_out])
    return to


def test_entry_without_training_data_operators(tmp_path):
    everything = names(ROOT)
    base = {x for x in everything if not x.startswith("op") and x != "pipeline"}
    assert "A8_document_coverage" in base
    assert names(copy_without(tmp_path / "a", "traceline/llm", "tests/llm")) == base
    assert names(copy_without(tmp_path / "b", "traceline/llm", "tests/llm", "corpus_pipeline.py")) == base
    assert names(copy_without(tmp_path / "c", "corpus_pipeline.py")) == everything - {"pipeline"}
