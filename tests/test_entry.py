"""The entry module without its optional part."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

BLOCKED = """
import sys

class Blocker:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {name!r} or name == {name!r}:
            raise ModuleNotFoundError(f"No module named {{name}}", name=name)

sys.meta_path.insert(0, Blocker())
import __spark_entry__ as entry
names = entry.queries()
print(len(names), any(n.startswith("op1_") for n in names), set(entry.oracle_sql()) <= set(names))
"""


@pytest.mark.parametrize("name", ["public_tokenizers", "numpy.no_such", "corpus_pipeline", "sparsemill.llm"])
def test_core_queries_stay(name):
    found = subprocess.run([sys.executable, "-c", BLOCKED.format(name=name)], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=True)
    n, there, held = found.stdout.split()
    here = (Path(__file__).resolve().parents[1] / "corpus_pipeline.py").exists()
    assert int(n) >= 70 and held == "True" and there == str(name == "numpy.no_such" and here)
