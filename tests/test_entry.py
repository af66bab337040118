"""The entry where the training-data operators cannot be imported."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAYS = """
import sys
sys.path.insert(0, {root!r})
sys.modules[{missing!r}] = None
import __spark_entry__ as entry
names = set(entry.queries())
assert "feature_table" in names and set(entry.oracle_sql()) <= names
print(len([n for n in names if n.startswith("op") and n[2].isdigit()]), "pipeline" in names)
"""


@pytest.mark.parametrize("missing", ["xxhash", "sentencepiece", "logtide.llm"])
def test_a_missing_library_costs_only_its_queries(missing):
    got = subprocess.run([sys.executable, "-c", SAYS.format(root=str(ROOT), missing=missing)], capture_output=True, text=True)
    assert got.stdout.split() == ["0", "False"], got.stderr
