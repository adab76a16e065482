"""The entry without the training-data operators."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
blocked = sys.argv[1].split(",")

class Absent:
    def find_spec(self, name, path=None, target=None):
        if any(name == b or name.startswith(b + ".") for b in blocked):
            raise ModuleNotFoundError(name)

sys.meta_path.insert(0, Absent())
import __spark_entry__ as E
names = set(E.queries())
assert "cube_window_stats" in names and set(E.oracle_sql()) <= names
assert not any(n.startswith("op1_") for n in names) and "pipeline" not in names
"""


@pytest.mark.parametrize("blocked", ["featurestats.llm,corpus_pipeline", "featurestats.llm", "tokenizers,public_tokenizers"])
def test_entry_imports(blocked):
    done = subprocess.run([sys.executable, "-c", CODE, blocked], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
