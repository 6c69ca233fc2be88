from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

CODE = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {blocked!r} or name in {blocked!r}:
            raise ImportError(f"no {{name}} here")
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
names = set(e.queries())
assert len(names) >= 80 and "rolling_footprint" in names and set(e.oracle_sql()) <= names, names
assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names), names
"""


@pytest.mark.parametrize("blocked", ["xxhash", "zstandard", "corpus_pipeline"])
def test_all_other_queries_stay_without_a_library_of_the_text_operators(blocked):
    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-c", CODE.format(blocked=(blocked,))], cwd=root, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
