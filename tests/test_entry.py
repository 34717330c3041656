from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("fieldloom.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 60 and not [n for n in e.queries() if n.startswith("op") and n[2].isdigit()]
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_imports_without_the_training_data_operators():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True)


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["label", "mu", "sigma"]
    assert set(e.oracle_sql()) <= set(e.queries())
