import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from loomtext.plans import registry

ROOT = Path(__file__).resolve().parent.parent


def test_tables_of_queries(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["a", "b", "jaccard"]


def test_the_rest_stands_alone(tmp_path):
    """Without the llm folders and the pipeline everything else imports, and nothing of it imports them."""
    shutil.copytree(ROOT / "loomtext", tmp_path / "loomtext", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout) == len(registry.QUERIES), done.stderr
