"""The query entry point, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_queries_and_checks_fit(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["way_id", "seq", "u", "v", "n_vertices", "distance"]


def test_without_the_subpackage():
    code = "import importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n.startswith('kerbline.llm') or n == 'corpus_pipeline' else f(n, *a); import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') or k == 'pipeline'], q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_subpackage():
    for p in [*(ROOT / "kerbline").rglob("*.py"), *(ROOT / "tests").glob("*.py")]:
        if "llm" not in p.parent.name and p.name != "test_entry.py":
            assert "llm" not in p.read_text(), p
