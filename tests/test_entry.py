"""The driver contract holds with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parents[1]


def test_entry_runs(spark):
    sys.path.insert(0, str(REPO))
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_subpackage(tmp_path):
    """A copy without those folders still imports and lists the engine's own queries."""
    import shutil

    shutil.copytree(REPO / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pool_statistics' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
