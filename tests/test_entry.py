import subprocess
import sys
import shutil
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_training_data_package(tmp_path):
    shutil.copytree(REPO / "siftlode", tmp_path / "siftlode", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'topk_linear' in q and not [x for x in q if x.startswith('op')] and 'pipeline' not in q; e.oracle_sql()"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
