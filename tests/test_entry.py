"""The entry points, with and without the llm folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def without_llm(path):
    """A copy of the repository with the llm folders and the pipeline deleted, tests and all."""
    shutil.copytree(ROOT, path, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for name in ("quern/llm", "tests/llm"):
        shutil.rmtree(path / name, ignore_errors=True)
    (path / "corpus_pipeline.py").unlink(missing_ok=True)


def run(path, *args):
    return subprocess.run([sys.executable, *args], cwd=path, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)


def test_without_llm(tmp_path):
    path = tmp_path / "copy"
    without_llm(path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"
    out = run(path, "-c", code)
    assert out.stdout.split()[-1:] == ["False"], out.stderr[-500:]
    out = run(path, "-m", "pytest", "tests", "-q", "-x", "-k", "not without_llm and (entry or revenue or operators)")
    assert out.returncode == 0, out.stdout[-500:]


def test_a_broken_subpackage_is_no_missing_one(tmp_path):
    path = tmp_path / "copy"
    without_llm(path)
    (path / "quern/llm").mkdir()
    (path / "quern/llm/__init__.py").touch()
    (path / "quern/llm/queries.py").write_text("import not_there_at_all")
    out = run(path, "-c", "import __spark_entry__")
    assert out.returncode and "not_there_at_all" in out.stderr
