"""The library without its training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("corpusloom/llm", "tests/llm"), ("corpusloom/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_works_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", ".hypothesis", "spark-warehouse"))
    for name in gone:
        shutil.rmtree(copy / name) if (copy / name).is_dir() else (copy / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(s) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q), sorted(q); print('fine')"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert said.stdout.strip() == "fine", said.stderr[-2000:]
    listed = subprocess.run([sys.executable, "-B", "-m", "pytest", "--collect-only", "-q", "tests", "-p", "no:cacheprovider", "--ignore=tests/test_isolation.py"], cwd=copy, capture_output=True, text=True, timeout=300)
    assert listed.returncode == 0, listed.stdout[-2000:]


def test_nothing_else_imports_the_subpackage():
    found = []
    for folder, _, names in os.walk(os.path.join(ROOT, "corpusloom")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    found += [name for line in f if "import" in line and "llm" in line]
    assert not found
