import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and set(e.oracle_sql()) <= set(q); assert not [x for x in q if x.startswith('op') or x == 'pipeline'], q; print('fine')"


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_the_rest_stands_alone(tmp_path, also):
    """A copy without the corpus subpackage and its tests, and with or without the pipeline: the entry point, every module and every test file still import."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *also))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = lambda *a: subprocess.run([sys.executable, *a], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
    said = run("-c", SAY)
    assert said.stdout.strip() == "fine", said.stderr
    every = "import pkgutil, importlib, kinmesh\nfor m in pkgutil.walk_packages(kinmesh.__path__, 'kinmesh.'): importlib.import_module(m.name)\nimport bench\nprint('fine')"
    said = run("-c", every)
    assert said.stdout.strip() == "fine", said.stderr
    said = run("-m", "pytest", "--collect-only", "-q", "tests")
    assert said.returncode == 0, said.stdout
