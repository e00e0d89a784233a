"""The driver's entry without the training-data folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_llm_folders(tmp_path):
    for name in ("counterpoise", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / name)
    code = (
        "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); "
        "assert len(q) > 50 and set(o) <= set(q) and not any(n.startswith('op1') or n == 'pipeline' for n in q), sorted(q)"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
