"""The entry point without the parts that can be left out."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [["jobsignals/llm"], ["jobsignals/llm", "corpus_pipeline.py"]])
def test_entry_imports_without_training_data_operators(tmp_path, gone):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "jobsignals"):
        source, target = os.path.join(ROOT, name), tmp_path / name
        if os.path.isdir(source):
            shutil.copytree(source, target, ignore=lambda d, names: [n for n in names if os.path.relpath(os.path.join(d, n), ROOT) in gone or n == "__pycache__"])
        elif os.path.exists(source) and name not in gone:
            shutil.copy(source, target)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tfidf' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
