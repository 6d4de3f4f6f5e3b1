"""The entry file with and without the optional folder."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n == 'pipeline' or n[:2] == 'op'), len(e.queries()), len(e.oracle_sql()))"


@pytest.mark.parametrize("keep_pipeline", [True, False])
def test_imports_without_the_optional_folder(tmp_path, keep_pipeline):
    ignored = shutil.ignore_patterns("llm", "__pycache__", *([] if keep_pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(os.path.join(ROOT, "chronica"), tmp_path / "chronica", ignore=ignored)
    names = ["__spark_entry__.py"] + (["corpus_pipeline.py"] if keep_pipeline and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")) else [])
    for name in names:
        shutil.copy(os.path.join(ROOT, name), tmp_path / name)
    ran = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr
    optional, queries, twins = ran.stdout.rsplit(" ", 2)
    assert optional == "[]" and int(queries) > 200 and int(twins) > 200
