"""The entry module where the training-data subpackage, or only a library it needs, is absent."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as E; q, o = E.queries(), E.oracle_sql(); print(len(q), len(o), any(n.startswith('op') or n == 'pipeline' for n in q), 'journey_score' in o)"


def _tree(to, *without):
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), to)
    if "corpus_pipeline.py" not in without and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
        shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), to)
    shutil.copytree(os.path.join(ROOT, "metroscope"), os.path.join(to, "metroscope"), ignore=shutil.ignore_patterns("__pycache__", *without))


def _run(to, code):
    return subprocess.run([sys.executable, "-c", code], cwd=to, capture_output=True, text=True, check=True,
                          env={**os.environ, "PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"}).stdout.split()


@pytest.mark.parametrize("without", [("llm",), ("llm", "corpus_pipeline.py")])
def test_core_queries_remain_without_the_subpackage(tmp_path, without):
    _tree(tmp_path, *without)
    n, m, training, flagship = _run(tmp_path, COUNT)
    assert int(n) >= int(m) >= 100 and training == "False" and flagship == "True"


def test_core_queries_remain_without_a_library(tmp_path):
    _tree(tmp_path)
    hide = "import sys; sys.modules['numpy'] = None; "
    n, m, training, _ = _run(tmp_path, hide + COUNT)
    assert int(n) >= int(m) >= 100 and training == "False"
