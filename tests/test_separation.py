"""A copy of the library without its optional folders still registers and imports everything else."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from sluice.plans.oracles import ORACLES
from sluice.plans.queries import QUERIES

ROOT = Path(__file__).resolve().parent.parent
LEFT_OUT = shutil.ignore_patterns("llm", "__pycache__", ".git")


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_without_optional_folders(tmp_path, with_pipeline):
    for name in ("sluice", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=LEFT_OUT)
    for name in ("__spark_entry__.py", "bench.py", *(["corpus_pipeline.py"] if with_pipeline else [])):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    code = (
        "import pkgutil, importlib, __spark_entry__ as e, sluice\n"
        "for m in pkgutil.walk_packages(sluice.__path__, 'sluice.'): importlib.import_module(m.name)\n"
        "import tests.test_queries\n"
        "print(len(e.queries()), len(e.oracle_sql()))"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]
