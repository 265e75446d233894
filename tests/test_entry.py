"""The entry module without the training-data package."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_training_data_package(tmp_path):
    """With the package's folders gone, and with the pipeline's file gone or left behind, all other queries stay."""
    for pipeline in (True, False):
        copy = tmp_path / str(pipeline)
        shutil.copytree(os.path.join(REPO, "marketloom"), copy / "marketloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(os.path.join(REPO, "__spark_entry__.py"), copy)
        if pipeline:
            (copy / "corpus_pipeline.py").write_text("from marketloom.llm import common\n")
        code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)})
        assert out.returncode == 0, out.stderr
        names, oracles = (line.split() for line in out.stdout.strip().splitlines()[-2:])
        assert len(names) > 40 and set(oracles) <= set(names)
        assert not [n for n in names if n.startswith("op") or n == "pipeline"]
