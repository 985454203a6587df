"""The entry with and without the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
LOOK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q)"


@pytest.mark.parametrize("left", [(), ("aerolens/llm/__pycache__",), ("corpus_pipeline.py",)])
def test_entry_without_text_operators(tmp_path, left):
    """The two folders are gone; a leftover cache folder or the pipeline's file may still be there."""
    shutil.copytree(REPO / "aerolens", tmp_path / "aerolens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    for name in left:
        if name.endswith(".py"):
            (tmp_path / name).write_text("import aerolens.llm.queries")
        else:
            (tmp_path / name).mkdir(parents=True)
    out = subprocess.run([sys.executable, "-c", LOOK], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    count, any_op, pipeline = out.stdout.split()
    assert int(count) > 100 and any_op == pipeline == "False"
