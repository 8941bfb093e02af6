"""The article queries do not depend on what only the optional subpackage needs."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; names = e.queries(); print(len([n for n in names if not n.startswith(('op', 'pipeline'))]))"


@pytest.mark.parametrize("hidden", ["tiktoken", "public_tokenizers", "xxhash", "regex", "newsloom.llm"])
def test_entry_without_an_optional_library(hidden):
    code = f"import sys; sys.modules[{hidden!r}] = None; {COUNT}"
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    assert int(run.stdout.split()[-1]) == 115
