"""The library stands without its training-data subpackage."""

import os
import subprocess
import sys

from .conftest import ROOT


def test_rest_imports_without_llm(tmp_path):
    for name in ("cohortlake", "__spark_entry__.py"):
        src, dst = os.path.join(ROOT, name), tmp_path / name
        if os.path.isdir(src):
            for folder, _, files in os.walk(src):
                part = os.path.relpath(folder, src)
                if "llm" in part.split(os.sep) or "__pycache__" in part:
                    continue
                (dst / part).mkdir(parents=True, exist_ok=True)
                for f in files:
                    (dst / part / f).write_bytes(open(os.path.join(folder, f), "rb").read())
        else:
            dst.write_bytes(open(src, "rb").read())
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(s) <= set(q) and not any(x.startswith('op') for x in q)"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr[-800:]
