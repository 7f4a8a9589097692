"""The driver contract holds with and without the optional training-text subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(k.startswith('op') and k[2].isdigit() for k in q))"


def test_without_llm(tmp_path):
    for name in ("lithic", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    out = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 80 and out[1] == "0"


def test_nothing_imports_llm():
    for d, _, names in os.walk(os.path.join(ROOT, "lithic")):
        if os.path.basename(d) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(d, n)) as f:
                        assert "llm" not in f.read()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
