import os
import shutil
import subprocess
import sys

import __spark_entry__ as E


def test_queries_have_oracles():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    missing = {n for n in set(q) - set(o) if not n.startswith("op") and n != "pipeline"}
    assert not missing, missing


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["o_orderkey", "y", "prediction"]
    assert df.count() > 0


def test_queries_without_the_optional_folders(tmp_path):
    """The core queries and their SQL are there when the optional package is not."""
    root = os.path.dirname(os.path.abspath(E.__file__))
    shutil.copytree(os.path.join(root, "fmlattice"), tmp_path / "fmlattice",
                    ignore=lambda folder, names: [n for n in names if n in ("llm", "__pycache__")])
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(root, name)):
            shutil.copy(os.path.join(root, name), tmp_path / name)
    code = ("import __spark_entry__ as E; q, o = E.queries(), E.oracle_sql(); assert set(q) == set(o), set(q) ^ set(o); "
            "assert 'fit' in q and 'pipeline' not in q; print(len(q))")
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    core = [n for n in E.queries() if not n.startswith("op") and n != "pipeline"]
    assert int(run.stdout) == len(core)
