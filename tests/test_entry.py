import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def without(tmp_path, *names):
    """A copy of the repository without some of its parts."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *names))
    return tmp_path / "r"


def run(folder, *args):
    return subprocess.run([sys.executable, *args], cwd=folder, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)


@pytest.mark.parametrize("names", [("llm",), ("llm", "corpus_pipeline.py")])
def test_the_rest_works_without_the_corpus_operators(tmp_path, names):
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(s) <= set(q) and 'pipeline' not in q and not any(x.startswith('op') for x in q)"
    folder = without(tmp_path, *names)
    done = run(folder, "-c", code)
    assert done.returncode == 0, done.stderr
    # every other test can be collected; they are the ones that run here too
    done = run(folder, "-m", "pytest", "tests", "--collect-only", "-q")
    assert done.returncode == 0, done.stdout + done.stderr


def test_other_import_errors_are_not_hidden(tmp_path):
    folder = without(tmp_path, "llm", "corpus_pipeline.py")
    (folder / "keyspan/llm").mkdir()
    (folder / "keyspan/llm/__init__.py").write_text("")
    (folder / "keyspan/llm/registry.py").write_text("import no_such_module\n")
    done = run(folder, "-c", "import __spark_entry__ as e; e.queries()")
    assert done.returncode and "no_such_module" in done.stderr


def test_the_flagship_query(spark):
    import __spark_entry__

    if os.path.isdir("/root/testdata/sf0.001"):
        assert __spark_entry__.entry(spark).columns[0] == "o_orderkey"
