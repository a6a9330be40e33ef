import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

NAMES = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


def names(folder):
    done = subprocess.run([sys.executable, "-c", NAMES], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


def without(folder, *left_out):
    shutil.copytree(REPO, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", ".hypothesis", *left_out))
    return names(folder)


def test_rest_stands_without_the_optional_parts(tmp_path):
    """The catalogue is whole without the optional folder and without the file that is built on it."""
    everything = names(REPO)
    core = {n for n in everything if not n.startswith("op") and n != "pipeline"}
    assert len(core) > 100
    assert without(tmp_path / "a", "llm", "corpus_pipeline.py") == core
    assert without(tmp_path / "b", "llm") == core
