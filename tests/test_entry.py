"""The library without its text operators: everything else must import and run."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def without_text(tmp_path, *left_out):
    shutil.copytree(HERE, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json"))
    for name in left_out:
        at = tmp_path / "repo" / name
        shutil.rmtree(at, ignore_errors=True) if at.is_dir() else at.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'beats_persistence' in q; assert not [n for n in q if n.startswith('op') and n[2].isdigit()]; assert 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    return subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)


def test_without_the_text_folders(tmp_path):
    """The pipeline's file may still be there."""
    done = without_text(tmp_path, "chronoloom/llm", "tests/llm")
    assert done.returncode == 0, done.stderr


def test_without_the_pipeline_too(tmp_path):
    done = without_text(tmp_path, "chronoloom/llm", "tests/llm", "corpus_pipeline.py")
    assert done.returncode == 0, done.stderr
