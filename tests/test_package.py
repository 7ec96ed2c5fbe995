"""The library stands without the corpus package, and names are registered once."""

import ast
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_corpus_package():
    for path in (ROOT / "tessera").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or "corpus_pipeline" in n for n in names), path


@pytest.mark.parametrize("gone", [["tessera/llm", "corpus_pipeline.py"], ["tessera/llm"], ["corpus_pipeline.py"]])
def test_the_rest_works_without_the_corpus_package(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    for g in gone:
        shutil.rmtree(copy / g) if (copy / g).is_dir() else (copy / g).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; assert e.corpus is None and len(e.queries()) > 200 and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})


def test_a_missing_library_is_not_hidden(tmp_path):
    (tmp_path / "zstandard.py").write_text("raise ModuleNotFoundError(name='zstandard')")
    code = "import __spark_entry__"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, env={**os.environ, "PYTHONPATH": f"{tmp_path}:{ROOT}"})
    assert not (ROOT / "tessera/llm").is_dir() or b"zstandard" in done.stderr


def test_oracles_belong_to_queries():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 200
    seen = [k for m in entry.registry._MODULES for k in m.queries()]
    assert len(seen) == len(set(seen))
