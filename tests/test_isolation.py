import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "tesseral"):
        target = tmp_path / name
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, target, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(ROOT / name, target)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'geometry_profile' in q and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)


def test_nothing_else_imports_the_corpus_operators():
    for file in (ROOT / "tesseral").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\b.*\bllm\b", file.read_text(), re.M), file
