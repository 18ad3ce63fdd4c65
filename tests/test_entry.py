"""The entry module stands without the corpus package, and hides no other import error."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
NAMES = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"


def copy(to: Path, *without: str) -> Path:
    shutil.copytree(ROOT / "sextant", to / "sextant", ignore=shutil.ignore_patterns("__pycache__", *without))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in without and (ROOT / name).exists():
            shutil.copy(ROOT / name, to / name)
    return to


def run(folder: Path) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-B", "-c", NAMES], cwd=folder, env={"PYTHONPATH": str(folder), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True)


def test_imports_without_the_corpus_package(tmp_path):
    done = run(copy(tmp_path, "llm", "corpus_pipeline.py"))
    assert done.returncode == 0, done.stderr
    assert done.stdout.split()[2] == "False"


def test_other_import_errors_count(tmp_path):
    folder = copy(tmp_path)
    (folder / "sextant" / "llm").mkdir(exist_ok=True)
    (folder / "sextant" / "llm" / "__init__.py").write_text("")
    (folder / "sextant" / "llm" / "queries.py").write_text("import no_such_module\n")
    assert run(folder).returncode != 0


def test_nothing_else_imports_the_corpus_package():
    for path in (ROOT / "sextant").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path
