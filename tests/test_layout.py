import pathlib
import re
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_corpus_part():
    part = "siltstone." + "llm"
    for path in [*ROOT.glob("siltstone/**/*.py"), *ROOT.glob("tests/*.py")]:
        if "llm" not in path.relative_to(ROOT).parts and path.name != "test_layout.py":
            assert part not in path.read_text(), path


def test_entry_works_without_the_corpus_part(tmp_path):
    """The entry module finds the rest where the corpus part is not installed."""
    (tmp_path / "siltstone").mkdir()
    for p in (ROOT / "siltstone").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "siltstone" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'due_targets' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_hot_paths_have_no_row_udf():
    for path in ROOT.glob("siltstone/**/*.py"):
        assert not re.search(r"@(F\.)?(udf|pandas_udf)|\.rdd\b|localCheckpoint|crossJoin", path.read_text()), path
