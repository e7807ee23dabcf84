"""The driver contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_contract(spark):
    assert entry.entry(spark).columns
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 80


def test_llm_is_not_imported_elsewhere():
    for f in (ROOT / "docforge").rglob("*.py"):
        if "llm" not in f.parts:
            assert "docforge.llm" not in f.read_text()


def test_entry_runs(spark, sf):
    assert entry.queries()["nodes"](spark, sf).count() > 0


def test_every_test_module_is_collected():
    r = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", str(ROOT / "tests")], cwd=ROOT, capture_output=True, text=True, timeout=120, check=False)
    assert r.returncode == 0, r.stdout[-2000:]
