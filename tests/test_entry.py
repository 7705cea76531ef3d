"""The driver's contract, with and without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p2_found", "p5_found", "range_knn", "temporal_join"} <= set(entry.oracle_sql())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


def test_core_stands_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_text((ROOT / name).read_text())
    package = tmp_path / "vectide"
    for f in (ROOT / "vectide").rglob("*.py"):
        rel = f.relative_to(ROOT / "vectide")
        if rel.parts[0] != "llm":
            (package / rel).parent.mkdir(parents=True, exist_ok=True)
            (package / rel).write_text(f.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p8_ids' not in q; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
