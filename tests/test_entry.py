import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_sql_names_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_core_stands_without_llm():
    code = "import sys; sys.modules['minuteworks.llm'] = None\nimport minuteworks.plans.catalogue as c; print(len(c.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) > 50
    assert not [p for p in (ROOT / "minuteworks").rglob("*.py") if "llm" not in p.parts and "minuteworks.llm" in p.read_text()]


duckdb = pytest.importorskip("duckdb")
CORE = ["fn1_offset_normalise", "fn44_lexeme_rank", "wn7_chunks", "cp16_scores", "cp10_retrieve", "src13_replace_documents", "jn13_page_ranges", "ss1_request_windows"]


@pytest.mark.parametrize("name", CORE)
def test_queries_match_sql(spark, sf, name):
    db = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, sf)
    result = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    plain = lambda v: round(float(v), 6) if isinstance(v, float) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    wanted = sorted(str([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in result.fetchall())
    got = sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    assert got == wanted
