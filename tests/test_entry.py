import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]
SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_stands_without_the_optional_part(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path / "r", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})
    n, *rest = said.stdout.split()
    assert int(n) > 50 and rest[-1] == "False", said.stderr


def test_nothing_else_imports_the_optional_part():
    for p in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "tessera.llm" not in p.read_text(), p


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["entity_discovery_summary", "country_profiles", "parent_flags", "graph_degrees", "name_match_exact", "address_inferred_parents", "exception_flags", "cdis_positions", "jurisdiction_labels", "investor_economy_summary"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = c.execute(__spark_entry__.oracle_sql()[name])
    names = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(n) for n in names]
    want = sorted(repr(tuple(r[i] for i in at)) for r in cur.fetchall())
    df = __spark_entry__.queries()[name](spark, SMALL)
    assert sorted(df.columns) == names
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == want
