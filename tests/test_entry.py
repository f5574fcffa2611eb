import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_optional_parts(tmp_path):
    for name in ("__spark_entry__.py", "rulespark"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    package = tmp_path / "rulespark"
    package.mkdir()
    for p in (ROOT / "rulespark").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (package / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k[:2] == 'op' or k == 'pipeline'], sorted(q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


@pytest.mark.parametrize("name", ["l_purchase_burst", "sc_plain", "co_cycles"])
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no test data")
    c = duckdb.connect()
    for p in data.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    got = __spark_entry__.queries()[name](spark, str(data)).toPandas()
    want = c.execute(__spark_entry__.oracle_sql()[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, got[columns].values.tolist())) == sorted(map(repr, want[columns].values.tolist()))
