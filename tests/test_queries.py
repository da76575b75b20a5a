import glob
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from loomgrid.plans.file_queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return repr(float(v) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    found, wanted = QUERIES[name](spark, DIR), duck.execute(ORACLES[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    a = sorted(tuple(cell(r[c]) for c in columns) for r in found.collect())
    b = sorted(tuple(map(cell, r)) for r in wanted.fetchall())
    assert a == b


def test_entry_without_the_training_data_part(tmp_path):
    for name in ("loomgrid", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "loomgrid" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op')]; assert 'q01_continuous_stats' in e.queries(); import loomgrid.api"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
