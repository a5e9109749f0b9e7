"""Native operators run no Python on the executors; nothing is crossed, nothing is cached on one executor."""

from __future__ import annotations

import os
import re
from pathlib import Path

import pytest

from trellis.llm import queries

TABLES = os.environ.get("TRELLIS_TABLES", "/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
@pytest.mark.parametrize("name", ["op1_pii", "op2_fingerprints", "op7_mixing", "op9_secrets", "op13_decontamination"])
def test_native(spark, name):
    plan = queries.QUERIES[name](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


def test_nothing_else_imports_the_subpackage():
    for f in (ROOT / "trellis").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "llm" not in f.read_text(), f


def test_no_local_checkpoints_or_crosses():
    for f in [*(ROOT / "trellis" / "llm").glob("*.py"), ROOT / "corpus_pipeline.py"]:
        assert not re.search(r"localCheckpoint|crossJoin|\.cache\(|\.persist\(", f.read_text()), f


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
@pytest.mark.parametrize("name", ["op4_topk", "op7_mixing", "op11_infill", "op12_source_divergence", "op13_decontamination"])
def test_sql(spark, name):
    import glob

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{TABLES}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = queries.QUERIES[name](spark, TABLES).toPandas(), con.sql(queries.ORACLE[name]).df()
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).itertuples(index=False)))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
