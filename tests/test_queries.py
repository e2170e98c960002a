"""Every registered query of the engine against its SQL in DuckDB, and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import pandas as pd
import pytest

from geofold.plans import queries as q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].convert_dtypes()
    return sorted(map(str, df.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_same_as_sql(spark, duck, name):
    got, want = q.QUERIES[name](spark, DATA).toPandas(), duck.execute(q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_runs(spark, name):
    assert len(q.QUERIES[name](spark, DATA).toPandas()) > 0


def test_cubic_resampling_covers_the_whole_raster(spark):
    px = q.fx.pixels(spark, DATA).where("conf IS NOT NULL").selectExpr("max(row) AS r", "max(col) AS c").first()
    out = q.resample_cubic(spark, DATA).selectExpr("max(row) AS r", "max(col) AS c", "min(row) AS r0", "min(col) AS c0").first()
    assert (out.r0, out.c0) == (0, 0)
    assert out.r >= px.r * 2.5 and out.c >= px.c * 2.5


def test_entry_without_the_other_operators():
    code = "import sys; sys.modules['geofold.llm'] = None; import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) == len(q.QUERIES), out.stderr


def test_plans_push_filters_and_columns_down(spark):
    plan = q.clip_bbox(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan
    joined = q.model_ranking(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in joined and "BroadcastNestedLoopJoin" not in joined
    zones = q.zonal_stats_polygon(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in zones and "Python" not in zones
