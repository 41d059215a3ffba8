"""Every registered SQL query against DuckDB on the smallest dataset."""

import duckdb
import pytest

from leadtime.plans import catalogue

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in ("orders", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    return con


def rows(frame, columns):
    return sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))


def test_filters_reach_the_scan(spark, tmp_path):
    from leadtime.operators.scope import Scope
    from leadtime.sources import fixtures as X

    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")  # the plan's text is cut below that
    X.forecasts(X.cells(spark, SF)).write.parquet(f"file://{tmp_path}/f")
    stored = spark.read.parquet(f"file://{tmp_path}/f")
    plan = Scope.of("persist", "v1", horizons=[7]).apply(stored).select("value")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(model_id,persist)" in plan and "EqualTo(horizon,7)" in plan


def test_entry_imports_without_the_llm_package():
    import subprocess
    import sys

    code = "import sys\nclass Gone:\n    def find_spec(self, name, *a):\n        if name == 'corpus_pipeline' or name.startswith('leadtime.llm'):\n            raise ModuleNotFoundError(name=name)\nsys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\nassert len(e.queries()) == len(e.oracle_sql()) > 30"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0
