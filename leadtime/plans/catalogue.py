"""The registered forecast-accuracy queries over the derived fixtures, each beside its DuckDB SQL."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..archive import Archive
from ..functions.metrics import BUILT_IN, Metric, custom
from ..operators import actuals as A
from ..operators import evaluate as E
from ..operators import summary as S
from ..operators.normalize import canonical_forecasts, plan_runs, run_digests
from ..operators.scope import Scope
from ..sources import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FIXTURES = """
fx_cells AS (SELECT o_orderpriority AS series_id, o_orderdate AS d, count(*)::DOUBLE AS c FROM orders GROUP BY 1, 2),
fx_models(model_id, model_version, b, k) AS (VALUES ('persist', 'v1', 0, 0), ('persist', 'v2', 1, 0), ('drift', 'v1', 0, 1)),
fx_h(h) AS (VALUES (1), (2), (3), (7), (14)),
fc AS (SELECT model_id, model_version, series_id, d AS origin, d + h * INTERVAL '1' DAY AS target, c + b + k * h AS value, h::BIGINT AS horizon FROM fx_cells, fx_models, fx_h),
fx_log AS (SELECT series_id, d AS target, 'feed' AS source, c AS actual_value, d + INTERVAL '1' DAY AS actual_recorded_at FROM fx_cells
  UNION ALL SELECT series_id, d, 'feed', c + 1, d + INTERVAL '5' DAY FROM fx_cells WHERE day(d) % 3 = 0
  UNION ALL SELECT series_id, d, 'ops', CASE WHEN day(d) % 18 = 0 THEN c + 1 ELSE c + 2 END, d + INTERVAL '5' DAY FROM fx_cells WHERE day(d) % 6 = 0),
fx_officials AS (SELECT series_id, d AS target, 'feed' AS source, d + INTERVAL '1' DAY AS actual_recorded_at, d + INTERVAL '6' DAY AS designated_at FROM fx_cells WHERE day(d) % 4 = 0
  UNION ALL SELECT series_id, d, 'feed', d + INTERVAL '5' DAY, d + INTERVAL '7' DAY FROM fx_cells WHERE day(d) % 12 = 0),
newest AS (SELECT * FROM fx_log QUALIFY actual_recorded_at = max(actual_recorded_at) OVER (PARTITION BY series_id, target)),
res AS (SELECT series_id, target, max(actual_recorded_at) AS recorded_at, count(DISTINCT actual_value) AS nv, min(actual_value) AS low, min_by(actual_value, CASE source WHEN 'feed' THEN 1 ELSE 2 END) AS pref FROM newest GROUP BY 1, 2),
latest AS (SELECT series_id, target, low AS actual_value, false AS is_fallback FROM res WHERE nv = 1),
latest_p AS (SELECT series_id, target, CASE WHEN nv = 1 THEN low ELSE pref END AS actual_value, false AS is_fallback FROM res),
cur AS (SELECT * FROM fx_officials QUALIFY row_number() OVER (PARTITION BY series_id, target ORDER BY designated_at DESC) = 1),
official AS (SELECT series_id, target, min(l.actual_value) AS actual_value, false AS is_fallback FROM cur JOIN fx_log l USING (series_id, target, source, actual_recorded_at) GROUP BY 1, 2 HAVING count(DISTINCT l.actual_value) = 1),
filled AS (SELECT * FROM official UNION ALL SELECT series_id, target, actual_value, true FROM latest l WHERE NOT EXISTS (SELECT 1 FROM official o WHERE o.series_id = l.series_id AND o.target = l.target))"""


def _with(body: str) -> str:
    return f"WITH {FIXTURES}\n{body}"


def _cells_sql(actuals: str, keys: str, where: str = "true", steps: str | None = None) -> str:
    """SQL of the accuracy cells of ``keys`` over the forecasts that ``where`` picks."""
    along = ", ".join(dict.fromkeys([*(steps if steps is not None else keys).split(", "), "model_id", "model_version", "series_id"]))
    along = ", ".join(x for x in along.split(", ") if x)
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""pairs AS (SELECT f.*, a.actual_value, coalesce(a.is_fallback, false) AS fb FROM fc f LEFT JOIN {actuals} a USING (series_id, target) WHERE {where}),
stepped AS (SELECT *, CASE WHEN actual_value IS NOT NULL THEN abs(actual_value - lag(actual_value) OVER (PARTITION BY {along}, actual_value IS NULL ORDER BY target)) END AS step FROM pairs),
cells AS (SELECT {lead}count(*) AS n_forecasts, count(actual_value) AS n, count(*) - count(actual_value) AS n_missing_actuals, count(*) FILTER (fb AND actual_value IS NOT NULL) AS n_fallback,
  avg(abs(value - actual_value)) AS "MAE", sqrt(avg((value - actual_value) * (value - actual_value))) AS "RMSE",
  round(avg(CASE WHEN actual_value <> 0 THEN abs((value - actual_value) / actual_value) END), 9) AS "MAPE", avg(abs(value - actual_value)) / nullif(avg(step), 0) AS "MASE" FROM stepped {group})"""


def _status(metric: str) -> str:
    return f"CASE WHEN n = 0 OR \"{metric}\" IS NULL THEN 'insufficient' WHEN n_missing_actuals > 0 THEN 'partial' ELSE 'ok' END AS status"


def _curve_sql(actuals: str, metric: str, basis: str, keys: str = "horizon", where: str = "true") -> str:
    lead = f"{keys}, " if keys else ""
    return f"WITH {FIXTURES},\n{_cells_sql(actuals, keys, where)}\nSELECT {lead}'{metric}' AS metric, '{basis}' AS basis, {_status(metric)}, \"{metric}\" AS value, n, n_missing_actuals, n_fallback FROM cells"


class Fixture:
    """The derived relations of one dataset."""

    def __init__(self, spark: SparkSession, sf_dir: str, cells: Callable[[SparkSession, str], DataFrame] = X.cells) -> None:
        self.cells = cells(spark, sf_dir)
        self.forecasts, self.log, self.officials = X.forecasts(self.cells), X.actuals_log(self.cells), X.officials(self.cells)

    def actuals(self, basis: str = "latest", fallback: str | None = None, priority=()) -> DataFrame:
        return A.effective(self.log, self.officials, basis, fallback, priority)


def _add(name: str, query: Callable[[Fixture], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(Fixture(spark, sf_dir))
    ORACLES[name] = sql


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.when(F.col("metric") == "MAPE", F.round("value", 9)).otherwise(F.col("value")))


V1 = {"model_id": "persist", "model_version": "v1"}
V1_SQL = "model_id = 'persist' AND model_version = 'v1'"
BY_MODEL = ("model_id", "model_version", "horizon")
BY_MODEL_SQL = "model_id, model_version, horizon"
YEAR = (datetime(1996, 1, 1), datetime(1996, 12, 31))
YEAR_SQL = "origin BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'"
CUT, CUT_SQL = datetime(1996, 6, 30), "origin <= TIMESTAMP '1996-06-30'"

_add("forecast_canonical", lambda x: x.forecasts, _with("SELECT * FROM fc"))
_add("forecast_horizon", lambda x: x.forecasts.select("series_id", "origin", "target", F.expr("timestampdiff(MICROSECOND, origin, target) div 86400000000").alias("horizon")), _with("SELECT series_id, origin, target, date_diff('day', origin, target) AS horizon FROM fc"))
_add("actuals_latest_nopriority", lambda x: A.effective_latest(x.log), _with("SELECT series_id, target, actual_value FROM latest"))
_add("actuals_latest_priority", lambda x: A.effective_latest(x.log, X.PRIORITY), _with("SELECT series_id, target, actual_value FROM latest_p"))
_add("actuals_ambiguous", lambda x: A.conflicts(x.log).select("series_id", "target", "recorded_at", F.array_join("sources", ",").alias("sources"), F.size("values").cast("long").alias("n_values")), _with("SELECT series_id, target, recorded_at, string_agg(source, ',' ORDER BY source) AS sources, count(*) AS n_values FROM newest JOIN res USING (series_id, target) WHERE nv > 1 GROUP BY 1, 2, 3"))
_add("official_current", lambda x: A.current_designations(x.officials), _with("SELECT * FROM cur"))
_add("official_effective", lambda x: A.effective_official(x.log, x.officials), _with("SELECT series_id, target, actual_value FROM official"))
_add("official_with_fallback", lambda x: x.actuals("official", "latest"), _with("SELECT * FROM filled"))
_add("pairs_left", lambda x: E.align(x.forecasts, x.actuals().drop("is_fallback")), _with("SELECT f.*, a.actual_value FROM fc f LEFT JOIN latest a USING (series_id, target)"))
_add("pairs_missing", lambda x: E.accuracy(E.align(x.forecasts, x.actuals()), BY_MODEL, []), f"WITH {FIXTURES},\n{_cells_sql('latest', BY_MODEL_SQL)} SELECT {BY_MODEL_SQL}, n_forecasts, n, n_missing_actuals, n_fallback FROM cells")
_add("drill_cell", lambda x: E.drill(x.forecasts, x.actuals(), Scope.of(**V1, horizons=[7])), _with(f"SELECT model_id, model_version, series_id, origin, target, horizon, value, actual_value, is_fallback FROM fc JOIN latest USING (series_id, target) WHERE {V1_SQL} AND horizon = 7"))
for _m in BUILT_IN:
    _add(f"{_m.lower()}_by_horizon", lambda x, m=_m: _rounded(E.curve(x.forecasts, x.actuals(), m, scope=Scope.of(**V1))), _curve_sql("latest", _m, "latest", "horizon", V1_SQL))
_add("mase_pooled_models", lambda x: E.curve(x.forecasts, x.actuals(), "MASE"), _curve_sql("latest", "MASE", "latest"))
_add("accuracy_point", lambda x: E.curve(x.forecasts, x.actuals(priority=X.PRIORITY), scope=Scope.of(**V1, horizons=[7])), _curve_sql("latest_p", "MAE", "latest", "horizon", f"{V1_SQL} AND horizon = 7"))
_add("accuracy_point_official", lambda x: E.curve(x.forecasts, x.actuals("official"), basis="official", scope=Scope.of(**V1, horizons=[7])), _curve_sql("official", "MAE", "official", "horizon", f"{V1_SQL} AND horizon = 7"))
_add("accuracy_point_fallback", lambda x: E.curve(x.forecasts, x.actuals("official", "latest"), basis="official", scope=Scope.of(**V1, horizons=[7])), _curve_sql("filled", "MAE", "official", "horizon", f"{V1_SQL} AND horizon = 7"))
_add("accuracy_series_list", lambda x: E.curve(x.forecasts, x.actuals(), "RMSE", scope=Scope.of(**V1, series=["1-URGENT", "5-LOW"])), _curve_sql("latest", "RMSE", "latest", "horizon", f"{V1_SQL} AND series_id IN ('1-URGENT', '5-LOW')"))
_add("accuracy_period", lambda x: E.curve(x.forecasts, x.actuals(), "MASE", scope=Scope.of(**V1, period=YEAR)), _curve_sql("latest", "MASE", "latest", "horizon", f"{V1_SQL} AND {YEAR_SQL}"))
_add("accuracy_curve_all_models", lambda x: E.curve(x.forecasts, x.actuals(), keys=BY_MODEL), _curve_sql("latest", "MAE", "latest", BY_MODEL_SQL))
_add("curve_status", lambda x: E.curve(x.forecasts, x.actuals("official"), basis="official", keys=("series_id", *BY_MODEL)).select("series_id", *BY_MODEL, "status", "n"), f"WITH {FIXTURES},\n{_cells_sql('official', 'series_id, ' + BY_MODEL_SQL)} SELECT series_id, {BY_MODEL_SQL}, {_status('MAE')}, n FROM cells")


def _compare_sql(listed: str, champion: str, where: str = "true") -> str:
    return f"""WITH {FIXTURES},
{_cells_sql('latest', BY_MODEL_SQL, where)},
ch AS (SELECT *, CASE model_id WHEN 'persist' THEN '{champion}' END AS champion_version FROM cells),
best AS (SELECT model_id, horizon, "MAE" AS best FROM ch WHERE model_version = champion_version)
SELECT model_id, model_version, horizon, 'MAE' AS metric, 'latest' AS basis, {_status('MAE')}, "MAE" AS value, n, champion_version,
  coalesce(model_version = champion_version, false) AS is_champion, "MAE" - best AS delta_vs_champion FROM ch LEFT JOIN best USING (model_id, horizon) WHERE {listed}"""


def _compare(x: Fixture, models, champions=X.CHAMPIONS, **scope) -> DataFrame:
    return E.compare(x.forecasts, x.actuals(), models, champions, scope=Scope.of(**scope), horizons=scope.get("horizons")).drop("place", "position")


_ALL = [("persist", "v1"), ("persist", "v2"), ("drift", "v1")]
_add("compare_models_h", lambda x: _compare(x, _ALL, horizons=[1]), _compare_sql("true", "v1", "horizon = 1"))
_add("compare_curve", lambda x: _compare(x, [("persist", "v2"), ("drift", "v1")]), _compare_sql("(model_id, model_version) IN (('persist', 'v2'), ('drift', 'v1'))", "v1"))
_add("compare_champion_override", lambda x: _compare(x, _ALL, X.CHAMPIONS | {"persist": "v2"}), _compare_sql("true", "v2"))
_MISSING = """SELECT 'nobody' AS model_id, 'v1' AS model_version, CAST(h AS BIGINT) AS horizon, 'MAE' AS metric, 'latest' AS basis, 'insufficient' AS status, CAST(NULL AS DOUBLE) AS value,
  CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS champion_version, false AS is_champion, CAST(NULL AS DOUBLE) AS delta_vs_champion"""
_add(
    "compare_missing_pair", lambda x: _compare(x, [("persist", "v2"), ("nobody", "v1"), ("persist", "v2")], horizons=[1, 7]),
    f"WITH c AS ({_compare_sql(chr(39).join(['model_id = ', 'persist', ' AND model_version = ', 'v2', '']), 'v1', 'horizon IN (1, 7)')}) SELECT * FROM c UNION ALL SELECT * FROM c UNION ALL {_MISSING} FROM (VALUES (1), (7)) AS w(h)",
)
_add("as_of_cutoff", lambda x: E.as_of(x.forecasts, CUT), _with(f"SELECT * FROM fc WHERE {CUT_SQL}"))
_add("as_of_scoped", lambda x: E.as_of(x.forecasts, CUT, **V1, series="5-LOW"), _with(f"SELECT * FROM fc WHERE {CUT_SQL} AND {V1_SQL} AND series_id = '5-LOW'"))
_add("horizons_in_scope", lambda x: E.horizons(x.forecasts, Scope.of(**V1)), _with(f"SELECT DISTINCT horizon FROM fc WHERE {V1_SQL}"))
_add("list_models", lambda x: E.list_models(x.forecasts, X.CHAMPIONS), _with("SELECT model_id, model_version, count(*) AS n_rows, count(DISTINCT series_id) AS n_series, min(origin) AS first_origin, max(origin) AS last_origin, min(target) AS first_target, max(target) AS last_target, model_id = 'persist' AND model_version = 'v1' AS is_champion FROM fc GROUP BY 1, 2"))


def _cube_sql(actuals: str, basis: str) -> str:
    own, pooled = (_cells_sql(actuals, k, steps="model_id, model_version, series_id, horizon") for k in ("model_id, model_version, series_id, horizon", BY_MODEL_SQL))
    body = own + ",\n" + pooled[pooled.index("cells AS") :].replace("cells AS", "pooled AS", 1)
    every = "SELECT model_id, model_version, series_id, horizon, n, n_forecasts, {m} FROM cells UNION ALL SELECT model_id, model_version, '*', horizon, n, n_forecasts, {m} FROM pooled"
    parts = " UNION ALL ".join(f"SELECT model_id, model_version, series_id, horizon, '{m}' AS metric, 'all' AS period, '{basis}' AS actual_basis, v AS value, n, n_forecasts FROM ({every.format(m=f'{chr(34)}{m}{chr(34)} AS v')}) WHERE n > 0 AND v IS NOT NULL" for m in BUILT_IN)
    return f"WITH {FIXTURES},\n{body}\n{parts}"


_add("summary_cube_latest", lambda x: _rounded(S.cube(x.forecasts, x.actuals(), "latest")), _cube_sql("latest", "latest"))
_add("summary_cube_official", lambda x: _rounded(S.cube(x.forecasts, x.actuals("official"), "official")), _cube_sql("official", "official"))
_add("summary_reconcile_diff", lambda x: S.differences(S.cube(x.forecasts, x.actuals(), "latest").filter("horizon <> 14"), S.cube(x.forecasts.repartition(3, "target"), x.actuals(), "latest")).groupBy("horizon").agg(F.count(F.lit(1)).alias("cells")), f"SELECT horizon, count(*) AS cells FROM ({_cube_sql('latest', 'latest')}) WHERE horizon = 14 GROUP BY 1")
_add("dedup_replay", lambda x: A.against_log(x.log.withColumn("actual_value", F.col("actual_value") + F.when(F.dayofmonth("target") == 7, 1.0).otherwise(0.0)), x.log.filter("source = 'feed'")).groupBy("source", "status").agg(F.count(F.lit(1)).alias("rows")), _with("SELECT source, CASE WHEN source = 'ops' THEN 'new' WHEN day(target) = 7 THEN 'conflict' ELSE 'seen' END AS status, count(*) AS rows FROM fx_log GROUP BY 1, 2"))
_add("stickiness_conflicts", lambda x: A.against_officials(x.log.select(*A.IDENTITY), x.officials).groupBy("status").agg(F.count(F.lit(1)).alias("rows")), _with("SELECT CASE WHEN c.source IS NULL THEN 'new' WHEN c.source = l.source AND c.actual_recorded_at = l.actual_recorded_at THEN 'same' ELSE 'conflict' END AS status, count(*) AS rows FROM fx_log l LEFT JOIN cur c ON l.series_id = c.series_id AND l.target = c.target GROUP BY 1"))


def _plan(x: Fixture) -> DataFrame:
    active = run_digests(x.forecasts.filter("model_version = 'v1'"))
    batch = run_digests(x.forecasts.withColumn("value", F.col("value") + F.when(F.dayofmonth("origin") == 3, 1.0).otherwise(0.0)))
    return plan_runs(batch, active).groupBy("model_id", "model_version", "status").agg(F.count(F.lit(1)).alias("runs"), F.sum("n_rows").alias("n_rows"))


_add("plan_runs_status", _plan, _with("SELECT model_id, model_version, CASE WHEN model_version <> 'v1' THEN 'new' WHEN day(origin) = 3 THEN 'changed' ELSE 'same' END AS status, count(DISTINCT (origin, series_id)) AS runs, count(*) AS n_rows FROM fc GROUP BY 1, 2, 3"))


CANONICAL = ["model_id", "model_version", "series_id", "origin", "target", "value", "horizon"]


def _archive(spark: SparkSession) -> Archive:
    """A new store in the shared folder, or in a temporary one where the session names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    root = shared.removeprefix("file://").removeprefix("file:") if shared else tempfile.mkdtemp(prefix="leadtime-")
    return Archive(spark, os.path.join(root, "leadtime-stores", uuid.uuid4().hex))


def _own(x: Fixture, *more: str) -> DataFrame:
    """The runs of one model version, without its name."""
    return x.forecasts.filter(Scope.of(**V1).condition()).select("series_id", "origin", "target", "value", *more)


def _stored(archive: Archive) -> DataFrame:
    return archive.as_of("2200-01-01").select(*CANONICAL)


def _ingest_roundtrip(x: Fixture) -> DataFrame:
    """A delivery with other names goes in twice, what comes out is what went in once."""
    archive = _archive(x.cells.sparkSession)
    frame = _own(x).toDF("sku", "run", "day", "yhat")
    for _ in range(2):
        archive.ingest(frame, {"series_id": "sku", "origin": "run", "target": "day", "value": "yhat"}, **V1)
    return _stored(archive)


def _adapter_roundtrip(x: Fixture) -> DataFrame:
    archive = _archive(x.cells.sparkSession)
    archive.ingest_cross_validation(_own(x).toDF("unique_id", "cutoff", "ds", "persist"), **V1)
    return _stored(archive)


def _superseded(x: Fixture) -> DataFrame:
    """Runs of the third of a month are replaced by a second delivery; only live runs are seen."""
    archive = _archive(x.cells.sparkSession)
    archive.ingest(_own(x), **V1)
    archive.ingest(_own(x).filter(F.dayofmonth("origin") == 3).withColumn("value", F.col("value") + 1.0), on_conflict="overwrite", **V1)
    return _stored(archive)


def _observed(x: Fixture) -> Archive:
    """An archive with one model version and each cell's count as its actual."""
    archive = _archive(x.cells.sparkSession)
    archive.ingest(_own(x), **V1)
    archive.register_actuals(x.cells.select("series_id", F.col("d").alias("target"), F.col("c").alias("value")), recorded_at="2100-01-01")
    return archive


def _summary_route(x: Fixture) -> DataFrame:
    """A whole curve by default; the stored summary serves it."""
    curve = _observed(x).accuracy_curve("RMSE", **V1)
    rows = [(p.horizon, p.metric, p.basis, p.status, p.value, p.n, p.n_missing_actuals, p.served_from) for p in curve]
    return x.cells.sparkSession.createDataFrame(rows, "horizon long, metric string, basis string, status string, value double, n long, n_missing_actuals long, served_from string")


def _official_route(x: Fixture) -> DataFrame:
    """Marked values and those designated on registration, read through the archive with fallback."""
    archive = _observed(x)
    third = x.cells.filter(F.dayofmonth("d") == 3).select("series_id", F.col("d").alias("target"), (F.col("c") + 1.0).alias("value"))
    archive.register_actuals(third, source="audit", recorded_at="2100-01-02", official=True)
    snapshot = archive.commits.snapshot()
    return archive._effective(snapshot, "official", "latest")


def _compare_custom(x: Fixture) -> DataFrame:
    """A registered metric compared through the archive, with a pair that has no runs."""
    archive = _observed(x)
    archive.register_metric("WORST", _maxae, summarizable=False)
    return archive.compare_models(7, [("persist", "v1"), ("nobody", "v1")], "WORST", champion=("persist", "v1"))


_ROUND = _with(f"SELECT {', '.join(CANONICAL)} FROM fc WHERE {V1_SQL}")
_OBSERVED = "(SELECT series_id, d AS target, c AS actual_value, false AS is_fallback FROM fx_cells)"
_add("ingest_roundtrip", _ingest_roundtrip, _ROUND)
_add("adapter_roundtrip", _adapter_roundtrip, _ROUND)
_add("superseded_view", _superseded, _with(f"SELECT model_id, model_version, series_id, origin, target, value + CASE WHEN day(origin) = 3 THEN 1 ELSE 0 END AS value, horizon FROM fc WHERE {V1_SQL}"))
_add("summary_route", _summary_route, f"WITH {FIXTURES},\n{_cells_sql(_OBSERVED, 'horizon', V1_SQL)}\nSELECT horizon, 'RMSE' AS metric, 'latest' AS basis, {_status('RMSE')}, \"RMSE\" AS value, n, n_missing_actuals, 'summary' AS served_from FROM cells")
_add("official_route", _official_route, _with("SELECT series_id, d AS target, c + CASE WHEN day(d) = 3 THEN 1 ELSE 0 END AS actual_value, day(d) <> 3 AS is_fallback FROM fx_cells"))
_add(
    "compare_custom", _compare_custom,
    f"""WITH {FIXTURES},
p AS (SELECT abs(value - actual_value) AS e FROM fc LEFT JOIN {_OBSERVED} a USING (series_id, target) WHERE {V1_SQL} AND horizon = 7),
w AS (SELECT max(e) AS value, count(e) AS n, count(*) - count(e) AS gone FROM p)
SELECT 'persist' AS model_id, 'v1' AS model_version, CAST(7 AS BIGINT) AS horizon, 'WORST' AS metric, 'latest' AS basis, CASE WHEN gone > 0 THEN 'partial' ELSE 'ok' END AS status, value, n, 'v1' AS champion_version, true AS is_champion, 0::DOUBLE AS delta_vs_champion FROM w
UNION ALL {_MISSING.replace("'MAE'", "'WORST'")} FROM (VALUES (7)) AS z(h)""",
)


def _custom(name: str, fn: Callable) -> Callable[[Fixture], DataFrame]:
    return lambda x: custom(E.align(x.forecasts, x.actuals()).filter("actual_value is not null"), BY_MODEL, Metric(name, fn)).select(*BY_MODEL, "value", "n", "status")


def _maxae(forecast, actual) -> float:
    return abs(forecast - actual).max()


def _median(forecast, actual) -> float:
    import numpy as np

    return np.median(abs(forecast - actual))


for _name, _fn, _sql in (("custom_metric_maxae", _maxae, "max"), ("custom_metric_median", _median, "median")):
    _add(_name, _custom(_name, _fn), _with(f"SELECT {BY_MODEL_SQL}, {_sql}(abs(value - actual_value)) AS value, count(*) AS n, 'ok' AS status FROM fc JOIN latest USING (series_id, target) GROUP BY 1, 2, 3"))


def _canonicalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = Fixture(spark, sf_dir).forecasts.filter(Scope.of(**V1).condition()).select(F.concat(F.lit(" \t"), "series_id", F.lit("\n")).alias("sku"), F.date_format("origin", "yyyyMMdd").alias("run"), F.col("target").cast("date").alias("day"), F.col("value").cast("string").alias("yhat"))
    return canonical_forecasts(raw, {"series_id": "sku", "origin": "run", "target": "day", "value": "yhat"}, **V1)


QUERIES["canonicalize_frame"] = _canonicalized
ORACLES["canonicalize_frame"] = _with(f"SELECT * FROM fc WHERE {V1_SQL}")


def _curve_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly variant: many series, few of whose targets were observed."""
    x = Fixture(spark, sf_dir, X.event_cells)
    return E.curve(x.forecasts, x.actuals(), keys=BY_MODEL)


QUERIES["curve_of_events"] = _curve_of_events
ORACLES["curve_of_events"] = _curve_sql("latest", "MAE", "latest", BY_MODEL_SQL).replace(
    "SELECT o_orderpriority AS series_id, o_orderdate AS d, count(*)::DOUBLE AS c FROM orders GROUP BY 1, 2",
    "SELECT event_type || '-' || (user_id % 16)::VARCHAR AS series_id, date_trunc('hour', ts)::TIMESTAMP AS d, count(*)::DOUBLE AS c FROM events GROUP BY 1, 2",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by horizon of all models."""
    return QUERIES["accuracy_curve_all_models"](spark, sf_dir)
