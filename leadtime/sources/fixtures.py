"""Forecasts, actuals and designations derived from an ``orders`` table, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HORIZONS = (1, 2, 3, 7, 14)
#: (model_id, model_version, constant bias, bias per day of horizon)
MODELS = (("persist", "v1", 0, 0), ("persist", "v2", 1, 0), ("drift", "v1", 0, 1))
PRIORITY = ("feed", "ops")
CHAMPIONS = {"persist": "v1"}


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, d, c: orders of each priority and day."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("d")).agg(F.count(F.lit(1)).cast("double").alias("c"))


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The denser variant: events of each type and user group by the hour."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    series = F.concat_ws("-", "event_type", (F.col("user_id") % 16).cast("string"))
    return events.groupBy(series.alias("series_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("d")).agg(F.count(F.lit(1)).cast("double").alias("c"))


def forecasts(cells: DataFrame) -> DataFrame:
    """Each cell forecast by every model at every horizon; one generated array, no join."""
    made = F.array(*[F.struct(F.lit(m).alias("model_id"), F.lit(v).alias("model_version"), F.lit(h).cast("long").alias("horizon"), F.lit(float(b + k * h)).alias("bias")) for m, v, b, k in MODELS for h in HORIZONS])
    rows = cells.select("series_id", "d", "c", F.explode(made).alias("m"))
    return rows.select("m.model_id", "m.model_version", "series_id", F.col("d").alias("origin"), F.expr("d + make_dt_interval(cast(m.horizon as int))").alias("target"), (F.col("c") + F.col("m.bias")).alias("value"), "m.horizon")


def actuals_log(cells: DataFrame) -> DataFrame:
    day = F.dayofmonth("d")

    def entry(source: str, value, days: int):
        return F.struct(F.lit(source).alias("source"), value.alias("actual_value"), F.expr(f"d + make_dt_interval({days})").alias("actual_recorded_at"))

    ops = F.col("c") + F.when(day % 18 == 0, 1.0).otherwise(2.0)
    made = F.array(entry("feed", F.col("c"), 1), F.when(day % 3 == 0, entry("feed", F.col("c") + 1.0, 5)), F.when(day % 6 == 0, entry("ops", ops, 5)))
    return cells.select("series_id", F.col("d").alias("target"), F.explode(F.filter(made, lambda x: x.isNotNull())).alias("a")).select("series_id", "target", "a.source", "a.actual_value", "a.actual_recorded_at")


def officials(cells: DataFrame) -> DataFrame:
    day = F.dayofmonth("d")

    def entry(recorded: int, designated: int):
        return F.struct(F.lit("feed").alias("source"), F.expr(f"d + make_dt_interval({recorded})").alias("actual_recorded_at"), F.expr(f"d + make_dt_interval({designated})").alias("designated_at"))

    made = F.array(F.when(day % 4 == 0, entry(1, 6)), F.when(day % 12 == 0, entry(5, 7)))
    return cells.select("series_id", F.col("d").alias("target"), F.explode(F.filter(made, lambda x: x.isNotNull())).alias("a")).select("series_id", "target", "a.source", "a.actual_recorded_at", "a.designated_at")
