"""Canonical rows from callers' frames: mapping, validation, horizons, run digests."""

from __future__ import annotations

import numbers
from collections.abc import Mapping
from datetime import datetime

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..schemas import DEFAULT_SOURCE, POOLED

DAY_US = 86_400_000_000


def _numbers(values) -> bool:
    """Whether any value is a number; booleans are not."""
    return bool(values.map(lambda v: isinstance(v, numbers.Real) and not isinstance(v, (bool, np.bool_)) and v == v).any())


def as_frame(spark: SparkSession, frame, times: tuple[str, ...] = ()) -> DataFrame:
    """A Spark frame of a Spark or pandas frame. Zoned pandas times keep their wall time.

    ``times`` names the columns that are to hold times: numbers among their values are refused, also where the column's type hides them.
    """
    if isinstance(frame, DataFrame):
        return frame
    fields = []
    frame = frame.copy()
    for name in frame.columns:
        kind = frame[name].dtype
        if str(kind).startswith("datetime64"):
            if getattr(kind, "tz", None) is not None:
                frame[name] = frame[name].dt.tz_localize(None)
            fields.append(T.StructField(str(name), T.TimestampNTZType()))
        elif kind == bool:
            fields.append(T.StructField(str(name), T.BooleanType()))
        elif kind.kind in "iu":
            fields.append(T.StructField(str(name), T.LongType()))
        elif kind.kind == "f":
            fields.append(T.StructField(str(name), T.DoubleType()))
        else:
            values = frame[name].map(lambda v: None if v is None or v != v else v)
            if len(values) and values.map(lambda v: isinstance(v, datetime) or v is None).all():
                frame[name] = values.map(lambda v: v.replace(tzinfo=None) if v is not None else None)
                fields.append(T.StructField(str(name), T.TimestampNTZType()))
                continue
            if name in times and _numbers(values):
                raise ValidationError(f"{name} holds numeric values; times are needed")
            frame[name] = values.map(lambda v: None if v is None else str(v))
            fields.append(T.StructField(str(name), T.StringType()))
    return spark.createDataFrame(frame, T.StructType(fields))


def identity(value, name: str) -> str:
    """A non-blank string."""
    if not isinstance(value, str) or not value.strip():
        raise ValidationError(f"{name} must be a non-empty string")
    return value


def source_label(source) -> str:
    """The given source, or the default one for None."""
    return DEFAULT_SOURCE if source is None else identity(source, "source")


def wall_time(value, name: str) -> datetime:
    """A scalar time without zone; the wall time of a zoned one."""
    if isinstance(value, str):
        try:
            value = datetime.strptime(value, "%Y%m%d") if len(value) == 8 and value.isdigit() else datetime.fromisoformat(value)
        except ValueError as e:
            raise ValidationError(f"{name}: {value!r} is no time") from e
    if hasattr(value, "to_pydatetime"):
        value = value.to_pydatetime()
    if isinstance(value, bool) or not isinstance(value, datetime) or value != value:
        if hasattr(value, "year") and not isinstance(value, datetime):
            return datetime(value.year, value.month, value.day)
        raise ValidationError(f"{name}: {value!r} is no time")
    return value.replace(tzinfo=None)


def resolve(frame: DataFrame, mapping: Mapping[str, str] | None, fields: list[str]) -> dict[str, str]:
    """Caller's column of each canonical field; fields not mapped keep their name."""
    mapping = dict(mapping or {})
    odd = set(mapping) - set(fields)
    found = {f: mapping.get(f, f) for f in fields}
    missing = sorted(f for f, c in found.items() if c not in frame.columns)
    if odd or missing:
        raise ValidationError(f"missing columns for {missing}; unknown fields {sorted(odd)}")
    return found


def time_columns(mapping: Mapping[str, str] | None, fields: tuple[str, ...] = ("origin", "target")) -> tuple[str, ...]:
    """The caller's columns of the time fields."""
    return tuple((mapping or {}).get(f, f) for f in fields)


def series_text(col: Column) -> Column:
    """Identifier as text without surrounding white space of any kind."""
    return F.regexp_replace(col.cast("string"), r"(?U)^\s+|\s+$", "")


def bad_series(col: Column) -> Column:
    return col.isNull() | (col == "") | (col == POOLED)


def bad_value(col: Column) -> Column:
    return col.isNull() | F.isnan(col) | (F.abs(col) == float("inf"))


def times(frame: DataFrame, column: str, field: str) -> Column:
    """The column as a time without zone; null where it cannot be read. Numeric columns are refused."""
    kind = frame.schema[column].dataType
    col = F.col(f"`{column}`")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        raise ValidationError(f"{field}: numeric values are no times")
    if isinstance(kind, T.StringType):
        return F.coalesce(col.try_cast("timestamp_ntz"), F.try_to_timestamp(col, F.lit("yyyyMMdd")).cast("timestamp_ntz"))
    return col.cast("timestamp_ntz")


def horizon_us(origin: Column, target: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", origin, target)


def canonical_forecasts(frame: DataFrame, mapping: Mapping[str, str] | None, *, model_id: str, model_version: str, origin=None) -> DataFrame:
    """model_id, model_version, series_id, origin, target, value, horizon of a caller's frame, checked in one job.

    Refused are empty frames, null or blank or reserved series, times that cannot be read, values that are not finite numbers, horizons
    of no whole number of days, and repeated (series, origin, target).
    """
    identity(model_id, "model_id")
    identity(model_version, "model_version")
    fields = ["series_id", "target", "value"] + ([] if origin is not None else ["origin"])
    at = resolve(frame, mapping, fields)
    start = F.lit(wall_time(origin, "origin")).cast("timestamp_ntz") if origin is not None else times(frame, at["origin"], "origin")
    rows = frame.select(
        F.lit(model_id).alias("model_id"), F.lit(model_version).alias("model_version"),
        series_text(F.col(f"`{at['series_id']}`")).alias("series_id"), start.alias("origin"), times(frame, at["target"], "target").alias("target"),
        F.col(f"`{at['value']}`").try_cast("double").alias("value"),
    )
    apart = horizon_us(F.col("origin"), F.col("target"))
    rows = rows.withColumn("horizon", F.expr(f"timestampdiff(MICROSECOND, origin, target) div {DAY_US}"))
    bad = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(bad_series(F.col("series_id"))).alias("series"), F.count_if(F.col("origin").isNull() | F.col("target").isNull()).alias("times"),
        F.count_if(bad_value(F.col("value"))).alias("values"), F.count_if(apart % DAY_US != 0).alias("horizons"),
    ).first().asDict()
    if not bad.pop("rows"):
        raise ValidationError("the frame is empty")
    if any(bad.values()):
        raise ValidationError("refused rows: " + ", ".join(f"{n} with bad {k}" for k, n in bad.items() if n))
    if not rows.groupBy("series_id", "origin", "target").count().filter("count > 1").isEmpty():
        raise ValidationError("a (series, origin, target) is repeated")
    return rows


def canonical_actuals(frame: DataFrame, mapping: Mapping[str, str] | None, *, source=None, recorded_at=None, official: bool = False) -> DataFrame:
    """The actuals log's rows of a caller's frame; equal duplicates collapse, differing ones are refused."""
    at = resolve(frame, mapping, ["series_id", "target", "value"])
    known = wall_time(recorded_at, "recorded_at") if recorded_at is not None else datetime.now().replace(tzinfo=None)
    rows = frame.select(
        series_text(F.col(f"`{at['series_id']}`")).alias("series_id"), times(frame, at["target"], "target").alias("target"),
        F.lit(source_label(source)).alias("source"), F.col(f"`{at['value']}`").try_cast("double").alias("actual_value"),
        F.lit(known).cast("timestamp_ntz").alias("actual_recorded_at"), F.lit(bool(official)).alias("is_official"),
    )
    bad = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(bad_series(F.col("series_id"))).alias("series"),
        F.count_if(F.col("target").isNull()).alias("times"), F.count_if(bad_value(F.col("actual_value"))).alias("values"),
    ).first().asDict()
    if not bad.pop("rows"):
        raise ValidationError("the frame is empty")
    if any(bad.values()):
        raise ValidationError("refused rows: " + ", ".join(f"{n} with bad {k}" for k, n in bad.items() if n))
    if not rows.groupBy("series_id", "target").agg(F.count_distinct("actual_value").alias("k")).filter("k > 1").isEmpty():
        raise ValidationError("a (series, target) has two values")
    return rows.dropDuplicates(["series_id", "target"])


def run_digests(rows: DataFrame) -> DataFrame:
    """One row per run (model_id, model_version, origin, series_id) with digest and n_rows.

    The digest covers the run's whole set of (target, value); -0.0 counts as 0.0. A run is one series at one origin, so
    its rows are few.
    """
    value = F.when(F.col("value") == 0, F.lit(0.0)).otherwise(F.col("value"))
    line = F.concat_ws("=", F.unix_micros(F.col("target").cast("timestamp")).cast("string"), value.cast("string"))
    return rows.groupBy("model_id", "model_version", "origin", "series_id").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ";"), 256).alias("digest"), F.count(F.lit(1)).alias("n_rows")
    )


def plan_runs(digests: DataFrame, active: DataFrame) -> DataFrame:
    """``digests`` with status new, same or changed against the active runs (same keys and digest)."""
    keys = ["model_id", "model_version", "origin", "series_id"]
    known = active.select(*keys, F.col("digest").alias("known"))
    status = F.when(F.col("known").isNull(), "new").when(F.col("known") == F.col("digest"), "same").otherwise("changed")
    return digests.join(known, keys, "left").withColumn("status", status).drop("known")
