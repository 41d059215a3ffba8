"""Schemas of the canonical relations. Times are without zone; measures are doubles."""

from pyspark.sql import types as T

POOLED, WHOLE_PERIOD, DEFAULT_SOURCE = "*", "all", "default"


def _schema(text: str) -> T.StructType:
    kinds = {"s": T.StringType(), "t": T.TimestampNTZType(), "d": T.DoubleType(), "l": T.LongType(), "b": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (p.split(":") for p in text.split())])


FORECASTS = _schema("model_id:s model_version:s series_id:s origin:t target:t value:d horizon:l run_id:s ingested_at:t")
ACTUALS = _schema("series_id:s target:t source:s actual_value:d actual_recorded_at:t is_official:b")
OFFICIALS = _schema("series_id:s target:t source:s actual_recorded_at:t designated_at:t")
#: As stored: with the number of the commit that wrote it, which settles equal times.
DESIGNATIONS = _schema("series_id:s target:t source:s actual_recorded_at:t designated_at:t commit_seq:l")
EFFECTIVE = _schema("series_id:s target:t actual_value:d is_fallback:b")
SUMMARY = _schema("model_id:s model_version:s series_id:s horizon:l metric:s period:s actual_basis:s value:d n:l n_forecasts:l")
CURVE = _schema("horizon:l metric:s basis:s status:s value:d n:l n_missing_actuals:l n_fallback:l")
COMPARE = _schema("model_id:s model_version:s horizon:l metric:s basis:s status:s value:d n:l champion_version:s is_champion:b delta_vs_champion:d")
DRILL = _schema("model_id:s model_version:s series_id:s origin:t target:t horizon:l value:d actual_value:d is_fallback:b")
LISTING = _schema("model_id:s model_version:s n_rows:l n_series:l first_origin:t last_origin:t first_target:t last_target:t is_champion:b")
