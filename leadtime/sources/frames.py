"""Adapter for cross-validation frames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import ValidationError


def cross_validation_mapping(frame: DataFrame, model_id: str, value_column: str | None = None) -> dict[str, str]:
    """Canonical field -> column of a frame with unique_id, ds, cutoff and a column of forecasts, by default named as the model."""
    found = {"series_id": "unique_id", "target": "ds", "origin": "cutoff", "value": value_column or model_id}
    missing = sorted(set(found.values()) - set(frame.columns))
    if missing:
        raise ValidationError(f"missing columns {missing}")
    return found
