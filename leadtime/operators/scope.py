"""Which forecasts a question covers: checked arguments, then one conjunction for the scan."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..schemas import POOLED
from .normalize import wall_time


def series_list(series) -> list[str] | None:
    """None is all; a string is one; else each item as text. Empty lists and the reserved name are refused."""
    if series is None:
        return None
    if isinstance(series, bytes) or not isinstance(series, (str, Iterable)):
        raise ValidationError("series must be a name or names")
    found = [series] if isinstance(series, str) else [str(s) for s in series]
    if not found or POOLED in found:
        raise ValidationError(f"series must be names other than {POOLED!r}")
    return found


def horizon_of(value) -> int:
    """A whole number of days; 7.0 is one, True is not."""
    if isinstance(value, bool):
        raise ValidationError("a horizon is a number of days")
    try:
        number = float(value)
    except (TypeError, ValueError) as e:
        raise ValidationError(f"horizon {value!r}") from e
    if isinstance(value, str) or not math.isfinite(number) or number != int(number) or not -(2**63) <= int(number) < 2**63:
        raise ValidationError(f"horizon {value!r}")
    return int(value)


def horizon_list(values) -> list[int]:
    if isinstance(values, (str, bytes)) or not isinstance(values, Iterable):
        raise ValidationError("horizons must be a list")
    return [horizon_of(v) for v in values]


def model_list(models) -> list[tuple[str, str]]:
    """Non-empty list of (model_id, model_version)."""
    if isinstance(models, (str, bytes)) or not isinstance(models, Iterable):
        raise ValidationError("models must be a list of pairs")
    found = []
    for m in models:
        if isinstance(m, (str, bytes)) or not hasattr(m, "__len__") or len(m) != 2:
            raise ValidationError(f"{m!r} is no (model_id, model_version)")
        found.append((str(m[0]), str(m[1])))
    if not found:
        raise ValidationError("no models")
    return found


def period_of(period) -> tuple[datetime | None, datetime | None]:
    """(first, last) origin, both included, either open."""
    if period is None:
        return None, None
    if not isinstance(period, (tuple, list)) or len(period) != 2:
        raise ValidationError("a period is a pair")
    return tuple(None if p is None else wall_time(p, "period") for p in period)


@dataclass(frozen=True)
class Scope:
    """All of it holds; None does not restrict, an empty list matches nothing."""

    model_id: str | None = None
    model_version: str | None = None
    models: tuple[tuple[str, str], ...] | None = None
    series: tuple[str, ...] | None = None
    horizons: tuple[int, ...] | None = None
    first_origin: datetime | None = None
    last_origin: datetime | None = None

    @staticmethod
    def of(model_id=None, model_version=None, models=None, series=None, horizons=None, period=None, until=None) -> Scope:
        first, last = period_of(period)
        until = None if until is None else wall_time(until, "origin")
        last = min(x for x in (last, until) if x is not None) if last or until else None
        names = series_list(series)
        return Scope(model_id, model_version, None if models is None else tuple(model_list(models)), None if names is None else tuple(names), None if horizons is None else tuple(horizons), first, last)

    def condition(self) -> Column:
        """Comparisons on plain columns only, so that the scan takes them as filters."""
        time = lambda t: F.lit(t).cast("timestamp_ntz")
        parts = [F.lit(True)]
        if self.model_id is not None:
            parts.append(F.col("model_id") == self.model_id)
        if self.model_version is not None:
            parts.append(F.col("model_version") == self.model_version)
        if self.models is not None:
            parts.append(reduce(lambda a, b: a | b, [(F.col("model_id") == m) & (F.col("model_version") == v) for m, v in self.models], F.lit(False)))
        if self.series is not None:
            parts.append(F.col("series_id").isin(*self.series) if self.series else F.lit(False))
        if self.horizons is not None:
            parts.append(F.col("horizon").isin(*self.horizons) if self.horizons else F.lit(False))
        if self.first_origin is not None:
            parts.append(F.col("origin") >= time(self.first_origin))
        if self.last_origin is not None:
            parts.append(F.col("origin") <= time(self.last_origin))
        return reduce(lambda a, b: a & b, parts)

    def apply(self, forecasts: DataFrame) -> DataFrame:
        return forecasts.filter(self.condition())
