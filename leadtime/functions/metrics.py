"""Accuracy metrics: built-ins as Spark aggregates, custom ones as guarded grouped functions."""

from __future__ import annotations

import hashlib
import math
import threading
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import UnknownMetricError, ValidationError

BUILT_IN = ("MAE", "RMSE", "MAPE", "MASE")
TRAJECTORY = ("model_id", "model_version", "series_id")
#: Seconds a custom metric may take for one group.
BUDGET = 10.0


def finite(value: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def with_steps(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``step``: |actual - previous actual| along each trajectory within ``keys``, of matched rows only and null on others.

    The lag runs over the rows given, so filters on period, horizon and matching belong before it. Rows without an actual are
    another part of the window, so one pass over the pairs serves both.
    """
    matched = F.col("actual_value").isNotNull()
    along = Window.partitionBy(*dict.fromkeys([*keys, *TRAJECTORY]), matched).orderBy("target", "origin")
    return pairs.withColumn("step", F.when(matched, F.abs(F.col("actual_value") - F.lag("actual_value", 1).over(along))))


def expression(metric: str) -> Column:
    """Aggregate over rows with value, actual_value and, for MASE, step; null where undefined or nothing is matched."""
    error = F.col("value") - F.col("actual_value")
    matched = F.col("actual_value").isNotNull()
    if metric == "MAE":
        return finite(F.avg(F.when(matched, F.abs(error))))
    if metric == "RMSE":
        return finite(F.sqrt(F.avg(F.when(matched, error * error))))
    if metric == "MAPE":
        return finite(F.avg(F.when(matched & (F.col("actual_value") != 0), F.abs(F.try_divide(error, F.col("actual_value"))))))
    if metric == "MASE":
        return finite(F.try_divide(F.avg(F.when(matched, F.abs(error))), F.nullif(F.avg("step"), F.lit(0.0))))
    raise UnknownMetricError(metric)


@dataclass
class Metric:
    """A registered function of (forecasts, actuals); a fresh identity each time it is registered."""

    name: str
    fn: Callable | None
    summarizable: bool = True
    identity: str = field(default_factory=lambda: uuid.uuid4().hex)


class Registry:
    """Metrics by name, and those set aside because they did not end in time."""

    def __init__(self, budget: float = BUDGET) -> None:
        self.budget = budget
        self.metrics = {name: Metric(name, None, True, f"built-in:{name}") for name in BUILT_IN}
        self.quarantined: set[str] = set()

    def register(self, name: str, fn: Callable, summarizable: bool = True) -> None:
        """Add or replace a custom metric; replacing clears its quarantine."""
        if not isinstance(name, str) or not name:
            raise ValidationError("a metric's name must be a non-empty string")
        if name in BUILT_IN:
            raise ValidationError(f"{name} is built in")
        if not callable(fn):
            raise ValidationError("a metric must be callable")
        self.metrics[name] = Metric(name, fn, summarizable)
        self.quarantined.discard(name)

    def get(self, name: str) -> Metric:
        if name not in self.metrics:
            raise UnknownMetricError(name)
        return self.metrics[name]

    def names(self, summarizable: bool = False) -> list[str]:
        return sorted(n for n, m in self.metrics.items() if m.summarizable or not summarizable)

    def token(self) -> str:
        """Changes with every registration and every quarantine."""
        held = [(n, m.identity, m.summarizable, n in self.quarantined) for n, m in sorted(self.metrics.items())]
        return hashlib.sha256(repr(held).encode()).hexdigest()


def guarded(fn: Callable, forecasts, actuals, budget: float) -> tuple[float | None, str]:
    """(value, status) of one evaluation in a thread of its own: ok, undefined, error or timeout."""
    result: list[tuple[float | None, str]] = []

    def work() -> None:
        try:
            value = float(fn(forecasts, actuals))
            result.append((value, "ok") if math.isfinite(value) else (None, "undefined"))
        except Exception:  # noqa: BLE001  a custom metric may raise anything
            result.append((None, "error"))

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    thread.join(budget)
    return result[0] if result else (None, "timeout")


_hung: set[str] = set()


def custom(matched: DataFrame, keys: Sequence[str], metric: Metric, budget: float = BUDGET) -> DataFrame:
    """``keys``, value, n, status of a custom metric for each group of matched pairs.

    Its arrays are ordered by series, target, model and version whatever the input's order. A group must fit
    one task, since the function takes it whole. After a first timeout a worker answers 'timeout' at once.
    """
    fn, identity = metric.fn, metric.identity
    names = list(keys)
    order = ["series_id", "target", "model_id", "model_version"]
    rows = matched.withColumn("__all", F.lit(1)) if not names else matched
    group = names or ["__all"]
    kept = list(dict.fromkeys([*group, *order, "value", "actual_value"]))

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(order, kind="stable")
        if identity in _hung:
            value, status = None, "timeout"
        else:
            value, status = guarded(fn, pdf["value"].to_numpy(), pdf["actual_value"].to_numpy(), budget)
        if status == "timeout":
            _hung.add(identity)
        return pd.DataFrame([[*key, value, len(pdf), status]], columns=[*group, "value", "n", "status"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in group) + ", value double, n long, status string"
    return rows.select(*kept).groupBy(*group).applyInPandas(run, schema).select(*names, "value", "n", "status")
