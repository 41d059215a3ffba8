"""The accuracy cube: per series and pooled, every metric, as a long table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import BUILT_IN, expression, with_steps
from ..schemas import POOLED, SUMMARY, WHOLE_PERIOD
from .evaluate import align

CELL = ["model_id", "model_version", "series_id", "horizon"]
#: Order of the stored summary.
ORDER = [*CELL, "metric", "period", "actual_basis"]


def cube(forecasts: DataFrame, actuals: DataFrame, basis: str, metrics: Sequence[str] = BUILT_IN) -> DataFrame:
    """SUMMARY rows of one basis; cells without matches and undefined metrics are left out.

    One lag pass serves both grains, since a trajectory lies within a series; one GROUPING SETS aggregate gives all
    metrics as columns, which are then stacked.
    """
    rows = with_steps(align(forecasts, actuals), CELL)
    cells = rows.groupingSets([["model_id", "model_version", "series_id", "horizon"], ["model_id", "model_version", "horizon"]], "model_id", "model_version", "series_id", "horizon").agg(
        F.grouping("series_id").alias("pooled"), F.count(F.lit(1)).alias("n_forecasts"), F.count("actual_value").alias("n"), *[expression(m).alias(m) for m in metrics]
    )
    pairs_sql = ", ".join(f"'{m}', `{m}`" for m in metrics)
    long = cells.filter("n > 0").select(
        "model_id", "model_version", F.when(F.col("pooled") == 1, POOLED).otherwise(F.col("series_id")).alias("series_id"), "horizon", "n", "n_forecasts",
        F.expr(f"stack({len(metrics)}, {pairs_sql}) as (metric, value)"),
    ).filter("value is not null")
    return long.withColumns({"period": F.lit(WHOLE_PERIOD), "actual_basis": F.lit(basis)}).select(*SUMMARY.fieldNames())


def differences(stored: DataFrame, fresh: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Cells that differ: missing on a side, other counts, or values apart by more than a relative tolerance.

    Sums of doubles depend on their order, so equal cells may differ in the last digits.
    """
    keys = ["model_id", "model_version", "series_id", "horizon", "metric", "period", "actual_basis"]
    a, b = (d.select(*keys, F.struct("value", "n", "n_forecasts").alias(n)) for d, n in ((stored, "a"), (fresh, "b")))
    near = F.abs(F.col("a.value") - F.col("b.value")) <= tolerance * F.greatest(F.abs(F.col("a.value")), F.abs(F.col("b.value")), F.lit(1e-300))
    same = near & (F.col("a.n") == F.col("b.n")) & (F.col("a.n_forecasts") == F.col("b.n_forecasts"))
    return a.join(b, keys, "full").filter(~F.coalesce(same, F.lit(False)))
