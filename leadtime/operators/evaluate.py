"""Accuracy of aligned pairs: curves, comparison, drill-down, listing. Everything is one grouped job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import BUILT_IN, expression, with_steps
from .actuals import KEY
from .scope import Scope


def align(forecasts: DataFrame, actuals: DataFrame) -> DataFrame:
    """Every forecast with the value of its (series, target), null where there is none."""
    return forecasts.join(actuals, KEY, "left")


def status_of(n: Column, missing: Column, value: Column) -> Column:
    """insufficient without a value, partial if any forecast has no actual, else ok."""
    return F.when((n == 0) | value.isNull(), "insufficient").when(missing > 0, "partial").otherwise("ok")


def accuracy(pairs: DataFrame, keys: Sequence[str], metrics: Sequence[str] = BUILT_IN) -> DataFrame:
    """keys, n_forecasts, n, n_missing_actuals, n_fallback and a column per metric, of aligned pairs.

    Steps for MASE are taken along matched pairs only, in a window that the other metrics do without.
    """
    rows = with_steps(pairs, keys) if "MASE" in metrics else pairs
    fallback = F.count_if(F.col("is_fallback") & F.col("actual_value").isNotNull()) if "is_fallback" in pairs.columns else F.lit(0).cast("long")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_forecasts"), F.count("actual_value").alias("n"), F.count_if(F.col("actual_value").isNull()).alias("n_missing_actuals"),
        fallback.alias("n_fallback"), *[expression(m).alias(m) for m in metrics],
    )


def curve(forecasts: DataFrame, actuals: DataFrame, metric: str = "MAE", basis: str = "latest", scope: Scope = Scope(), keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """Per ``keys``: metric, basis, status, value, n, n_missing_actuals, n_fallback. All horizons are one job."""
    cells = accuracy(align(scope.apply(forecasts), actuals), keys, [metric])
    return cells.select(
        *keys, F.lit(metric).alias("metric"), F.lit(basis).alias("basis"), status_of(F.col("n"), F.col("n_missing_actuals"), F.col(metric)).alias("status"),
        F.col(metric).alias("value"), "n", "n_missing_actuals", "n_fallback",
    )


def wanted_models(models: Sequence[tuple[str, str]], champions: Mapping[str, str]) -> list[tuple[str, str]]:
    """The listed pairs and their champions, each once."""
    return list(dict.fromkeys([*models, *[(m, champions[m]) for m, _ in models if m in champions]]))


def compare(forecasts: DataFrame, actuals: DataFrame, models: Sequence[tuple[str, str]], champions: Mapping[str, str], metric: str = "MAE", basis: str = "latest", scope: Scope = Scope(), horizons: Sequence[int] | None = None) -> DataFrame:
    """``compared`` of a built-in metric; ``horizons`` are those asked for, else those of the listed models in scope."""
    pick = Scope.of(models=wanted_models(models, champions))
    cells = curve(pick.apply(forecasts), actuals, metric, basis, scope, ("model_id", "model_version", "horizon"))
    return compared(cells, models, champions, metric, basis, horizons)


def compared(cells: DataFrame, models: Sequence[tuple[str, str]], champions: Mapping[str, str], metric: str, basis: str, horizons: Sequence[int] | None = None) -> DataFrame:
    """A row for every listed pair, as often as it is listed, at every horizon, with the difference to its champion, listed or not.

    ``cells``: model_id, model_version, horizon, status, value, n of the pairs and their champions. A pair without forecasts at a horizon is
    insufficient with n 0; the difference is null unless both have a value. The column place counts the pairs as listed, position the horizons.
    """
    if horizons is None:
        at = cells.filter(Scope.of(models=models).condition()).select("horizon").distinct().withColumn("position", F.col("horizon"))
    else:
        at = cells.sparkSession.createDataFrame(list(enumerate(horizons)), "position long, horizon long")
    text = lambda x: F.lit(x).cast("string")
    listed = F.array(*[F.struct(F.lit(i).alias("place"), text(m).alias("model_id"), text(v).alias("model_version"), text(champions.get(m)).alias("champion_version")) for i, (m, v) in enumerate(models)])
    rows = at.select("position", "horizon", F.inline(listed))
    own = cells.select("model_id", "model_version", "horizon", "status", "value", "n")
    best = cells.select("model_id", F.col("model_version").alias("champion_version"), "horizon", F.col("value").alias("__best"))
    found = rows.join(own, ["model_id", "model_version", "horizon"], "left").join(best, ["model_id", "champion_version", "horizon"], "left")
    return found.select(
        "model_id", "model_version", "horizon", F.lit(metric).alias("metric"), F.lit(basis).alias("basis"), F.coalesce("status", F.lit("insufficient")).alias("status"), "value",
        F.coalesce("n", F.lit(0)).cast("long").alias("n"), "champion_version",
        F.coalesce(F.col("model_version") == F.col("champion_version"), F.lit(False)).alias("is_champion"), (F.col("value") - F.col("__best")).alias("delta_vs_champion"), "place", "position",
    )


def drill(forecasts: DataFrame, actuals: DataFrame, scope: Scope) -> DataFrame:
    """The matched pairs behind a cell, in no order."""
    rows = scope.apply(forecasts).join(actuals, KEY)
    return rows.select("model_id", "model_version", "series_id", "origin", "target", "horizon", "value", "actual_value", "is_fallback")


def as_of(forecasts: DataFrame, origin, **scope) -> DataFrame:
    """Forecasts made up to ``origin``, without run ids."""
    return Scope.of(until=origin, **scope).apply(forecasts).drop("run_id")


def horizons(forecasts: DataFrame, scope: Scope = Scope()) -> DataFrame:
    return scope.apply(forecasts).select("horizon").distinct()


def list_models(forecasts: DataFrame, champions: Mapping[str, str]) -> DataFrame:
    """Rows, series, first and last origin and target of each model version."""
    champion = F.lit(None).cast("string")
    for m, v in champions.items():
        champion = F.when(F.col("model_id") == m, v).otherwise(champion)
    return forecasts.groupBy("model_id", "model_version").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("series_id").alias("n_series"), F.min("origin").alias("first_origin"), F.max("origin").alias("last_origin"),
        F.min("target").alias("first_target"), F.max("target").alias("last_target"),
    ).withColumn("is_champion", F.coalesce(F.col("model_version") == champion, F.lit(False)))
