"""Which value counts for each (series, target): revisions, ties, official designations, fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError

KEY = ["series_id", "target"]
IDENTITY = ["series_id", "target", "source", "actual_recorded_at"]


def newest(log: DataFrame) -> DataFrame:
    """Of each (series, target) all rows of the latest recording."""
    latest = F.max("actual_recorded_at").over(Window.partitionBy(*KEY))
    return log.withColumn("__latest", latest).filter(F.col("actual_recorded_at") == F.col("__latest")).drop("__latest")


def resolved(log: DataFrame, priority: Sequence[str] = ()) -> DataFrame:
    """One row per (series, target): actual_value, or null where the latest recording is ambiguous.

    Equal values are one. Differing values go by ``priority`` if every source of the recording is in it and gave one value;
    priority never outranks a later recording. Window and aggregate share one shuffle.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in priority]), F.col("source")) if priority else F.lit(0)
    one = newest(log).withColumn("__rank", rank).groupBy(*KEY).agg(
        F.min("actual_value").alias("low"), F.max("actual_value").alias("high"), F.count(F.lit(1)).alias("k"), F.count_distinct("source").alias("sources"),
        F.min("__rank").alias("least"), F.min_by("actual_value", "__rank").alias("preferred"), F.first("actual_recorded_at").alias("recorded_at"),
    )
    by_priority = (F.col("sources") == F.col("k")) & (F.col("least") > 0)
    return one.select(*KEY, "recorded_at", F.when(F.col("low") == F.col("high"), F.col("low")).when(by_priority, F.col("preferred")).alias("actual_value"))


def effective_latest(log: DataFrame, priority: Sequence[str] = ()) -> DataFrame:
    """(series_id, target, actual_value) of every unambiguous target."""
    return resolved(log, priority).filter("actual_value is not null").select(*KEY, "actual_value")


def conflicts(log: DataFrame, priority: Sequence[str] = ()) -> DataFrame:
    """Ambiguous targets: series_id, target, recorded_at, sources, values (sorted by source)."""
    odd = resolved(log, priority).filter("actual_value is null").select(*KEY, "recorded_at")
    rows = newest(log).join(odd, KEY)
    held = rows.groupBy(*KEY, "recorded_at").agg(F.array_sort(F.collect_list(F.struct("source", "actual_value"))).alias("h"))
    return held.select(*KEY, "recorded_at", F.col("h.source").alias("sources"), F.col("h.actual_value").alias("values"))


def current_designations(officials: DataFrame) -> DataFrame:
    """The newest designation of each (series, target); equal times go by commit_seq, if there is one."""
    order = [F.col("designated_at").desc()] + ([F.col("commit_seq").desc()] if "commit_seq" in officials.columns else [])
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))
    return officials.withColumn("__n", place).filter("__n = 1").drop("__n")


def effective_official(log: DataFrame, officials: DataFrame) -> DataFrame:
    """Values of the designated recordings; a designation that meets several values gives none."""
    rows = current_designations(officials).select(*IDENTITY).join(log.select(*IDENTITY, "actual_value"), IDENTITY)
    return rows.groupBy(*KEY).agg(F.min("actual_value").alias("actual_value"), F.max("actual_value").alias("high")).filter("actual_value = high").select(*KEY, "actual_value")


def effective(log: DataFrame, officials: DataFrame | None, basis: str = "latest", fallback: str | None = None, priority: Sequence[str] = ()) -> DataFrame:
    """(series_id, target, actual_value, is_fallback) on a basis; fallback fills what the official basis lacks from the latest one."""
    if basis not in ("latest", "official") or fallback not in (None, "latest") or (fallback and basis != "official"):
        raise ValidationError(f"basis {basis!r} with fallback {fallback!r}")
    if basis == "latest":
        return effective_latest(log, priority).withColumn("is_fallback", F.lit(False))
    own = effective_official(log, officials).withColumn("is_fallback", F.lit(False))
    if not fallback:
        return own
    rest = effective_latest(log, priority).join(own.select(*KEY), KEY, "left_anti").withColumn("is_fallback", F.lit(True))
    return own.unionByName(rest)


def against_log(batch: DataFrame, log: DataFrame) -> DataFrame:
    """``batch`` with status new, seen or conflict by the log's row of the same identity; only the batch's targets are grouped."""
    known = log.join(batch.select(*KEY).distinct(), KEY, "left_semi").groupBy(*IDENTITY).agg(F.max("actual_value").alias("__known"))
    status = F.when(F.col("__known").isNull(), "new").when(F.col("__known") == F.col("actual_value"), "seen").otherwise("conflict")
    return batch.join(known, IDENTITY, "left").withColumn("status", status).drop("__known")


def against_officials(batch: DataFrame, officials: DataFrame) -> DataFrame:
    """``batch`` with status new, same or conflict by the current designation of its target."""
    known = current_designations(officials).select(*KEY, F.col("source").alias("__s"), F.col("actual_recorded_at").alias("__r"))
    same = (F.col("__s") == F.col("source")) & (F.col("__r") == F.col("actual_recorded_at"))
    status = F.when(F.col("__s").isNull(), "new").when(same, "same").otherwise("conflict")
    return batch.join(known, KEY, "left").withColumn("status", status).drop("__s", "__r")


def locate(log: DataFrame, series: str, target, source: str | None = None, recorded_at=None) -> DataFrame:
    """The newest rows that match, at most one of each source and value."""
    rows = log.filter((F.col("series_id") == series) & (F.col("target") == F.lit(target).cast("timestamp_ntz")))
    if source is not None:
        rows = rows.filter(F.col("source") == source)
    if recorded_at is not None:
        rows = rows.filter(F.col("actual_recorded_at") == F.lit(recorded_at).cast("timestamp_ntz"))
    return newest(rows).dropDuplicates(["source", "actual_value"])


def designated(log: DataFrame, series: str, target, source: str | None = None, recorded_at=None) -> DataFrame:
    """At most one row of what ``locate`` finds: low and high of its values, the first source and the recording's time."""
    rows = locate(log, series, target, source, recorded_at)
    found = rows.agg(F.count(F.lit(1)).alias("k"), F.min("actual_value").alias("low"), F.max("actual_value").alias("high"), F.min("source").alias("source"), F.max("actual_recorded_at").alias("actual_recorded_at"))
    return found.filter("k > 0").drop("k")
