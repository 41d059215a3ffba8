"""The archive: append runs and actuals, ask for accuracy."""

from __future__ import annotations

import hashlib
import json
import logging
import os
import shutil
import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import replace
from datetime import datetime
from functools import reduce
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as T
from .errors import (
    AuditLogError,
    IngestConflictError,
    OfficialConflictError,
    ReconcileUnsettledError,
    StoreFormatError,
    SummaryMismatchError,
    ValidationError,
)
from .functions.metrics import BUILT_IN, Registry, custom
from .operators import actuals as A
from .operators import evaluate as E
from .operators import normalize as N
from .operators import summary as S
from .operators.scope import Scope, horizon_list, horizon_of, model_list
from .results import AccuracyCurve, AccuracyResult, IngestResult
from .sources.frames import cross_validation_mapping
from .store.commitlog import CommitLog, Snapshot
from .store.lock import store_lock, write_json

log = logging.getLogger("leadtime")
RUNS = "model_id string, model_version string, origin timestamp_ntz, series_id string, run_id string, digest string, n_rows long"


class Archive:
    """A store under ``root``, a folder that driver and executors share; any number of handles may be open.

    ``source_priority`` settles ties between sources that recorded different values at the same time.
    """

    def __init__(self, spark: SparkSession, root: str | os.PathLike, source_priority: Iterable[str] = (), metric_budget: float = 10.0, lock_timeout: float = 30.0) -> None:
        self.spark, self.root = spark, Path(root).resolve()
        self.priority = tuple(N.source_label(s) for s in source_priority)
        self.registry = Registry(metric_budget)
        self.lock_timeout = lock_timeout
        self.commits = CommitLog(self.root)
        self.commits.digests = self._digests
        self._verified: set[str] = set()
        self._held: list[DataFrame] = []
        if not self.root.exists():
            self.root.mkdir(parents=True)
        elif not (self.root / "store.json").exists() and any(p.name != ".lock" for p in self.root.iterdir()):
            raise StoreFormatError(f"{self.root} is neither empty nor a store")
        with self._lock():
            self.commits.open()

    # -- plumbing

    def _lock(self):
        return store_lock(self.root, self.lock_timeout)

    def _scan(self, snapshot: Snapshot, kind: str, schema) -> DataFrame:
        """All rows of a kind; only parts that commits name are read."""
        found = snapshot.of(kind)
        if not found:
            return self.spark.createDataFrame([], schema)
        paths = [f"file://{self.commits.path(kind, s.token)}" for s in found]
        return self.spark.read.schema(schema).parquet(*paths)

    def _digests(self, path: Path) -> dict[str, str]:
        """Digests of the parts of a folder by name, hashed on the executors."""
        rows = self.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"file://{path}").select("path", F.sha2("content", 256).alias("sha"))
        return {r["path"].rsplit("/", 1)[1]: r["sha"] for r in rows.collect()}

    def _runs(self, snapshot: Snapshot) -> DataFrame:
        runs = self._scan(snapshot, "runs", RUNS)
        return runs.join(self._scan(snapshot, "superseded", "run_id string"), "run_id", "left_anti") if snapshot.of("superseded") else runs

    def _forecasts(self, snapshot: Snapshot) -> DataFrame:
        """Rows of live runs; without superseded runs every row of a committed segment is live."""
        rows = self._scan(snapshot, "forecasts", T.FORECASTS)
        return rows.join(self._scan(snapshot, "superseded", "run_id string"), "run_id", "left_anti") if snapshot.of("superseded") else rows

    def _actuals(self, snapshot: Snapshot) -> DataFrame:
        return self._scan(snapshot, "actuals", T.ACTUALS)

    def _officials(self, snapshot: Snapshot) -> DataFrame:
        return self._scan(snapshot, "officials", T.DESIGNATIONS)

    def _write(self, kind: str, rows: DataFrame, order: tuple[str, ...] = ()) -> tuple[str, str]:
        """A segment that nothing sees before its commit; sorted parts let later scans skip row groups."""
        token, path = self.commits.new(kind)
        (rows.sortWithinPartitions(*order) if order else rows).write.parquet(f"file://{path}")
        return kind, token

    def _effective(self, snapshot: Snapshot, basis: str, fallback: str | None) -> DataFrame:
        return A.effective(self._actuals(snapshot), self._officials(snapshot), basis, fallback, self.priority)

    # -- writing

    def ingest(self, frame, mapping: Mapping[str, str] | None = None, *, model_id: str, model_version: str, origin=None, on_conflict: str = "error") -> IngestResult:
        """Append the runs of a frame, all or none.

        A run is one series at one origin. Runs stored with equal values are skipped; with other values they are an
        IngestConflictError, or with on_conflict='overwrite' replace the stored ones, and only those.
        """
        if on_conflict not in ("error", "overwrite"):
            raise ValidationError(f"on_conflict {on_conflict!r}")
        rows = N.canonical_forecasts(N.as_frame(self.spark, frame, N.time_columns(mapping)), mapping, model_id=model_id, model_version=model_version, origin=origin)
        keys = ["model_id", "model_version", "origin", "series_id"]
        with self._lock():
            base = self.commits.snapshot()
            active = self._runs(base)
            plan = N.plan_runs(N.run_digests(rows), active.select(*keys, "digest")).cache()
            try:
                counts = {r["status"]: (r["runs"], r["n"]) for r in plan.groupBy("status").agg(F.count(F.lit(1)).alias("runs"), F.sum("n_rows").alias("n")).collect()}
                changed = counts.get("changed", (0, 0))[0]
                if changed and on_conflict == "error":
                    raise IngestConflictError(f"{changed} runs are stored with other values")
                skipped = counts.get("same", (0, 0))[0]
                written = sum(counts.get(s, (0, 0))[0] for s in ("new", "changed"))
                if written:
                    now = datetime.now()
                    salt = F.lit(f"{base.version}|{now.isoformat()}")
                    run_id = F.sha2(F.concat_ws("|", *keys[:2], F.col("origin").cast("string"), "series_id", "digest", salt), 256)
                    fresh = plan.filter("status <> 'same'").select(*keys, run_id.alias("run_id"), "digest", "n_rows")
                    kept = rows.join(fresh.select(*keys, "run_id"), keys).withColumn("ingested_at", F.lit(now).cast("timestamp_ntz")).select(*T.FORECASTS.fieldNames())
                    segments = [self._write("forecasts", kept, ("model_id", "model_version", "horizon", "series_id", "target")), self._write("runs", fresh)]
                    if changed:
                        gone = active.join(plan.filter("status = 'changed'").select(*keys), keys, "left_semi").select("run_id")
                        segments.append(self._write("superseded", gone))
                    self.commits.append(base, segments)
            finally:
                plan.unpersist()
        n = sum(counts.get(s, (0, 0))[1] or 0 for s in ("new", "changed"))
        log.info("ingested %d rows in %d runs", n, written)
        self._refresh()
        return IngestResult(n, written, skipped, changed)

    def ingest_cross_validation(self, frame, *, model_id: str, model_version: str, value_column: str | None = None, on_conflict: str = "error") -> IngestResult:
        """``ingest`` of a frame with unique_id, ds, cutoff and a column of forecasts."""
        frame = N.as_frame(self.spark, frame, ("ds", "cutoff"))
        return self.ingest(frame, cross_validation_mapping(frame, model_id, value_column), model_id=model_id, model_version=model_version, on_conflict=on_conflict)

    def register_actuals(self, frame, mapping: Mapping[str, str] | None = None, *, source: str | None = None, official: bool = False, recorded_at=None) -> int:
        """Append observed values; returns how many were new.

        What the log has already is skipped, under the same identity with another value it is an error. ``official`` also
        designates the values, unless a target has another official value already, which is an OfficialConflictError.
        """
        batch = N.canonical_actuals(N.as_frame(self.spark, frame, N.time_columns(mapping)), mapping, source=source, recorded_at=recorded_at, official=official)
        with self._lock():
            base = self.commits.snapshot()
            old = self._actuals(base)
            judged = A.against_log(batch, old).cache()
            try:
                counts = {r["status"]: r["count"] for r in judged.groupBy("status").count().collect()}
                if counts.get("conflict"):
                    raise ValidationError(f"{counts['conflict']} rows are in the log with other values")
                fresh = judged.filter("status = 'new'").select(*T.ACTUALS.fieldNames())
                segments, named = [], None
                if official:
                    named = A.against_officials(batch.select(*A.IDENTITY), self._officials(base)).cache()
                    odd = named.filter("status = 'conflict'").count()
                    if odd:
                        raise OfficialConflictError(f"{odd} targets have another official value")
                touched = old.unionByName(fresh).join(batch.select(*A.KEY).distinct(), A.KEY, "left_semi")
                pending = self._pending_audit(A.conflicts(touched, self.priority))
                if pending:
                    self._audit_writable()
                if counts.get("new"):
                    segments.append(self._write("actuals", fresh))
                if named is not None and not named.filter("status = 'new'").isEmpty():
                    rows = named.filter("status = 'new'").select(*A.IDENTITY).withColumns({"designated_at": F.lit(datetime.now()).cast("timestamp_ntz"), "commit_seq": F.lit(base.version + 1).cast("long")})
                    segments.append(self._write("officials", rows))
                if segments:
                    self.commits.append(base, segments)
                if pending:
                    self._audit(pending)
            finally:
                judged.unpersist()
        self._refresh()
        return counts.get("new", 0)

    def mark_official(self, *, series: str, target, source: str | None = None, recorded_at=None) -> None:
        """Designate the newest matching recording of a target; always appends."""
        when = N.wall_time(target, "target")
        known = None if recorded_at is None else N.wall_time(recorded_at, "recorded_at")
        with self._lock():
            base = self.commits.snapshot()
            r = A.designated(self._actuals(base), series, when, source, known).first()
            if r is None:
                raise ValidationError("no such actual")
            if r["low"] != r["high"]:
                raise ValidationError("the newest recordings differ; name the source")
            one = self.spark.createDataFrame([(series, when, r["source"], r["actual_recorded_at"], datetime.now(), base.version + 1)], T.DESIGNATIONS)
            self.commits.append(base, [self._write("officials", one)])
        self._refresh()

    def _pending_audit(self, found: DataFrame) -> list[str]:
        """Audit lines of ambiguous targets that are not written yet."""
        try:
            seen = set(json.loads(p.read_text())) if (p := self.root / "audit-seen.json").exists() else set()
        except (OSError, ValueError, TypeError) as e:
            raise AuditLogError("audit-seen.json cannot be read") from e
        lines = (f"ambiguous-latest series={r['series_id']} target={r['target'].isoformat()} recorded_at={r['recorded_at'].isoformat()} sources={list(r['sources'])} values={list(r['values'])}" for r in found.toLocalIterator())
        return sorted(x for x in lines if x not in seen)

    def _audit_writable(self) -> None:
        with open(self.root / "audit.log", "a"):
            pass

    def _audit(self, lines: list[str]) -> None:
        try:
            with open(self.root / "audit.log", "a") as f:
                f.write("".join(x + "\n" for x in lines))
            path = self.root / "audit-seen.json"
            seen = json.loads(path.read_text()) if path.exists() else []
            write_json(path, json.dumps([*seen, *lines]))
        except OSError as e:
            raise AuditLogError("the actuals are stored, their audit lines are not") from e

    # -- champions and metrics

    def champions(self) -> dict[str, str]:
        path = self.root / "champions.json"
        try:
            held = json.loads(path.read_text()) if path.exists() else {}
        except (OSError, ValueError) as e:
            raise StoreFormatError("champions.json cannot be read") from e
        if not isinstance(held, dict) or not all(isinstance(v, str) for v in held.values()):
            raise StoreFormatError("champions.json holds no versions by model")
        return held

    def set_champion(self, model_id: str, model_version: str) -> None:
        """The version that others of the model are compared with; the last call wins."""
        N.identity(model_id, "model_id")
        N.identity(model_version, "model_version")
        with self._lock():
            write_json(self.root / "champions.json", json.dumps(self.champions() | {model_id: model_version}))

    def register_metric(self, name: str, fn: Callable, summarizable: bool = True) -> None:
        """Add a function of (forecasts, actuals); summarizable ones enter the summary."""
        self.registry.register(name, fn, summarizable)
        self._refresh()

    # -- summary

    def _token(self, snapshot: Snapshot) -> str:
        return hashlib.sha256(json.dumps([snapshot.head, self.registry.token(), list(self.priority)]).encode()).hexdigest()

    def _release(self) -> None:
        while self._held:
            self._held.pop().unpersist()

    def _fresh_summary(self, snapshot: Snapshot) -> DataFrame:
        self._release()
        forecasts, parts = self._forecasts(snapshot), []
        for basis in ("latest", "official"):
            if basis == "official" and not snapshot.of("officials") or not snapshot.of("actuals"):
                continue
            actuals = self._effective(snapshot, basis, None)
            parts.append(S.cube(forecasts, actuals, basis))
            for name in self.registry.names(summarizable=True):
                if name in BUILT_IN or name in self.registry.quarantined:
                    continue
                matched = E.align(forecasts, actuals).filter("actual_value is not null")
                totals = E.align(forecasts, actuals)
                for keys in (S.CELL, [k for k in S.CELL if k != "series_id"]):
                    cells = self._custom(matched, keys, name).filter("value is not null").drop("status")
                    cells = cells.join(totals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_forecasts")), keys)
                    if "series_id" not in keys:
                        cells = cells.withColumn("series_id", F.lit(T.POOLED))
                    parts.append(cells.withColumns({"metric": F.lit(name), "period": F.lit(T.WHOLE_PERIOD), "actual_basis": F.lit(basis)}).select(*T.SUMMARY.fieldNames()))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], T.SUMMARY)

    def _custom(self, matched: DataFrame, keys, name: str) -> DataFrame:
        """Evaluate once, keep until the next summary or question with a custom metric, and set the metric aside if it hung anywhere."""
        cells = custom(matched, keys, self.registry.get(name), self.registry.budget).cache()
        self._held.append(cells)
        if not cells.filter("status = 'timeout'").isEmpty():
            self.registry.quarantined.add(name)
        return cells

    def rebuild_summary(self, tries: int = 3) -> bool:
        """Recompute the summary, in order of its keys, and publish it if the store has not moved on meanwhile; what is not published goes again."""
        for _ in range(tries):
            snapshot = self.commits.snapshot()
            token, path = self.commits.new("summary")
            published = False
            try:
                self._fresh_summary(snapshot).repartitionByRange(8, *S.ORDER).sortWithinPartitions(*S.ORDER).write.parquet(f"file://{path}")
                with self._lock():
                    if self.commits.snapshot(probe=False).head == snapshot.head and self.commits.complete(path):  # else another writer published this state
                        pointer = {"state": self._token(snapshot), "data": token, "files": self.commits.fingerprint(path)}
                        write_json(self.root / "summary.json", json.dumps(pointer))
                        published = True
                        self._sweep(token)
                        return True
            finally:
                self._release()
                if not published and self._published() != token:
                    shutil.rmtree(path, ignore_errors=True)
        return False

    def _published(self) -> str | None:
        """The generation that the pointer names."""
        try:
            return json.loads((self.root / "summary.json").read_text())["data"]
        except (OSError, ValueError, KeyError, TypeError):
            return None

    def _sweep(self, token: str) -> None:
        """Remove other generations: the one published before, and what crashed writers left a day ago. A reader that loses its generation reads raw rows."""
        for path in self.commits.path("summary", token).parent.iterdir():
            try:
                if path.name != token and (self.commits.complete(path) or time.time() - path.stat().st_mtime > 86_400):
                    shutil.rmtree(path, ignore_errors=True)
            except OSError:  # another writer was faster
                continue

    def _stored_summary(self, snapshot: Snapshot) -> DataFrame | None:
        """The published summary if it is of this state and its parts are whole, else None. A handle hashes the parts of a generation once, as long as their sizes and times stay."""
        try:
            held = json.loads((self.root / "summary.json").read_text())
            path = self.commits.path("summary", held["data"])
            stats = self.commits.stats(path)
            if held["state"] != self._token(snapshot) or stats.keys() != held["files"].keys():
                return None
            key = json.dumps([held["data"], held["files"], stats], sort_keys=True)
            if key not in self._verified:
                found = self.commits.fingerprint(path)
                if any(found[n][::2] != f[::2] for n, f in held["files"].items()):
                    return None
                self._verified = {key}
            return self.spark.read.schema(T.SUMMARY).parquet(f"file://{path}")
        except (OSError, ValueError, KeyError, TypeError, StoreFormatError):
            return None

    def _refresh(self) -> None:
        """After a write; a failure here never fails the write."""
        try:
            if self._stored_summary(self.commits.snapshot()) is None:
                self.rebuild_summary()
        except Exception:  # noqa: BLE001
            log.warning("the summary was not refreshed")

    def reconcile(self, tries: int = 5) -> None:
        """Check every byte, then the stored summary against its recomputation (to 1e-9); rebuild it where absent or stale."""
        for _ in range(tries):
            snapshot = self.commits.snapshot()
            self.commits.probe(snapshot, deep=True)
            stored = self._stored_summary(snapshot)
            if stored is not None:
                odd = S.differences(stored, self._fresh_summary(snapshot)).count()
                if self.commits.snapshot(probe=False).head != snapshot.head:
                    continue
                if odd:
                    raise SummaryMismatchError(f"{odd} cells of the summary differ from the raw rows")
                return
            if self.rebuild_summary(1):
                return
        raise ReconcileUnsettledError("the store kept changing")

    # -- questions

    def _cells(self, snapshot: Snapshot, metric: str, basis: str, fallback: str | None, scope: Scope, keys: tuple[str, ...]) -> DataFrame:
        actuals = self._effective(snapshot, basis, fallback)
        if metric in BUILT_IN:
            return E.curve(self._forecasts(snapshot), actuals, metric, basis, scope, keys)
        self.registry.get(metric)
        self._release()
        pairs = E.align(scope.apply(self._forecasts(snapshot)), actuals)
        counts = E.accuracy(pairs, keys, [])
        if metric in self.registry.quarantined:
            cells = counts.withColumn("value", F.lit(None).cast("double"))
        else:
            values = self._custom(pairs.filter("actual_value is not null"), keys, metric).select(*keys, "value")
            cells = counts.join(values, list(keys), "left")
        status = E.status_of(F.col("n"), F.col("n_missing_actuals"), F.col("value"))
        return cells.select(*keys, F.lit(metric).alias("metric"), F.lit(basis).alias("basis"), status.alias("status"), "value", "n", "n_missing_actuals", "n_fallback")

    def accuracy_curve(self, metric: str = "MAE", basis: str = "latest", fallback: str | None = None, *, horizons=None, model_id=None, model_version=None, series=None, period=None) -> AccuracyCurve:
        """A point per horizon, of those asked for in their order or else all in scope. One job, whatever their number."""
        wanted = None if horizons is None else horizon_list(horizons)
        self.registry.get(metric)
        scope = Scope.of(model_id, model_version, series=series, horizons=wanted, period=period)
        snapshot = self.commits.snapshot()
        served = self._served(snapshot, metric, basis, fallback, model_id, model_version, series, period)
        order = wanted
        if order is None and served:
            order = sorted(r["horizon"] for r in E.horizons(self._forecasts(snapshot), scope).collect())
        left = None if order is None else [h for h in dict.fromkeys(order) if h not in served]
        if left is None or left:
            rest = replace(scope, horizons=scope.horizons if left is None else tuple(left))
            for r in self._cells(snapshot, metric, basis, fallback, rest, ("horizon",)).collect():
                served.setdefault(r["horizon"], AccuracyResult(r["horizon"], metric, basis, r["status"], r["value"], r["n"], r["n_missing_actuals"], r["n_fallback"], "raw"))
        order = sorted(served) if order is None else order
        none = lambda h: AccuracyResult(h, metric, basis, "insufficient", None, 0, 0, 0, "raw")
        return AccuracyCurve(tuple(served.get(h) or none(h) for h in order), metric, basis)

    def _served(self, snapshot: Snapshot, metric: str, basis: str, fallback: str | None, model_id, model_version, series, period) -> dict[int, AccuracyResult]:
        """Points by horizon that the summary holds: of one model version, one series or all, the whole period, without fallback."""
        if model_id is None or model_version is None or fallback is not None or period is not None or not (series is None or isinstance(series, str)):
            return {}
        stored, served = self._stored_summary(snapshot), {}
        if stored is None:
            return {}
        cell = {"model_id": model_id, "model_version": model_version, "metric": metric, "actual_basis": basis, "period": T.WHOLE_PERIOD, "series_id": series or T.POOLED}
        rows = stored.filter(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in cell.items()]))
        try:
            found = rows.collect()
        except PySparkException:  # swept meanwhile
            return {}
        for r in found:
            missing = r["n_forecasts"] - r["n"]
            served[r["horizon"]] = AccuracyResult(r["horizon"], metric, basis, "partial" if missing else "ok", r["value"], r["n"], missing, 0, "summary")
        return served

    def accuracy_at_horizon(self, horizon, metric: str = "MAE", basis: str = "latest", fallback: str | None = None, **scope) -> AccuracyResult:
        """One point of the curve."""
        return self.accuracy_curve(metric, basis, fallback, horizons=[horizon_of(horizon)], **scope).points[0]

    def compare_curve(self, models, metric: str = "MAE", basis: str = "latest", fallback: str | None = None, *, horizons=None, champion=None, series=None, period=None) -> DataFrame:
        """A row for each listed model at each horizon, in their order, with the difference to its champion; any registered metric."""
        pairs = model_list(models)
        wanted = None if horizons is None else horizon_list(horizons)
        best = self._champions(champion)
        scope = Scope.of(models=E.wanted_models(pairs, best), series=series, horizons=wanted, period=period)
        cells = self._cells(self.commits.snapshot(), metric, basis, fallback, scope, ("model_id", "model_version", "horizon"))
        return E.compared(cells, pairs, best, metric, basis, wanted).orderBy("position", "place").drop("position", "place")

    def compare_models(self, horizon, models, metric: str = "MAE", basis: str = "latest", fallback: str | None = None, *, champion=None, series=None, period=None) -> DataFrame:
        """``compare_curve`` at one horizon."""
        return self.compare_curve(models, metric, basis, fallback, horizons=[horizon_of(horizon)], champion=champion, series=series, period=period)

    def _champions(self, override) -> dict[str, str]:
        if override is None:
            return self.champions()
        if isinstance(override, Mapping):
            return self.champions() | {str(k): str(v) for k, v in override.items()}
        if isinstance(override, tuple) and len(override) == 2:
            return self.champions() | {str(override[0]): str(override[1])}
        raise ValidationError("a champion is a pair or a mapping")

    def as_of(self, origin, model_id=None, model_version=None, series=None) -> DataFrame:
        """Forecasts made up to ``origin``, as now stored."""
        rows = E.as_of(self._forecasts(self.commits.snapshot()), origin, model_id=model_id, model_version=model_version, series=series)
        return rows.orderBy("model_id", "model_version", "series_id", "origin", "target")

    def drill(self, cell: Mapping) -> DataFrame:
        """The matched pairs behind a cell (model_id, model_version, horizon and optionally series_id, basis, fallback, period_range)."""
        missing = {"model_id", "model_version", "horizon"} - set(cell)
        if missing:
            raise ValidationError(f"a cell needs {sorted(missing)}")
        series = cell.get("series_id")
        scope = Scope.of(cell["model_id"], cell["model_version"], series=None if series in (None, T.POOLED) else series, horizons=[horizon_of(cell["horizon"])], period=cell.get("period_range"))
        snapshot = self.commits.snapshot()
        actuals = self._effective(snapshot, cell.get("basis", cell.get("actual_basis", "latest")), cell.get("fallback"))
        return E.drill(self._forecasts(snapshot), actuals, scope).orderBy("series_id", "target", "origin")

    def list_models(self) -> DataFrame:
        return E.list_models(self._forecasts(self.commits.snapshot()), self.champions()).orderBy("model_id", "model_version")

    def horizons_in_scope(self, model_id=None, model_version=None, series=None, period=None) -> list[int]:
        rows = E.horizons(self._forecasts(self.commits.snapshot()), Scope.of(model_id, model_version, series=series, period=period))
        return sorted(r["horizon"] for r in rows.collect())
