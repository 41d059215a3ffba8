"""Behaviour of the archive on a small hand-made set of runs."""

import json
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from leadtime.archive import Archive
from leadtime.errors import IngestConflictError, OfficialConflictError, PartialCommitError, StoreFormatError, SummaryMismatchError, UnknownMetricError, ValidationError
from leadtime.operators import actuals as A
from leadtime.operators.normalize import canonical_forecasts, run_digests
from leadtime.operators.scope import Scope, horizon_of, model_list, series_list

DAY = timedelta(days=1)
START = datetime(2026, 1, 1)


def truth(series, when):
    return 50 + 10 * int(series[1]) + when.day % 7


def forecasts(bias=1.0, origins=4, horizons=(1, 2, 3), series=("S1", "S2")):
    return pd.DataFrame([(s, START + o * DAY, START + (o + h) * DAY, truth(s, START + (o + h) * DAY) + bias * h) for s in series for o in range(origins) for h in horizons], columns=["series_id", "origin", "target", "value"])


def actuals(days=6, series=("S1", "S2"), shift=0.0):
    return pd.DataFrame([(s, START + d * DAY, truth(s, START + d * DAY) + shift) for s in series for d in range(1, days + 1)], columns=["series_id", "target", "value"])


@pytest.fixture
def archive(spark, tmp_path):
    return Archive(spark, tmp_path / "store")


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    a = Archive(spark, tmp_path_factory.mktemp("a") / "store")
    a.ingest(forecasts(1.0), model_id="alpha", model_version="v1")
    a.ingest(forecasts(0.5), model_id="alpha", model_version="v2")
    a.register_actuals(actuals(5), recorded_at="2026-02-01")
    a.set_champion("alpha", "v1")
    return a


def test_ingest_is_idempotent_and_whole(archive):
    first = archive.ingest(forecasts(), model_id="m", model_version="v")
    assert (first.n_rows, first.n_runs_written) == (24, 8)
    again = archive.ingest(forecasts(), model_id="m", model_version="v")
    assert (again.n_rows, again.n_runs_written, again.n_runs_skipped) == (0, 0, 8)
    with pytest.raises(IngestConflictError):  # a run's content is its whole set of targets
        archive.ingest(forecasts(horizons=(1, 2)), model_id="m", model_version="v")
    other = forecasts(bias=9.0, origins=1)
    with pytest.raises(IngestConflictError):
        archive.ingest(pd.concat([other, forecasts(origins=6)[lambda d: d.origin > START + 4 * DAY]]), model_id="m", model_version="v")
    assert archive.list_models().first()["n_rows"] == 24
    changed = archive.ingest(other, model_id="m", model_version="v", on_conflict="overwrite")
    assert changed.n_runs_superseded == 2
    rows = archive.as_of("2026-01-01").toPandas()
    assert len(rows) == 6 and np.isclose(rows.value - [truth(s, t) for s, t in zip(rows.series_id, rows.target)], 9.0 * rows.horizon).all()
    assert archive.list_models().first()["n_rows"] == 24


def test_validation(spark, archive):
    good = forecasts(origins=1)
    for bad in (good.assign(series_id=None), good.assign(series_id=" "), good.assign(series_id="*"), good.assign(value=np.nan), good.assign(value=np.inf), good.assign(value="x"), good.assign(target=20260101), good.iloc[:0], pd.concat([good, good]), good.assign(target=good.target + timedelta(hours=6))):
        with pytest.raises(ValidationError):
            archive.ingest(bad, model_id="m", model_version="v")
    for model in ("", None, 3):
        with pytest.raises(ValidationError):
            archive.ingest(good, model_id=model, model_version="v")
    with pytest.raises(ValidationError):
        archive.ingest(good.drop(columns="value"), model_id="m", model_version="v")
    shifted = good.assign(origin=good.origin + timedelta(hours=6), target=good.target + timedelta(hours=6))
    assert canonical_forecasts(spark.createDataFrame(shifted).select("series_id", *[spark_col(c) for c in ("origin", "target")], "value"), None, model_id="m", model_version="v").agg({"horizon": "max"}).first()[0] == 3
    zoned = good.assign(target=good.target.dt.tz_localize("Asia/Tokyo"), origin=good.origin.dt.tz_localize("Asia/Tokyo"))
    archive.ingest(zoned, model_id="m", model_version="v")
    assert archive.list_models().first()["first_origin"] == START
    for value in (True, 1.5, float("nan"), "7", None):
        with pytest.raises(ValidationError):
            horizon_of(value)
    assert horizon_of(7.0) == 7 and series_list("S2") == ["S2"]
    for call in (lambda: series_list([]), lambda: series_list(["*"]), lambda: model_list([]), lambda: model_list(["ab"]), lambda: Scope.of(period="2026")):
        with pytest.raises(ValidationError):
            call()


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name).cast("timestamp_ntz").alias(name)


def test_accuracy_routes_and_status(filled):
    cell = filled.accuracy_at_horizon(2, model_id="alpha", model_version="v1", series="S2")
    assert (cell.value, cell.n, cell.status, cell.served_from) == (2.0, 4, "ok", "summary")
    listed = filled.accuracy_at_horizon(2, model_id="alpha", model_version="v1", series=["S2"])
    assert (listed.value, listed.served_from) == (2.0, "raw")
    late = filled.accuracy_at_horizon(3, model_id="alpha", model_version="v1")
    assert (late.status, late.n, late.n_missing_actuals) == ("partial", 6, 2)
    assert filled.accuracy_at_horizon(9, model_id="alpha", model_version="v1").status == "insufficient"
    pooled = filled.accuracy_at_horizon(1)
    assert (pooled.value, pooled.n) == (0.75, 16)
    curve = filled.accuracy_curve(horizons=[3, 1, 3], model_id="alpha", model_version="v1")
    assert [p.horizon for p in curve] == [3, 1, 3] and curve.to_frame().shape == (3, 8)
    window = filled.accuracy_at_horizon(1, model_id="alpha", model_version="v1", period=("2026-01-02", None))
    assert (window.n, window.served_from) == (6, "raw")
    assert filled.accuracy_at_horizon(1, period=("2026-01-03", "2026-01-02")).n == 0
    with pytest.raises(UnknownMetricError):
        filled.accuracy_at_horizon(1, "NOPE")
    with pytest.raises(ValidationError):
        filled.accuracy_at_horizon(1, fallback="latest")
    single, twin = (filled.accuracy_at_horizon(1, "MASE", model_id="alpha", model_version=v) for v in ("v1", "v2"))
    assert single.value == 2 * twin.value and filled.accuracy_at_horizon(1, "MASE", model_id="alpha").value == pytest.approx((single.value + twin.value) / 2)


def test_compare_and_drill(filled):
    rows = {r["model_version"]: r for r in filled.compare_models(1, [("alpha", "v2"), ("alpha", "v1")]).collect()}
    assert rows["v2"]["delta_vs_champion"] == -0.5 and rows["v1"]["delta_vs_champion"] == 0.0 and rows["v1"]["is_champion"]
    assert [r["delta_vs_champion"] for r in filled.compare_models(1, [("alpha", "v1")], champion=("alpha", "v2")).collect()] == [0.5]
    assert filled.compare_models(1, [("nobody", "v1")]).columns[0] == "model_id"
    pairs = filled.drill({"model_id": "alpha", "model_version": "v1", "horizon": 3, "series_id": "*"}).toPandas()
    assert len(pairs) == 6 and (pairs.value - pairs.actual_value == 3).all()
    with pytest.raises(ValidationError):
        filled.drill({"model_id": "alpha"})
    assert filled.horizons_in_scope(model_id="alpha") == [1, 2, 3]


def test_every_listed_pair_has_its_row(filled):
    listed = [("alpha", "v2"), ("nobody", "v1"), ("alpha", "v2")]
    rows = filled.compare_curve(listed, horizons=[2, 9]).collect()
    assert [(r["horizon"], r["model_id"], r["model_version"]) for r in rows] == [(h, *m) for h in (2, 9) for m in listed]
    none = [r for r in rows if r["model_id"] == "nobody" or r["horizon"] == 9]
    assert len(none) == 4 and all((r["status"], r["value"], r["n"], r["delta_vs_champion"]) == ("insufficient", None, 0, None) for r in none)
    filled.register_metric("WORST", lambda f, x: np.abs(f - x).max(), summarizable=False)
    worst = filled.compare_models(2, [("alpha", "v2"), ("alpha", "v1")], "WORST").collect()
    assert [(r["value"], r["delta_vs_champion"]) for r in worst] == [(1.0, -1.0), (2.0, 0.0)]
    assert {r["horizon"] for r in filled.compare_curve([("alpha", "v1")]).collect()} == {1, 2, 3}


def test_default_curve_is_served(filled):
    curve = filled.accuracy_curve("RMSE", model_id="alpha", model_version="v1")
    assert [(p.horizon, p.served_from) for p in curve] == [(1, "summary"), (2, "summary"), (3, "summary")] and (curve.metric, curve.basis) == ("RMSE", "latest") and curve.points[0].ok
    mixed = filled.accuracy_curve(horizons=[9, 1], model_id="alpha", model_version="v1")
    assert [(p.horizon, p.served_from, p.ok) for p in mixed] == [(9, "raw", False), (1, "summary", True)]


@pytest.mark.parametrize("column", ["target", "origin"])
def test_numbers_hidden_among_objects_are_no_times(archive, column):
    frame = forecasts(origins=1)
    for values in ([20260102] * len(frame), [20260102.0] + [None] * (len(frame) - 1), [np.int64(20260102)] + ["2026-01-02"] * (len(frame) - 1)):
        with pytest.raises(ValidationError, match="numeric"):
            archive.ingest(frame.assign(**{column: pd.Series(values, dtype=object)}), model_id="m", model_version="v")
    with pytest.raises(ValidationError, match="numeric"):
        archive.register_actuals(actuals(1).rename(columns={"target": "when"}).assign(when=pd.Series([20260102] * 2, dtype=object)), {"target": "when"})


def test_old_generations_go(spark, tmp_path, monkeypatch):
    a = Archive(spark, tmp_path / "s")
    a.ingest(forecasts(origins=1), model_id="m", model_version="v")
    a.register_actuals(actuals())
    named = json.loads((tmp_path / "s" / "summary.json").read_text())["data"]
    assert [p.name for p in (tmp_path / "s" / "summary").iterdir()] == [named]
    monkeypatch.setattr("leadtime.archive.write_json", lambda *_: (_ for _ in ()).throw(OSError("disk full")))
    with pytest.raises(OSError):
        a.rebuild_summary()
    monkeypatch.undo()
    assert [p.name for p in (tmp_path / "s" / "summary").iterdir()] == [named] and a.accuracy_at_horizon(1, model_id="m", model_version="v").served_from == "summary"


def test_broken_side_files_are_typed_errors(spark, tmp_path):
    a = Archive(spark, tmp_path / "s")
    for text in ("{", "[1]", '{"m": 1}'):
        (tmp_path / "s" / "champions.json").write_text(text)
        with pytest.raises(StoreFormatError):
            a.champions()


def test_newest_values_of_many_sources_are_all_seen(spark, tmp_path):
    log = spark.createDataFrame([("S", START, f"s{i:03d}", 1.0 if i < 149 else 2.0, START) for i in range(150)], "series_id string, target timestamp_ntz, source string, actual_value double, actual_recorded_at timestamp_ntz")
    r = A.designated(log, "S", START).first()
    assert (r["low"], r["high"], r["source"]) == (1.0, 2.0, "s000") and A.designated(log, "T", START).first() is None


def test_readers_and_writers_together(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    a = Archive(spark, tmp_path / "s")
    a.ingest(forecasts(origins=1), model_id="m", model_version="v0")

    def write(i):
        return Archive(spark, tmp_path / "s", lock_timeout=120).ingest(forecasts(float(i), origins=1), model_id="m", model_version=f"v{i}").n_runs_written

    def read(_):
        n = a.list_models().agg({"n_rows": "min"}).first()[0]
        return n  # a version is there whole or not at all

    with ThreadPoolExecutor(6) as pool:
        writes, reads = [pool.submit(write, i) for i in range(1, 4)], [pool.submit(read, i) for i in range(12)]
        assert [w.result() for w in writes] == [2, 2, 2] and {r.result() for r in reads} == {6}
    assert a.list_models().count() == 4


def test_log_lines_hold_no_values(spark, tmp_path, caplog):
    with caplog.at_level("DEBUG", logger="leadtime"):
        a = Archive(spark, tmp_path / "s")
        a.ingest(forecasts(origins=1, series=("S7",)), model_id="quiet", model_version="v")
        a.register_actuals(actuals(series=("S7",)))
    assert caplog.records and not any("S7" in r.getMessage() or "quiet" in r.getMessage() or str(tmp_path) in r.getMessage() for r in caplog.records)


def test_revisions_ties_and_officials(spark, tmp_path):
    a = Archive(spark, tmp_path / "s")
    a.ingest(forecasts(origins=1, series=("S1",)), model_id="m", model_version="v")
    one = actuals(3, ("S1",))
    assert a.register_actuals(one, source="a", recorded_at="2026-02-01") == 3
    assert a.register_actuals(one, source="a", recorded_at="2026-02-01") == 0
    with pytest.raises(ValidationError):
        a.register_actuals(one.assign(value=one.value + 5), source="a", recorded_at="2026-02-01")
    a.register_actuals(one.assign(value=one.value + 1), source="a", recorded_at="2026-02-02")
    assert a.accuracy_at_horizon(1).value == 0.0
    a.register_actuals(one.assign(value=one.value + 3), source="b", recorded_at="2026-02-02")
    assert a.accuracy_at_horizon(1).status == "insufficient" and a.accuracy_at_horizon(1).n_missing_actuals == 1
    assert (tmp_path / "s" / "audit.log").read_text().count("ambiguous-latest") == 3
    b = Archive(spark, tmp_path / "s", source_priority=["b", "a"])
    assert b.accuracy_at_horizon(1).value == 2.0
    assert a.accuracy_at_horizon(1, basis="official").n == 0
    a.mark_official(series="S1", target=START + DAY, source="a", recorded_at="2026-02-01")
    filled = a.accuracy_at_horizon(1, basis="official", fallback="latest")
    assert (filled.value, filled.n_fallback) == (1.0, 0)
    with pytest.raises(OfficialConflictError):
        a.register_actuals(one, source="c", recorded_at="2026-02-03", official=True)
    with pytest.raises(ValidationError):
        a.mark_official(series="S1", target=START + DAY)  # the newest recordings differ
    a.reconcile()


def test_custom_metrics(spark, tmp_path):
    a = Archive(spark, tmp_path / "s", metric_budget=0.5)
    a.ingest(forecasts(origins=1), model_id="m", model_version="v")
    a.register_actuals(actuals())
    a.register_metric("WORST", lambda f, x: np.abs(f - x).max())
    assert (a.accuracy_at_horizon(2, "WORST", model_id="m", model_version="v").value) == 2.0
    a.register_metric("NAN", lambda f, x: float("nan"))
    assert a.accuracy_at_horizon(2, "NAN").status == "insufficient" and "NAN" not in a.registry.quarantined

    def hang(f, x):
        import time

        time.sleep(30)

    a.register_metric("HANG", hang, summarizable=False)
    assert a.accuracy_at_horizon(2, "HANG").value is None and "HANG" in a.registry.quarantined
    with pytest.raises(ValidationError):
        a.register_metric("MAE", hang)


def test_tampering_is_found(spark, tmp_path):
    root = tmp_path / "s"
    a = Archive(spark, root)
    a.ingest(forecasts(origins=1), model_id="m", model_version="v")
    a.register_actuals(actuals())
    a.reconcile()
    pointer = json.loads((root / "summary.json").read_text())
    stored = spark.read.parquet(f"file://{root}/summary/{pointer['data']}")
    from pyspark.sql import functions as F

    token, path = a.commits.new("summary")
    stored.withColumn("value", F.col("value") + 1).coalesce(1).write.parquet(f"file://{path}")
    (root / "summary.json").write_text(json.dumps(pointer | {"data": token, "files": a.commits.fingerprint(path)}))
    with pytest.raises(SummaryMismatchError):
        a.reconcile()
    (root / "summary.json").write_text("{")
    assert a.accuracy_at_horizon(1, model_id="m", model_version="v").served_from == "raw"
    commit = sorted((root / "commits").glob("*.json"))[0]
    text = commit.read_text()
    commit.write_text(text.replace('"version": 1', '"version":  1'))
    with pytest.raises(StoreFormatError):
        Archive(spark, root)
    commit.write_text(text)
    part = next((root / "segments" / "forecasts").glob("*/part-*"))
    part.unlink()
    with pytest.raises(StoreFormatError):
        a.accuracy_at_horizon(1)


def test_foreign_folder_and_format(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "mine.txt").write_text("keep")
    with pytest.raises(StoreFormatError):
        Archive(spark, tmp_path / "x")
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["mine.txt"]
    Archive(spark, tmp_path / "y")
    (tmp_path / "y" / "store.json").write_text('{"format": 2}')
    with pytest.raises(StoreFormatError):
        Archive(spark, tmp_path / "y")


def test_crashes_around_the_commit(spark, tmp_path, monkeypatch):
    a, b = Archive(spark, tmp_path / "s"), Archive(spark, tmp_path / "s")
    monkeypatch.setattr(a.commits, "append", lambda *_: (_ for _ in ()).throw(OSError("disk full")))
    with pytest.raises(OSError):
        a.ingest(forecasts(origins=1), model_id="m", model_version="v")
    monkeypatch.undo()
    assert b.list_models().count() == 0
    monkeypatch.setattr(a.commits, "publish_head", lambda *_: (_ for _ in ()).throw(OSError("disk full")))
    with pytest.raises(PartialCommitError):
        a.ingest(forecasts(origins=1), model_id="m", model_version="v")
    monkeypatch.undo()
    assert b.list_models().first()["n_rows"] == 6
    assert b.ingest(forecasts(2.0, origins=1), model_id="m", model_version="w").n_runs_written == 2
    assert a.list_models().count() == 2


def test_adapter_and_stream(spark, tmp_path):
    a = Archive(spark, tmp_path / "s")
    cv = forecasts(origins=1).rename(columns={"series_id": "unique_id", "target": "ds", "origin": "cutoff", "value": "m"})
    assert a.ingest_cross_validation(cv, model_id="m", model_version="v").n_runs_written == 2
    with pytest.raises(ValidationError):
        a.ingest_cross_validation(cv.drop(columns="m"), model_id="m", model_version="v")
    from leadtime.operators.normalize import as_frame
    from leadtime.streaming.ingest import start_ingest

    as_frame(spark, forecasts(origins=2)).write.parquet(f"file://{tmp_path}/in")
    for _ in range(2):  # the second run of the stream replays nothing
        stream = spark.readStream.schema(spark.read.parquet(f"file://{tmp_path}/in").schema).parquet(f"file://{tmp_path}/in")
        start_ingest(stream, a, f"file://{tmp_path}/cp", model_id="s", model_version="v", once=True).awaitTermination()
    assert {r["model_id"]: r["n_rows"] for r in a.list_models().collect()} == {"m": 6, "s": 12}


def test_run_digest_is_pinned(spark):
    rows = spark.createDataFrame([("m", "v", "S", START, START + DAY, -0.0), ("m", "v", "S", START, START + 2 * DAY, 1e16)], "model_id string, model_version string, series_id string, origin timestamp_ntz, target timestamp_ntz, value double")
    assert run_digests(rows).first()["digest"] == run_digests(rows.orderBy("value").replace(-0.0, 0.0)).first()["digest"]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 2), st.sampled_from("xy"), st.integers(0, 3), st.integers(0, 2)), min_size=1, max_size=25, unique_by=lambda r: r[:4]))
def test_latest_equals_brute_force(spark, rows):
    log = spark.createDataFrame([(s, START + t * DAY, o, float(v), START + r * DAY) for s, t, o, r, v in rows], "series_id string, target timestamp_ntz, source string, actual_value double, actual_recorded_at timestamp_ntz")
    want = {}
    for key in {(s, t) for s, t, *_ in rows}:
        own = [r for r in rows if r[:2] == key]
        top = [r for r in own if r[3] == max(x[3] for x in own)]
        if len({r[4] for r in top}) == 1:
            want[key] = float(top[0][4])
        elif {r[2] for r in top} <= {"y"}:
            want[key] = float(top[0][4])
    got = {(r["series_id"], (r["target"] - START).days): r["actual_value"] for r in A.effective_latest(log, ["y"]).collect()}
    assert got == want
