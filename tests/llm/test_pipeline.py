"""The pipeline on the smallest dataset: each stage against a plain version of its decision."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from leadtime.llm import common, mixing, quality, queries

from ..conftest import SF
from .test_operators import linked


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        docs = corpus_pipeline.materialize(out, name)
        kept[name] = common.in_row_order(docs).orderBy("place").drop("place").collect() if name == "mixing" else docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns
    first = {r["doc_id"] for r in kept["quality_classifier"]}
    source = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(source, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = quality.Scorer(model)
    assert first == {d for d, r in before.items() if scorer.score((r["text"] or "").encode()) >= 0.3}
    ids = sorted(first)
    roots = linked([before[d]["text"] for d in ids], ids)
    assert {r["doc_id"] for r in kept["ngram_jaccard_join"]} == {c for _, _, c in roots}
    scanned = {r["doc_id"]: r for r in kept["secret_scans"]}
    assert set(scanned) == {r["doc_id"] for r in kept["ngram_jaccard_join"]}
    assert all(r["text"] == before[d]["text"] or "[SECRET]" in r["text"] for d, r in scanned.items())
    mixed = [r["doc_id"] for r in kept["mixing"]]
    places = {r["doc_id"]: r["place"] for r in mixing.mixed(corpus_pipeline.materialize(spark.createDataFrame(kept["secret_scans"], source.schema), "again"), queries.TARGET_WEIGHTS, keys=("doc_id", "text")).collect()}
    assert mixed == sorted(scanned, key=places.get)
    packed = collections.Counter(r["sequence_id"] for r in kept["best_fit_packing"] for _ in range(r["length"]))
    assert {r["doc_id"] for r in kept["best_fit_packing"]} == set(scanned) and max(packed.values()) <= 2048
    assert len(packed) <= -(-sum(packed.values()) // 2048) * 11 / 9 + 1


def test_weights_reach_the_sequences(spark, monkeypatch):
    """run() of the last two stages: other weights give other rows, and sequences follow the mixture."""
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    source = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {}
    for name, weights in (("own", queries.TARGET_WEIGHTS), ("other", {"src9": 9, "src8": 5})):
        monkeypatch.setattr(corpus_pipeline, "TARGET_WEIGHTS", weights)
        rows[name] = corpus_pipeline.run(spark, SF).collect()
        place = {r["doc_id"]: r["place"] for r in mixing.mixed(source, weights, keys=("doc_id", "text")).collect()}
        opens = sorted((r["sequence_id"], place[r["doc_id"]], r["piece"]) for r in rows[name] if r["offset"] == 0)
        assert [s for s, *_ in opens] == list(range(len(opens))) and [o[1:] for o in opens] == sorted(o[1:] for o in opens)
    places = {name: {(r["doc_id"], r["piece"]): (r["sequence_id"], r["offset"]) for r in got} for name, got in rows.items()}
    assert set(places["own"]) == set(places["other"]) and places["own"] != places["other"]
    assert len({s for s, _ in places["own"].values()}) == len({s for s, _ in places["other"].values()})


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeated rows, no rows at all, and columns named like those that operators make."""
    import random

    rng = random.Random(1)
    rows = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect():
        rows.append((r.doc_id, r.text, r.lang, r.source, r.n_chars))
    rows += [(None, None, None, None, None), (None, "", "en", "src1", 0), (900, None, None, None, None), (900, None, None, None, None), rows[3], rows[3], (901, rows[4][1], None, "src0", None)]
    rows += [(902, "wort " * 60_000, "de", None, 300_000), (903, "x" * 400_000, "en", "src2", 1), (904, " \t\n ", "en", "src2", 4), (905, 'token = "a8Fk39dKq02LmZx71Pw4"', "en", "src3", 31)]
    clash = {"block": "b", "slot": 7, "place": 1.5, "start": "s", "total": 2, "low": 3, "high": 4, "score": "q", "n": 5, "sid": 6, "gram": 8, "t": 9, "c": 10, "x": 11, "tag": "g", "label": None}
    shuffled = rng.sample(rows, len(rows))
    table = spark.createDataFrame(shuffled, "doc_id long, text string, lang string, source string, n_chars long")
    table = table.select("*", *[F.lit(v).alias(k) for k, v in clash.items()])
    table.write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    columns, last = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, docs.filter("false")):
            out = stage(spark, some, SF)
            written = common.materialize(out, name)
            if some is docs:
                last = written
            else:
                assert written.count() == 0, name
        if name != "best_fit_packing":
            assert last.columns == columns, name
            got = last.collect()
            assert got and all(all(getattr(r, k) == v for k, v in clash.items()) for r in got), name
            if name == "mixing":
                assert sorted(map(str, got)) == sorted(map(str, docs.collect()))
            docs = last
    left = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in last.collect()} == left and 901 not in left and docs.filter("doc_id = 900").count() <= 1
    masked = docs.filter("doc_id = 905").first()
    assert masked is None or masked.text == 'token = "[SECRET]"' and masked.n_chars == len(masked.text)


def test_row_order_of_many_files(spark, tmp_path):
    """Files of very unequal sizes, which a scan takes largest first."""
    frame = spark.range(0, 3000, 1, 7).selectExpr("id", "repeat('x', cast(id as int)) AS t").orderBy(F.col("id").desc())
    frame.write.parquet(f"file://{tmp_path}/t")
    for got in (spark.read.parquet(f"file://{tmp_path}/t"), frame):
        assert common.in_row_order(got).filter("place <> 2999 - id").isEmpty()


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
