"""Quality classifier by compression: zstandard dictionaries of good and of bad text."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy
from .labelled import held_out, sampled

#: Bytes compressed at a time.
PIECE = 512


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the calibration: increasing knots of the size difference and the score at each."""

    good: bytes
    bad: bytes
    level: int
    knots: tuple[float, ...]
    scores: tuple[float, ...]


class Scorer:
    """Holds the compressors of a model; one per worker."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.pair = []
        for content in (model.good, model.bad):
            held = zstandard.ZstdCompressionDict(content)
            held.precompute_compress(level=model.level)
            self.pair.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=True, write_checksum=False, write_dict_id=False))

    def difference(self, text: bytes) -> float:
        """(bad size - good size) / (both), in (-1, 1); positive when the good dictionary explains the text better.

        Sizes are sums over pieces of the whole text, each compressed alone: a long text would else
        be explained by its own beginning and no longer by either dictionary.
        """
        pieces = [text[at : at + PIECE] for at in range(0, max(1, len(text)), PIECE)]
        good, bad = (sum(len(c.compress(p)) for p in pieces) for c in self.pair)
        return (bad - good) / (bad + good)

    def score(self, text: bytes) -> float:
        """Calibrated chance of quality 1."""
        return float(np.interp(self.difference(text), self.model.knots, self.model.scores))


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a slight ridge."""
    z = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(2), z.T @ (weight * (y - p)) - 1e-3 * w)
        w = w + np.clip(step, -20, 20)
    return float(w[0]), float(w[1])


def _dictionary(texts: list[bytes], size: int, level: int) -> bytes:
    """A dictionary of ``size`` bytes at most, with entropy tables, from all pieces of the class's texts; texts too few for tables are the dictionary themselves."""
    pieces = [t[at : at + PIECE] for t in texts for at in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, pieces)) // 4)), pieces, k=200, d=8, level=level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces).ljust(8)


def fit(rows: list[tuple[str, int]], share_good: float | None = None, dictionary_bytes: int = 112 << 10, level: int = 3) -> Model:
    """Dictionaries from two thirds of the rows, calibration from the rest.

    ``share_good`` weighs the calibration rows to the share of label 1 in the labels at large. Without rows of both
    labels in both parts every score is that share (0.5 if unknown).
    """
    share = 0.5 if share_good is None else share_good
    learn, tune = [], []
    for label in (0, 1):
        own = [r for r in rows if r[1] == label]
        learn += [r for i, r in enumerate(own) if i % 3]
        tune += [r for i, r in enumerate(own) if not i % 3]
    if len({y for _, y in learn}) < 2 or len({y for _, y in tune}) < 2:
        return Model(b" " * 8, b" " * 8, level, (-1.0, 1.0), (share, share))
    good, bad = (_dictionary([t.encode() for t, y in learn if y == label], dictionary_bytes, level) for label in (1, 0))
    scorer = Scorer(Model(good, bad, level, (-1.0, 1.0), (0.0, 1.0)))
    x = np.array([scorer.difference(t.encode()) for t, _ in tune])
    y = np.array([float(y) for _, y in tune])
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    slope, offset = _calibrate(x, y, weight)
    knots = np.linspace(-1, 1, 4001)
    scores = 1 / (1 + np.exp(-np.clip(max(slope, 0) * knots + offset, -30, 30)))
    return Model(good, bad, level, tuple(knots.tolist()), tuple(scores.tolist()))


def train(documents: DataFrame, labels: DataFrame, per_class: int = 3000) -> Model:
    """Fit on at most ``per_class`` labelled rows of each class that are not held out, those with the smallest hash of doc_id.

    The bounded sample is gathered in one task, whose worker fits; only the dictionaries and the calibration come to the driver. Rows without
    text, doc_id or label do not count; without rows of both labels every score is the share of label 1 (0.5 without labels).
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    share = known.agg(F.avg("quality")).first()[0]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b[c].to_pylist() for c in ("doc_id", "text", "y"))))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([(text, y) for _, text, y in rows], share))], pa.binary())], ["model"])

    chosen = materialize(sampled(documents, labels, "quality", per_class), "sample")
    return pickle.loads(chosen.coalesce(1).mapInArrow(run, "model binary").first()["model"])


def scores(documents: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",), cut: float = 0.3) -> DataFrame:
    """``columns``, held_out, score, predicted for every row, of whole texts; null text counts as empty.

    Repeated rows and equal texts score alike; a null doc_id is not held out; an empty table gives no rows; a long text is compressed piece by piece.
    One map stage without shuffle; the model travels once per executor.
    """
    schema = documents.select(*columns).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            texts = batch["__text"].cast(pa.binary()).to_pylist()
            got = np.array([scorer.score(t or b"") for t in texts], dtype=np.float64)
            own = [batch[c] for c in columns] + [batch["held_out"], pa.array(got), pa.array((got >= cut).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(own, [*columns, "held_out", "score", "predicted"])

    rows = documents.select(*columns, held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("__text"))
    return rows.mapInArrow(run, f"{kinds}, held_out boolean, score double, predicted int")


def kept(documents: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """The rows of ``documents`` that score at least ``cut``, all columns as they are; null text counts as empty.

    A score equal to the cut stays, repeated rows stay or go together, and columns of any name come out unchanged. Only the text
    column goes to Python.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        scorer = Scorer(sent.value)
        return pa.array([scorer.score(t or b"") for t in text.cast(pa.binary()).to_pylist()], pa.float64())

    return documents.filter(score(F.col("text").cast("string")) >= cut)
