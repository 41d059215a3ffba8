"""What the archive's questions answer with."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class IngestResult:
    n_rows: int
    n_runs_written: int
    n_runs_skipped: int
    n_runs_superseded: int


@dataclass(frozen=True)
class AccuracyResult:
    """One point; value is None unless usable. n counts matched pairs even where the metric is undefined."""

    horizon: int
    metric: str
    basis: str
    status: str
    value: float | None
    n: int
    n_missing_actuals: int
    n_fallback: int
    served_from: str

    @property
    def ok(self) -> bool:
        """Whether there is a value, of all forecasts or of some."""
        return self.status != "insufficient"

    @property
    def fallback_used(self) -> bool:
        return self.n_fallback > 0


@dataclass(frozen=True)
class AccuracyCurve:
    """Points of one metric on one basis, in the order asked for."""

    points: tuple[AccuracyResult, ...]
    metric: str = "MAE"
    basis: str = "latest"

    def __iter__(self):
        return iter(self.points)

    def __len__(self) -> int:
        return len(self.points)

    def to_frame(self):
        """A pandas frame, a row a point."""
        import pandas as pd

        names = ["horizon", "metric", "basis", "status", "value", "n", "n_missing_actuals", "n_fallback"]
        return pd.DataFrame([asdict(p) for p in self.points], columns=[*names, "served_from"])[names]

    def plot(self, ax=None):
        """Value over horizon of the usable points; needs matplotlib."""
        if ax is None:
            import matplotlib.pyplot as plt

            ax = plt.gca()
        usable = [p for p in self.points if p.ok]
        ax.plot([p.horizon for p in usable], [p.value for p in usable], marker="o")
        return ax
