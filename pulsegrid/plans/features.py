"""Telemetry to feature windows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from pulsegrid import fixed
from pulsegrid.operators import align, windows


@dataclass(frozen=True)
class FeaturePlan:
    """Grid, window and column choices of the feature pipeline.

    ``stage`` cuts lineage where several branches read one result: after binning and after the
    wide table is ready. Identity keeps everything in one lazy plan."""

    freq: str = "1min"
    max_gap: str = "5min"
    window: str = "30min"
    step: str = "5min"
    sizing: str = "by_step"
    variable_ids: list[int] = field(default_factory=lambda: list(fixed.ALL_IDS))
    status: list[str] | None = None
    features: list[str] | None = None
    slice_bins: int = align.SLICE_BINS
    slice: str = windows.SLICE
    stage: Callable[[DataFrame], DataFrame] | None = None

    def wide(self, long: DataFrame) -> DataFrame:
        """Aligned, derived and active rows."""
        aligned = align.resample_then_pivot(
            long, self.freq, self.max_gap, self.variable_ids, self.status, self.slice_bins, self.stage
        )
        ready = align.active_only(align.derived_features(aligned))
        if self.features is not None:
            ready = align.pad_features(ready, self.features)
        return ready if self.stage is None else self.stage(ready)

    def feature_list(self, wide: DataFrame) -> list[str]:
        return align.feature_columns(wide.columns, self.features, model_only=self.features is None)

    def members(self, wide: DataFrame) -> DataFrame:
        return windows.sliding_windows(
            wide, self.feature_list(wide), self.window, self.step, self.sizing, self.slice
        )

    def summaries(self, long: DataFrame) -> tuple[DataFrame, list[str]]:
        """Window summary rows and the ordered feature list."""
        wide = self.wide(long)
        features = self.feature_list(wide)
        rows = windows.window_summaries(
            wide, features, self.window, self.step, self.sizing, self.slice
        )
        return rows, features
