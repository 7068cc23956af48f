"""Captured messages to raw telemetry rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pulsegrid.operators import messages as ms


def ingest(
    messages: DataFrame,
    catalog: DataFrame | None = None,
    order: list[str] | None = None,
    slice_col: str | None = None,
    slices: list[str] | None = None,
) -> DataFrame:
    """Raw telemetry rows of all accepted messages of a batch.

    With ``slices``, the columns that name the piece of a file a message was read from, messages get
    their serials where they are read and only observations travel on."""
    if slices:
        known = ms.assign_serial_in_place(messages, order, slices, slice_col)
    else:
        known = ms.assign_serial(messages, order, slice_col)
    parsed = ms.with_segments(known)
    return ms.telemetry_rows(ms.enrich(ms.observations(parsed), catalog))
