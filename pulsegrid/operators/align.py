"""Time alignment: bin means, wide pivots, gap filling, engineered signals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from pulsegrid import fixed
from pulsegrid.functions.grid import bin_index, bin_start, grid_seconds, seconds
from pulsegrid.operators.ordered import spread

_MASK = 62  # bits used of a word
_FOLD = 64  # longest gap, in bins, over which status words are carried as a list
SLICE_BINS = 1440


def resample_mean(long: DataFrame, freq: str) -> DataFrame:
    """Mean per (device, variable, bin); hot keys collapse in the map-side partial aggregate."""
    step = grid_seconds(freq)
    usable = long.where("device_serial is not null and variable_id is not null")
    return usable.groupBy(
        "device_serial", "variable_id", bin_index(F.col("timestamp"), step).alias("bin")
    ).agg(F.avg("value").alias("value"))


def densify(binned: DataFrame, slice_bins: int = SLICE_BINS) -> DataFrame:
    """All bins between the first and last bin of each (device, variable); gaps are null."""
    return spread(binned, ["device_serial", "variable_id"], ["value"], 0, slice_bins)


def forward_fill(binned: DataFrame, limit: int, slice_bins: int = SLICE_BINS) -> DataFrame:
    """Regular grid per (device, variable), values repeated for at most ``limit`` bins."""
    return spread(binned, ["device_serial", "variable_id"], ["value"], limit, slice_bins)


def _chunks(names: list[str]) -> list[tuple[int, list[str]]]:
    return [(at // _MASK, names[at : at + _MASK]) for at in range(0, len(names), _MASK)]


def bin_packed(
    long: DataFrame, freq: str, variable_ids: list[int], status: list[str] | None = None
) -> DataFrame:
    """One row per (device, bin): mean of each variable, and status columns packed in two words.

    Bin mean, pivot and status merge are one aggregate on one shuffle. ``seen_<j>`` holds, as
    bits, which variables have a row in the bin (with or without a value), ``known_<j>`` which status
    columns some row of the bin knows, ``on_<j>`` which of them are true in some row. Rows of other
    variables count for their status only."""
    step = grid_seconds(freq)
    ids, status = list(variable_ids), list(status or [])
    wanted = F.col("variable_id").isin(ids)
    for c in status:
        wanted = wanted | F.col(c).isNotNull()
    rows = long.where(F.col("device_serial").isNotNull() & F.col("timestamp").isNotNull() & wanted)
    aggs = [f"avg(case when variable_id = {i} then value end) as var_{i}" for i in ids]
    for at, part in _chunks(status):
        known = " | ".join(f"if({c} is null, 0L, {1 << p}L)" for p, c in enumerate(part))
        on = " | ".join(f"if(cast({c} as boolean), {1 << p}L, 0L)" for p, c in enumerate(part))
        aggs += [f"bit_or({known}) as known_{at}", f"bit_or({on}) as on_{at}"]
    for at in range(0, len(ids), _MASK):
        arms = " ".join(
            f"when {i} then {1 << p}L" for p, i in enumerate(ids[at : at + _MASK])
        )
        aggs.append(f"bit_or(case variable_id {arms} else 0L end) as seen_{at // _MASK}")
    return rows.groupBy("device_serial", bin_index(F.col("timestamp"), step).alias("bin")).agg(
        *[F.expr(a) for a in aggs]
    )


def _unpack(packed: DataFrame, status: list[str]) -> DataFrame:
    """Status columns (1.0, 0.0, null for unknown) in place of the packed words."""
    shown = {
        c: F.expr(f"case when known_{at} & {1 << p}L <> 0 then if(on_{at} & {1 << p}L <> 0, 1.0D, 0.0D) end")
        for at, part in _chunks(status)
        for p, c in enumerate(part)
    }
    words = [f"{kind}_{at}" for at, _ in _chunks(status) for kind in ("known", "on")]
    return packed.withColumns(shown).drop(*words) if status else packed


def bin_wide(
    long: DataFrame, freq: str, variable_ids: list[int], status: list[str] | None = None
) -> DataFrame:
    """One row per (device, bin): mean of each variable, OR of each status column (null where no row
    of the bin knows it), and ``seen_<j>`` as in :func:`bin_packed`."""
    return _unpack(bin_packed(long, freq, variable_ids, status), list(status or []))


def resample_then_pivot(
    long: DataFrame,
    freq: str = "1min",
    max_gap: str = "5min",
    variable_ids: list[int] | None = None,
    status: list[str] | None = None,
    slice_bins: int = SLICE_BINS,
    stage: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Long telemetry to one wide row per (device, bin) with bounded forward fill.

    Each variable is filled inside its own first..last range; rows are the union of the ranges.
    Status columns come from all rows of a bin, those of variables not asked for too; they are carried
    through the fill as two packed words (gaps of more than 64 bins: column by column).
    ``stage`` (for example :func:`pulsegrid.session.materialize`) cuts lineage after the raw
    table has been reduced to bins, so the raw scan happens once.
    """
    ids = list(variable_ids or fixed.ALL_IDS)
    if status is None:
        status = [c for c in long.columns if c.startswith("bitfield_")]
    status = list(status)
    binned = bin_packed(long, freq, ids, status)
    if stage is not None:
        binned = stage(binned)
    spans = {
        f"var_{i}": f"seen_{p // _MASK} & {1 << (p % _MASK)}L != 0"
        for p, i in enumerate(ids)
    }
    step = grid_seconds(freq)
    values, fill = [f"var_{i}" for i in ids], seconds(max_gap) // step
    if fill <= _FOLD:
        words = [(f"known_{at}", f"on_{at}") for at, _ in _chunks(status)]
        grid = _unpack(spread(binned, ["device_serial"], values, fill, slice_bins, spans, words), status)
    else:
        flags = _unpack(binned, status)
        grid = spread(flags, ["device_serial"], values + status, fill, slice_bins, spans)
    return grid.select(
        bin_start(F.col("bin"), step).alias("timestamp"), "device_serial", *values, *status
    )


def pivot_long_to_wide(
    long: DataFrame, variable_ids: list[int], status: list[str] | None = None, order: str | None = None
) -> DataFrame:
    """Wide rows on exact timestamps; duplicate readings are averaged.

    Pairs without any value vanish. Status columns come from the first row of the pair in
    ``order`` (a column that makes "first" definite)."""
    ids = list(variable_ids)
    if status is None:
        status = [c for c in long.columns if c.startswith("bitfield_")]
    first = F.min_by(F.struct(*status), F.col(order)).alias("_status") if status else None
    wide = (
        long.where(F.col("device_serial").isNotNull())
        .groupBy("timestamp", "device_serial")
        .agg(
            *[F.expr(f"avg(case when variable_id = {i} then value end) as var_{i}") for i in ids],
            F.count(F.when(F.col("variable_id").isin(ids), F.col("value"))).alias("_values"),
            *([first] if status else []),
        )
        .where("_values > 0")
    )
    return wide.select(
        "timestamp",
        "device_serial",
        *[f"var_{i}" for i in ids],
        *[F.col(f"_status.{c}").alias(c) for c in status],
    )


def resample_and_fill(
    wide: DataFrame,
    freq: str = "5min",
    method: str = "ffill",
    max_gap: str = "30min",
    slice_bins: int = SLICE_BINS,
) -> DataFrame:
    """Mean of every column per (device, bin) on a full grid, then bounded forward fill."""
    step = grid_seconds(freq)
    values = [c for c in wide.columns if c not in ("timestamp", "device_serial")]
    binned = (
        wide.where("device_serial is not null")
        .groupBy("device_serial", bin_index(F.col("timestamp"), step).alias("bin"))
        .agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in values])
    )
    limit = seconds(max_gap) // step if method == "ffill" else 0
    grid = spread(binned, ["device_serial"], values, limit, slice_bins)
    return grid.select(bin_start(F.col("bin"), step).alias("timestamp"), "device_serial", *values)


def derived_features(wide: DataFrame) -> DataFrame:
    """Engineered signals, each only when its sources are present."""
    sources = {
        "fio2_deviation": ("var_635", "var_2782", lambda a, b: a - b),
        "o2_air_pressure_ratio": ("var_2098", "var_2097", lambda a, b: a / F.nullif(b, F.lit(0.0))),
        "volume_balance": ("var_2324", "var_2325", lambda a, b: a - b),
    }
    return wide.withColumns(
        {
            name: rule(F.col(a), F.col(b))
            for name, (a, b, rule) in sources.items()
            if a in wide.columns and b in wide.columns
        }
    )


def active_only(wide: DataFrame, standby_id: int = fixed.STANDBY_VARIABLE) -> DataFrame:
    """Drop standby rows; rows with an unknown flag stay. Without the column nothing is dropped."""
    flag = f"var_{standby_id}"
    if flag not in wide.columns:
        return wide
    return wide.where(~F.col(flag).eqNullSafe(F.lit(1.0)))


def feature_columns(columns: list[str], wanted: list[str] | None = None, model_only: bool = False) -> list[str]:
    """Feature columns present in a wide table; ``model_only`` keeps tier 1 and 2 variables."""
    if wanted is None:
        wanted = [
            c
            for c in columns
            if c.startswith(("var_", "bitfield_")) or c in fixed.DERIVED_FEATURES
        ]
    found = [c for c in wanted if c in columns]
    if model_only:
        keep = {f"var_{i}" for i in fixed.MODEL_IDS}
        found = [c for c in found if not c.startswith("var_") or c in keep]
    if not found:
        raise ValueError("no feature columns found")
    return found


def pad_features(wide: DataFrame, features: list[str]) -> DataFrame:
    """Add absent feature columns as nulls so the vector always has the model's width."""
    missing = [c for c in features if c not in wide.columns]
    return wide.withColumns({c: F.lit(None).cast("double") for c in missing}) if missing else wide
