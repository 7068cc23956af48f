"""Queries over the time grid and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid import fixed
from pulsegrid.functions.grid import bin_start, seconds
from pulsegrid.operators import align, scaling, windows
from pulsegrid.models.linear_svm import LinearOneClass
from pulsegrid.plans.features import FeaturePlan
from pulsegrid.session import materialize
from pulsegrid.workloads import adapter as ad
from pulsegrid.workloads.registry import query
from pulsegrid.workloads.views_sql import BIN_US, IDS, NUMERIC, STATUS, r6, sql, stats_sql

STEP = seconds(ad.FREQ)
AT = f"make_timestamp(bin * {BIN_US}) AS timestamp"
VARS = [f"var_{i}" for i in IDS]
STATUS_PICK = ["bitfield_gas_supplies_ok", "bitfield_safety_valve_ok"]


def _stamped(df):
    return df.withColumn("timestamp", bin_start(F.col("bin"), STEP)).drop("bin")


def _binned(spark, sf):
    return align.resample_mean(ad.telemetry(spark, sf, status=False), ad.FREQ)


def _aligned(spark, sf, status=()):
    long = ad.telemetry(spark, sf, status=bool(status))
    return align.resample_then_pivot(long, ad.FREQ, ad.GAP, IDS, list(status), ad.SLICE_BINS)


@query("resample_mean", sql(f"SELECT device_serial, variable_id, {AT}, {r6('value')} FROM binned"))
def resample_mean(spark, sf):
    return _stamped(_binned(spark, sf))


@query("densify_grid", sql(f"SELECT device_serial, variable_id, {AT}, {r6('value')} FROM dense"))
def densify_grid(spark, sf):
    return _stamped(align.densify(_binned(spark, sf), ad.SLICE_BINS))


@query("ffill_bounded", sql(f"SELECT device_serial, variable_id, {AT}, {r6('value')} FROM filled"))
def ffill_bounded(spark, sf):
    return _stamped(align.forward_fill(_binned(spark, sf), 4, ad.SLICE_BINS))


@query("resample_pivot", sql(f"SELECT device_serial, {AT}, {r6(*VARS)} FROM wide"))
def resample_pivot(spark, sf):
    return _aligned(spark, sf)


@query(
    "bitfield_resample",
    sql(f"SELECT device_serial, {AT}, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in STATUS)} FROM bits"),
)
def bitfield_resample(spark, sf):
    binned = align.bin_wide(ad.telemetry(spark, sf), ad.FREQ, IDS, STATUS)
    return _stamped(binned).select("device_serial", "timestamp", *STATUS)


@query("resample_pivot_bits", sql(f"SELECT device_serial, {AT}, {r6(*VARS)}, {', '.join(STATUS)} FROM wide_bits"))
def resample_pivot_bits(spark, sf):
    return _aligned(spark, sf, STATUS)


def _avg(i):
    return f"round(avg(CASE WHEN variable_id = {i} THEN value END) + 1e-10, 6) + 0.0 AS var_{i}"


@query(
    "pivot_wide",
    sql(f"SELECT timestamp, device_serial, {', '.join(map(_avg, IDS))} FROM telemetry WHERE value IS NOT NULL GROUP BY 1, 2"),
)
def pivot_wide(spark, sf):
    return align.pivot_long_to_wide(ad.telemetry(spark, sf, status=False), IDS)


@query(
    "pivot_wide_bits",
    sql(f"""SELECT w.*, {', '.join(f'b.{c}' for c in STATUS)} FROM
        (SELECT date_trunc('day', timestamp) AS timestamp, device_serial, {', '.join(map(_avg, IDS))}
         FROM telemetry GROUP BY 1, 2) w
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY device_serial, date_trunc('day', timestamp)
          ORDER BY event_id) AS r FROM telemetry) b
        ON b.r = 1 AND b.device_serial = w.device_serial AND date_trunc('day', b.timestamp) = w.timestamp"""),
)
def pivot_wide_bits(spark, sf):
    daily = ad.telemetry(spark, sf).withColumn("timestamp", F.date_trunc("day", "timestamp"))
    return align.pivot_long_to_wide(daily, IDS, STATUS, order="event_id")


@query(
    "resample_fill",
    sql(
        f"SELECT device_serial, {AT}, {r6(*VARS)} FROM filled_wide",
        {
            "exact": f"SELECT timestamp, device_serial, {', '.join(f'avg(CASE WHEN variable_id = {i} THEN value END) AS var_{i}' for i in IDS)} FROM telemetry GROUP BY 1, 2",
            "coarse": f"SELECT device_serial, epoch_us(timestamp) // {BIN_US} AS bin, {', '.join(f'avg({v}) AS {v}' for v in VARS)} FROM exact GROUP BY 1, 2",
            "filled_wide": "SELECT device_serial, bin, "
            + ", ".join(f"last_value({v} IGNORE NULLS) OVER (PARTITION BY device_serial ORDER BY bin ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS {v}" for v in VARS)
            + " FROM (SELECT device_serial, unnest(generate_series(min(bin), max(bin))) AS bin FROM coarse GROUP BY 1) LEFT JOIN coarse USING (device_serial, bin)",
        },
    ),
)
def resample_fill(spark, sf):
    wide = align.pivot_long_to_wide(ad.telemetry(spark, sf, status=False), IDS)
    return align.resample_and_fill(wide, ad.FREQ, "ffill", ad.GAP, ad.SLICE_BINS)


@query(
    "derived_features",
    sql(f"SELECT device_serial, {AT}, {r6('fio2_deviation', 'o2_air_pressure_ratio')} FROM derived"),
)
def derived_features(spark, sf):
    wide = align.derived_features(_aligned(spark, sf))
    return wide.select("device_serial", "timestamp", "fio2_deviation", "o2_air_pressure_ratio")


@query("active_filter", sql(f"SELECT device_serial, {AT}, {r6(*VARS)} FROM active"))
def active_filter(spark, sf):
    return align.active_only(_aligned(spark, sf))


@query("select_features", sql(f"SELECT device_serial, {AT}, {r6(*NUMERIC)}, {', '.join(STATUS_PICK)} FROM active"))
def select_features(spark, sf):
    wide = align.active_only(align.derived_features(_aligned(spark, sf, STATUS_PICK)))
    chosen = align.feature_columns(wide.columns, model_only=True)
    return wide.select("device_serial", "timestamp", *chosen)


@query(
    "pad_features",
    sql(f"""SELECT device_serial, {AT}, {r6('var_635')},
        CAST(NULL AS DOUBLE) AS var_2324, CAST(NULL AS DOUBLE) AS volume_balance FROM wide"""),
)
def pad_features(spark, sf):
    wanted = ["var_635", "var_2324", "volume_balance"]
    padded = align.pad_features(_aligned(spark, sf), wanted)
    return padded.select("device_serial", "timestamp", *wanted)


def _active(spark, sf):
    return align.active_only(align.derived_features(_aligned(spark, sf)))


def _members(spark, sf, **kw):
    return windows.sliding_windows(
        materialize(_active(spark, sf), "wide"), NUMERIC, ad.WINDOW, ad.STEP, slice=ad.SLICE,
        block_windows=16, **kw,
    )


@query("cadence_median", sql(f"SELECT device_serial, {r6('cadence_s')} FROM cadence"))
def cadence_median(spark, sf):
    return windows.cadence(materialize(_active(spark, sf).select("device_serial", "timestamp"), "rows"), ad.SLICE)


@query(
    "sliding_windows",
    sql(f"SELECT device_serial, window_idx, pos, timestamp, {r6(*NUMERIC)} FROM members"),
)
def sliding_windows(spark, sf):
    return _members(spark, sf).select("device_serial", "window_idx", "pos", "timestamp", *NUMERIC)


@query(
    "sliding_windows_by_duration",
    sql(
        f"SELECT device_serial, window_idx, pos, timestamp, {r6(*NUMERIC)} FROM members2",
        {
            "sizes2": """SELECT device_serial, CAST(greatest(1, round_even(129600 / cadence_s, 0)) AS BIGINT) AS win,
                CAST(greatest(1, round_even(43200 / cadence_s, 0)) AS BIGINT) AS stride FROM cadence""",
            "numbered2": """SELECT a.*, s.win, s.stride, row_number() OVER (PARTITION BY device_serial ORDER BY bin) - 1 AS rn,
                count(*) OVER (PARTITION BY device_serial) AS n FROM active a JOIN sizes2 s USING (device_serial)""",
            "starts2": """SELECT device_serial, win, stride, unnest(generate_series(0, (n - win) // stride)) AS window_idx
                FROM (SELECT DISTINCT device_serial, win, stride, n FROM numbered2) WHERE win >= 2 AND n >= win""",
            "members2": f"""SELECT w.window_idx, r.rn - w.window_idx * w.stride AS pos, r.*, make_timestamp(r.bin * {BIN_US}) AS timestamp
                FROM starts2 w JOIN numbered2 r ON r.device_serial = w.device_serial
                AND r.rn BETWEEN w.window_idx * w.stride AND w.window_idx * w.stride + w.win - 1""",
        },
    ),
)
def sliding_windows_by_duration(spark, sf):
    """Windows sized by the true sampling interval, stepping two rows at a time."""
    members = windows.sliding_windows(
        materialize(_active(spark, sf), "wide"), NUMERIC, ad.WINDOW, "12h", sizing="duration",
        slice=ad.SLICE, block_windows=16,
    )
    return members.select("device_serial", "window_idx", "pos", "timestamp", *NUMERIC)


@query(
    "window_metadata",
    sql("""SELECT device_serial, window_idx, min(timestamp) AS window_start, max(timestamp) AS window_end,
        CAST(count(*) AS INTEGER) AS n_samples FROM members GROUP BY 1, 2"""),
)
def window_metadata(spark, sf):
    return windows.window_metadata(_members(spark, sf))


_CELL = lambda c: f"coalesce(CAST(CAST(round({c} * 100) AS BIGINT) AS VARCHAR), '-')"


@query(
    "window_tensor",
    sql(f"""SELECT device_serial, window_idx, string_agg({_CELL('var_635')} || ':' || {_CELL('fio2_deviation')}, ',' ORDER BY pos)
        AS tensor_text, CAST(count(*) AS INTEGER) AS n_samples FROM members GROUP BY 1, 2"""),
)
def window_tensor(spark, sf):
    features = ["var_635", "fio2_deviation"]
    tensor = windows.window_tensor(_members(spark, sf), features)
    cell = lambda v: F.coalesce(F.round(v * 100).cast("bigint").cast("string"), F.lit("-"))
    row = lambda r: F.concat(cell(r[0]), F.lit(":"), cell(r[1]))
    text = F.array_join(F.transform("tensor", row), ",").alias("tensor_text")
    return tensor.select("device_serial", "window_idx", text, "n_samples")


COLUMNS = windows.summary_columns(NUMERIC)
META = "device_serial, window_idx, window_start, window_end, n_samples"


@query("window_stats", sql(f"SELECT {META}, {r6(*COLUMNS)} FROM stats", stats_sql(NUMERIC)))
def window_stats(spark, sf):
    return windows.window_stats(_members(spark, sf), NUMERIC)


def _plan(status, features):
    return FeaturePlan(
        ad.FREQ, ad.GAP, ad.WINDOW, ad.STEP, variable_ids=IDS, status=status, features=features,
        slice_bins=ad.SLICE_BINS, slice=ad.SLICE, stage=materialize,
    )


_ALL = [f"var_{i}" for i in (635, 2782, 2098, 2097)] + STATUS + ["fio2_deviation", "o2_air_pressure_ratio"]


@query(
    "prepare_features",
    sql(f"SELECT {META}, {r6(*windows.summary_columns(_ALL))} FROM stats", stats_sql(_ALL)),
)
def prepare_features(spark, sf):
    return _plan(STATUS, None).summaries(ad.telemetry(spark, sf))[0]


def summaries(spark, sf):
    """Stored window summaries of the numeric features."""
    stats, _ = _plan([], NUMERIC).summaries(ad.telemetry(spark, sf, status=False))
    return materialize(stats, "stats")


@query("impute_median", sql(f"SELECT {META}, {r6(*COLUMNS)} FROM imputed", stats_sql(NUMERIC)))
def impute_median(spark, sf):
    stats = summaries(spark, sf)
    return scaling.impute(stats, scaling.medians(stats, COLUMNS))


@query("standardize", sql(f"SELECT {META}, {r6(*COLUMNS)} FROM scaled", stats_sql(NUMERIC)))
def standardize(spark, sf):
    stats = summaries(spark, sf)
    return scaling.standardize(scaling.impute(stats, scaling.medians(stats, COLUMNS)), COLUMNS)


WEIGHTS = {"mean": -1.0, "std": -0.5, "min": 0.25, "max": -0.25, "delta": -0.125}
OFFSET = 0.5
LINEAR = LinearOneClass([WEIGHTS[c.rsplit("__", 1)[1]] for c in COLUMNS], OFFSET)
LINEAR_SQL = " + ".join(f"coalesce({c}, 0) * {WEIGHTS[c.rsplit('__', 1)[1]]}" for c in COLUMNS)


def linear_scores(spark, sf):
    """Windows scored by a linear model with fixed weights."""
    stats = summaries(spark, sf)
    filled = scaling.impute(stats, scaling.medians(stats, COLUMNS))
    return LINEAR.score(scaling.Scaler.fit(filled, COLUMNS).vector(filled))


@query(
    "ocsvm_score",
    sql(f"SELECT {META}, round({OFFSET} - ({LINEAR_SQL}) + 1e-10, 6) + 0.0 AS anomaly_score, "
        f"CASE WHEN {OFFSET} - ({LINEAR_SQL}) > 0 THEN -1 ELSE 1 END AS prediction FROM scaled",
        stats_sql(NUMERIC)),
)
def ocsvm_score(spark, sf):
    scored = linear_scores(spark, sf)
    label = F.when(F.col("anomaly_score") > 0, -1).otherwise(1)
    return scored.withColumn("prediction", label).drop("x")
