"""Order-dependent building blocks that do not need one task per key.

A window over ``partitionBy(device).orderBy(time)`` puts a whole device into one task. The
helpers here cut every key into time slices, order rows inside ``(key, slice)`` only, and carry
what crosses a slice border (row counts, the next or last value) through a table with one row
per slice. The large table is shuffled once on ``(key, slice)``; the slice table is small.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from pulsegrid.session import materialize


def time_slice(ts: Column, slice_seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(slice_seconds * 1_000_000)).cast("bigint")


def value_slice(value: Column) -> Column:
    """Monotone bucket of a double (about 9 % wide), so ranks can be cut into slices by value.

    Sorting by the bucket agrees with sorting by the value; equal values share a bucket.
    """
    level = F.floor(F.log2(F.abs(value)) * 8).cast("bigint") + F.lit(10_000)
    return F.when(value.isNull(), None).when(value > 0, level).when(value < 0, -level).otherwise(0)


def add_ordinals(
    df: DataFrame,
    keys: list[str],
    order: list,
    slice_col: str,
    marks: dict[str, Column] | None = None,
    per_key: DataFrame | None = None,
) -> DataFrame:
    """Add ``rn`` (0-based position within the key), ``n`` (rows of the key) and, for each mark,
    the number of marked rows up to and including this one. Columns of ``per_key`` (one row per
    key) ride along on the slice table, so the large table is joined only once."""
    marks = marks or {}
    flags = {f"_is_{name}": cond.cast("int") for name, cond in marks.items()}
    df = df.withColumns(flags) if flags else df
    per_slice = df.groupBy(*keys, slice_col).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(f"_is_{name}").alias(f"_sum_{name}") for name in marks],
    )
    before = W.partitionBy(*keys).orderBy(slice_col).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = per_slice.select(
        *keys,
        slice_col,
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(whole).alias("n"),
        *[F.coalesce(F.sum(f"_sum_{m}").over(before), F.lit(0)).alias(f"_base_{m}") for m in marks],
    )
    if per_key is not None:
        offsets = offsets.join(per_key, keys)
    inside = W.partitionBy(*keys, slice_col).orderBy(*order)
    running = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = df.join(offsets, [*keys, slice_col])
    out = out.withColumns(
        {
            "rn": F.col("_offset") + F.row_number().over(inside) - 1,
            **{m: F.col(f"_base_{m}") + F.sum(f"_is_{m}").over(running) for m in marks},
        }
    )
    return out.drop("_offset", *flags, *[f"_base_{m}" for m in marks])


def carry_last(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    slice_col: str,
    value: str,
    out: str,
) -> DataFrame:
    """Last non-null ``value`` at or before each row of the key."""
    known = F.when(F.col(value).isNotNull(), F.struct(*order))
    per_slice = df.groupBy(*keys, slice_col).agg(F.max_by(value, known).alias("_last"))
    before = W.partitionBy(*keys).orderBy(slice_col).rowsBetween(W.unboundedPreceding, -1)
    carried = per_slice.select(
        *keys, slice_col, F.last("_last", ignorenulls=True).over(before).alias("_carried")
    )
    inside = (
        W.partitionBy(*keys, slice_col)
        .orderBy(*order)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        df.join(carried, [*keys, slice_col])
        .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), "_carried"))
        .drop("_carried")
    )


def pin_splits(spark: SparkSession) -> None:
    """Let every later scan of the session cut its files alike, whatever executors come and go."""
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))


def slice_starts(df: DataFrame, keys: list[str], order: list[str], slices: list[str], value: str) -> DataFrame:
    """One row per slice of each key: ``_start``, the last known ``value`` before it, and
    ``_mixed``, whether its positions reach into those of the slice before."""
    at = F.struct(*order)
    per_slice = df.groupBy(*keys, *slices).agg(
        F.min(at).alias("_from"),
        F.max(at).alias("_to"),
        F.max(F.when(F.col(value).isNotNull(), F.struct(*order, value)))[value].alias("_last"),
    )
    by_place = W.partitionBy(*keys).orderBy("_from", "_to")
    before = by_place.rowsBetween(W.unboundedPreceding, -1)
    return per_slice.select(
        *keys,
        *slices,
        F.last("_last", ignorenulls=True).over(before).alias("_start"),
        F.coalesce(F.max("_to").over(before) >= F.col("_from"), F.lit(False)).alias("_mixed"),
    )


def carry_in_place(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    slices: list[str],
    value: str,
    out: str,
    most_slices: int = 1_000_000,
    chunk: int = 8192,
) -> DataFrame | None:
    """Last non-null ``value`` at or before each row of the key, without moving a row.

    ``slices`` name the piece of a file that a row was read from, so the rows of a slice are in one
    task, and every scan gives them in one order. They are sorted and filled ``chunk`` rows at a time, so
    a task holds no more whatever the size of its pieces; what holds at the start of a chunk comes from a
    written table of one row per key, slice and chunk, which is broadcast. Null keys are a key of their
    own; of rows at the same place the one with the largest value comes last; an empty table gives no
    rows. None if this cannot be done, because chunks of a key overlap in ``order`` or there are more
    than ``most_slices`` of them: :func:`carry_last` can."""
    spark = df.sparkSession
    pin_splits(spark)
    # a task's numbers start at a multiple of 2**33: no chunk reaches into two tasks
    df_chunks = df.withColumn("_chunk", F.monotonically_increasing_id())
    df_chunks = df_chunks.withColumn("_chunk", F.expr(f"_chunk div {chunk}"))
    slices = [*slices, "_chunk"]
    starts = materialize(
        slice_starts(df_chunks.select(*keys, *order, *slices, value), keys, order, slices, value), "starts"
    )
    n, mixed = starts.agg(F.count(F.lit(1)), F.coalesce(F.max("_mixed"), F.lit(False))).first()
    if mixed or n > most_slices:
        return None
    names = [*keys, *slices]
    firsts = F.broadcast(starts.select(*[F.col(c).alias(f"_of_{c}") for c in names], "_start", F.lit(True).alias("_met")))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in names])
    placed = df_chunks.join(firsts, same, "left").drop(*[f"_of_{c}" for c in names])
    placed = placed.withColumn("_here", F.xxhash64(*names))  # differs from one slice of a key to the next
    kept = [c for c in df.columns if c != out]
    schema = df.select(*kept, F.col(value).alias(out)).schema
    by = [(c, "ascending") for c in dict.fromkeys(["_here", *order, value])]

    def fill(rows: pa.Table) -> pa.RecordBatch:
        """Whole chunks, with what was last known at each row."""
        if not all(rows["_met"].to_pylist()):
            raise ValueError("the files were cut differently by two scans of one job")
        places = pc.sort_indices(rows.select([c for c, _ in by]), sort_keys=by, null_placement="at_start").to_numpy()
        ordered = rows.select([value, "_here", "_start"]).take(pa.array(places)).combine_chunks()
        own, here = ordered[value], ordered["_here"].to_numpy()
        first = np.concatenate([[True], here[1:] != here[:-1]])
        known = own.combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        # rows to take from: the chunk's own values, then its starts
        at = np.where(known, np.arange(len(here)), np.where(first, len(here) + np.arange(len(here)), -1))
        at = at[np.maximum.accumulate(np.where(at >= 0, np.arange(len(here)), 0))]
        back = np.empty(len(here), np.int64)
        back[places] = at
        pool = pa.concat_arrays([own.combine_chunks(), ordered["_start"].combine_chunks()])
        filled = pool.take(pa.array(back))
        return pa.RecordBatch.from_arrays([*[rows[c].combine_chunks() for c in kept], filled], names=[*kept, out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            if rows.num_rows:
                part = rows["_chunk"].to_numpy()
                done = int(np.searchsorted(part, part[-1]))  # the last chunk may go on
                if done:
                    yield fill(rows.slice(0, done))
                rest = rows.slice(done)
        if rest is not None and rest.num_rows:
            yield fill(rest)

    return placed.mapInArrow(run, schema)


def spread(
    rows: DataFrame,
    keys: list[str],
    values: list[str],
    fill: int,
    slice_bins: int,
    spans: dict[str, str] | None = None,
    words: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """Put sparse bins of each key on a regular grid and carry values forward.

    ``rows`` has one row per ``(keys, bin)``. A value is repeated for at most ``fill`` bins after
    the bin that holds it. ``spans`` maps a value to the SQL condition "this series has a row in this
    bin"; then the grid only covers bins between the first and last row of some series (other rows
    give what they hold to later bins only), and a value is not carried beyond the last row of its own
    series. ``words`` are pairs of columns (bits known, bits set): each bit is carried by itself, as
    a value is, but a pair costs one window column, a list of at most ``fill`` + 1 rows. Without ``spans`` the grid runs
    from the first to the last bin of the key.

    Every slice also receives the rows of the last ``fill`` bins before it, so slices are filled
    independently of each other.
    """
    width = max(slice_bins, fill, 1)
    spans, words = spans or {}, words or []
    sliced = rows.withColumn("_slice", F.floor(F.col("bin") / width).cast("bigint"))

    per_slice = sliced.groupBy(*keys, "_slice").agg(
        F.min("bin").alias("_head"),
        *[F.expr(f"min(case when {c} then bin end) as _first_{v}") for v, c in spans.items()],
        *[F.expr(f"max(case when {c} then bin end) as _last_{v}") for v, c in spans.items()],
    )
    by_slice = f"partition by {', '.join(keys)} order by _slice"
    whole = f"({by_slice} rows between unbounded preceding and unbounded following)"
    edges = per_slice.selectExpr(
        *keys,
        "_slice",
        f"lead(_head) over ({by_slice}) as _next_head",
        *[f"min(_first_{v}) over {whole} as _first_{v}" for v in spans],
        *[f"max(_last_{v}) over {whole} as _last_{v}" for v in spans],
    )

    copies = f"case when bin >= (_slice + 1) * {width} - {fill} then array(_slice, _slice + 1) else array(_slice) end"
    packed = [c for pair in words for c in pair]
    placed = sliced.selectExpr(*keys, "bin", *values, *packed, "_slice as _home", f"explode({copies}) as _slice")

    inside = f"(partition by {', '.join(keys)}, _slice order by bin)"
    held = [f"last({v}, true) over {inside} as _held_{v}" for v in values]
    held += [
        f"last(case when {v} is not null then bin end, true) over {inside} as _since_{v}"
        for v in values
    ]
    reached = f"(partition by {', '.join(keys)}, _slice order by bin range between {fill} preceding and current row)"
    held += [
        f"collect_list(if({k} <> 0, struct(bin, {k} as known, {on} as on), null)) over {reached} as _marks_{k}"
        for k, on in words
    ]
    known = (
        placed.join(edges, [*keys, "_slice"])
        .selectExpr("*", f"coalesce(lead(bin) over {inside}, _next_head) as _next", *held)
        .where("_home = _slice")
    )

    covered = " or ".join(f"(_first_{v} <= bin and _last_{v} >= _next)" for v in spans) or "true"
    reach = f"case when _next is not null and coalesce({covered}, false) then _next - 1 else bin end"
    grid = known.selectExpr("*", f"explode(sequence(bin, {reach})) as _at")
    if spans:
        grid = grid.where(" or ".join(f"(_first_{v} <= _at and _last_{v} >= _at)" for v in spans))

    def filled(v: str) -> str:
        own = f" and _at <= _last_{v}" if v in spans else ""
        return f"case when _at - _since_{v} <= {fill}{own} then _held_{v} end as {v}"

    def newest(k: str) -> str:
        later = "struct(s.known | m.known as known, (s.on & ~m.known) | m.on as on)"
        start = "struct(0L as known, 0L as on)"
        return f"aggregate(_marks_{k}, {start}, (s, m) -> if(_at - m.bin <= {fill}, {later}, s)) as _word_{k}"

    carried = grid.selectExpr(*keys, "_at as bin", *[filled(v) for v in values], *[newest(k) for k, _ in words])
    pairs = [e for k, on in words for e in (f"_word_{k}.known as {k}", f"_word_{k}.on as {on}")]
    return carried.selectExpr(*keys, "bin", *values, *pairs) if words else carried
