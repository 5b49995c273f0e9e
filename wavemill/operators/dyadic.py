"""Union and complement of integer intervals by canonical dyadic blocks.

A half-open interval is cut into canonical blocks ``[i * 2**k, (i + 1) * 2**k)``,
kept by tier: those below ``2**cell_bits`` belong to the cell of that many
positions they lie in, larger ones to a wide cell of ``WIDE_BITS`` bits more,
and so on, so that an interval becomes a few pieces however long it is. Inside a
cell blocks under an ancestor go, pairs of siblings become their parent, level
by level, and adjacent blocks are put together. The union is associative, so the
same step runs before the shuffle, which leaves of a crowded cell at most what
can lie in it, and after it. Then the cells that a wider block covers go.

No task gets more than one cell of an entity at once, and the windows that join
runs across cells see at most a few rows per cell, however many intervals an
entity has: there are ``extent / 2**cell_bits`` cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavemill.session import written

CELL_BITS, WIDE_BITS = 20, 10


def dyadic_union(group: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per group the disjoint, untouching runs that cover the union of ``[low, high)``, each within ``[0, 2**bits)``."""
    stride = 2 << bits
    starts, levels = [], []
    for level in range(bits + 1):
        left, right = (low + (1 << level) - 1) >> level, high >> level
        take = (left < right) & (left & 1 == 1)
        starts.append(group[take] * stride + (left[take] << level))
        levels.append(np.full(int(take.sum()), level, np.int64))
        left = left + take
        take = (left < right) & (right & 1 == 1)
        starts.append(group[take] * stride + ((right[take] - 1) << level))
        levels.append(np.full(int(take.sum()), level, np.int64))
    start, level = np.concatenate(starts), np.concatenate(levels)
    if not len(start):
        return start, start, start
    order = np.lexsort((-level, start))
    start, level = start[order], level[order]
    reach = np.maximum.accumulate(start + (1 << level))
    alone = np.r_[True, start[1:] >= reach[:-1]]  # not under an ancestor, not a repeat
    start, level = start[alone], level[alone]
    kept, raised = [], np.empty(0, np.int64)
    for k in range(bits + 1):
        at = np.sort(np.r_[start[level == k], raised])
        pair = np.zeros(len(at), bool)
        if k < bits and len(at) > 1:
            pair[:-1] = (at[:-1] >> k & 1 == 0) & (at[1:] == at[:-1] + (1 << k))
        raised = at[pair]
        single = ~(pair | np.r_[False, pair[:-1]]) if len(at) else pair
        kept.append((at[single], np.full(int(single.sum()), 1 << k, np.int64)))
    start, length = (np.concatenate(x) for x in zip(*kept, strict=True))
    order = np.argsort(start)
    start, stop = start[order], (start + length)[order]
    new = np.r_[True, start[1:] != stop[:-1]]
    last = np.r_[new[1:], True]
    first, stop = start[new], stop[last]
    return first // stride, first % stride, stop - first // stride * stride


def group_ids(columns: list[pa.ChunkedArray | pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's combination of values, and the first row of each number."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        own = c.dictionary_encode(null_encoding="encode")
        if isinstance(own, pa.ChunkedArray):
            own = own.combine_chunks()
        code = np.unique(code * max(1, len(own.dictionary)) + own.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)[1]
    _, first, ids = np.unique(code, return_index=True, return_inverse=True)
    return ids.astype(np.int64), first


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables that never part a group, from batches sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        same = np.ones(t.num_rows, bool)
        for k in keys:
            c = t[k].combine_chunks()
            last = c[len(c) - 1]
            same &= (pc.equal(c, last) if last.is_valid else pc.is_null(c)).fill_null(False).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut).combine_chunks().to_batches()
        n = t.num_rows - cut
        rows = max(rows, 2 * n)
    if held:
        yield pa.Table.from_batches(held)


def _tiers(low: np.ndarray, high: np.ndarray, bits: int) -> list[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """Intervals as pieces that lie in one cell each: (row, tier, first and last+1 unit). A tier's units are the cells of the one below it."""
    row, tier, width, out = np.arange(len(low)), 0, bits, []
    while len(row):
        a, b = low >> width, (high - 1) >> width  # the cells of the first and the last unit
        one = a == b
        out.append((row[one], tier, low[one], high[one]))
        row, low, high, a, b = (x[~one] for x in (row, low, high, a, b))
        head, tail = (a + 1) << width, b << width
        out += [(row[low < head], tier, low[low < head], head[low < head]), (row[tail < high], tier, tail[tail < high], high[tail < high])]
        low, high = a + 1, b  # whole cells between them
        row, low, high = (x[a + 1 < b] for x in (row, low, high))
        tier, width = tier + 1, WIDE_BITS
    return out


def _cover(keys: list[str], bits: int, schema: pa.Schema, grouped: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def union(t: pa.Table, row: np.ndarray, tier: int, low: np.ndarray, high: np.ndarray, entity: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(row):
            return
        width = WIDE_BITS if tier else bits
        cell = low >> width
        _, first, ids = np.unique(entity[row] * (int(cell.max()) + 1) + cell, return_index=True, return_inverse=True)
        at = cell << width
        g, lo, hi = dyadic_union(ids.astype(np.int64), low - at, high - at, width)
        rows, base = row[first][g], cell[first][g]
        out = [t[k].combine_chunks().take(pa.array(rows)) for k in keys]
        yield pa.RecordBatch.from_arrays([*out, pa.array(np.full(len(rows), tier, np.int32)), pa.array(base), pa.array((base << width) + lo), pa.array((base << width) + hi)], schema=schema)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if grouped:
            for t in whole_groups(source, [*keys, "_tier", "_cell"]):
                entity, _ = group_ids([t[k] for k in keys])
                tiers, low, high = (t[c].to_numpy() for c in ("_tier", "_low", "_high"))
                for tier in np.unique(tiers):
                    row = np.flatnonzero(tiers == tier)
                    yield from union(t, row, int(tier), low[row], high[row], entity)
            return
        for b in source:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            entity, _ = group_ids([t[k] for k in keys])
            pieces = _tiers(*(t[c].to_numpy() for c in ("_low", "_high")), bits)
            for tier in sorted({p[1] for p in pieces}):
                own = [p for p in pieces if p[1] == tier]
                yield from union(t, *(np.concatenate([p[0] for p in own]), tier, np.concatenate([p[2] for p in own]), np.concatenate([p[3] for p in own]), entity))

    return batches


def busy_and_gaps(
    df: DataFrame, keys: list[str], start: Column | str, stop: Column | str, extent: Column | str, cell_bits: int = CELL_BITS
) -> DataFrame:
    """Continuous covered ('busy') and uncovered ('gap') stretches of ``[0, extent)`` per entity.

    ``df`` has one interval ``[start, stop)`` a row; touching, overlapping and
    nested ones come out as one busy stretch. Result: ``keys``, ``seg_kind``,
    ``seg_start``, ``seg_stop``. ``extent`` must be one value per entity.

    Intervals are cut to ``[0, extent)``. Rows with a null key, bound or extent
    and intervals of which nothing remains are left out; an entity without any
    remaining interval has no rows. Repeated rows change nothing; other columns
    of ``df`` are ignored, whatever their names.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    names = [f"_key{i}" for i in range(len(keys))]
    low = F.greatest(as_col(start).cast("long"), F.lit(0).cast("long"))
    rows = df.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)],
        as_col(extent).cast("long").alias("_extent"),
        F.when(as_col(start).isNotNull(), low).alias("_low"),
        F.when(as_col(stop).isNotNull(), F.least(as_col(stop).cast("long"), as_col(extent).cast("long"))).alias("_high"),
    ).where(F.col("_low") < F.col("_high"))
    rows = rows.dropna(subset=[*names, "_extent"])
    carried = [*names, "_extent"]
    longs = [T.StructField(c, T.LongType()) for c in ("_cell", "_low", "_high")]
    schema = T.StructType([*(rows.schema[c] for c in carried), T.StructField("_tier", T.IntegerType()), *longs])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    cut = rows.mapInArrow(_cover(carried, cell_bits, arrow, False), schema)
    cut = cut.repartition(*names, "_tier", "_cell").sortWithinPartitions(*carried, "_tier", "_cell")
    runs = cut.mapInArrow(_cover(carried, cell_bits, arrow, True), schema)

    # In positions again. Runs inside a cell stay by themselves; those that touch a border of their cell, and wide ones, can go on.
    scale = F.when(F.col("_tier") == 0, 0).otherwise(cell_bits + (F.col("_tier") - 1) * WIDE_BITS)
    edge = (F.col("_tier") > 0) | (F.col("_low") == F.shiftleft("_cell", cell_bits)) | (F.col("_high") == F.shiftleft(F.col("_cell") + 1, cell_bits))
    runs = runs.withColumns({"_edge": edge, "_low": F.call_function("shiftleft", "_low", scale), "_high": F.call_function("shiftleft", "_high", scale)})
    runs = written(runs.select(*carried, "_edge", F.when(~edge, F.col("_cell")).alias("_cell"), "_low", "_high"), "runs")
    # Joined in order of their start, with one row for each cell that has runs inside it, which tells if a wider block covers it.
    inner = runs.where("not _edge")
    cells = inner.groupBy(*carried, "_cell").agg(F.min("_low").alias("_low"), F.min("_low").alias("_high"))
    w = Window.partitionBy(*carried).orderBy("_low", F.col("_cell").asc_nulls_first())
    lined = runs.where("_edge").select(*carried, F.lit(None).cast("long").alias("_cell"), "_low", "_high").unionByName(cells.select(*carried, "_cell", "_low", "_high"))
    lined = lined.withColumn("_reach", F.max(F.when(F.col("_cell").isNull(), F.col("_high"))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    lined = lined.withColumn("_new", F.when(F.col("_cell").isNull() & (F.col("_low") > F.coalesce("_reach", F.lit(-1))), 1).otherwise(0))
    lined = written(lined.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))), "lined")
    joined = lined.where("_cell is null").groupBy(*carried, "_run").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high")).drop("_run")
    covered = lined.where("_cell is not null and _reach > _low").select(*carried, "_cell")
    alone = inner.join(covered, [*carried, "_cell"], "left_anti").select(*carried, "_low", "_high")
    busy = written(joined.unionByName(alone), "busy")

    cell = F.shiftright("_low", cell_bits).alias("_cell")
    inner = Window.partitionBy(*carried, "_cell").orderBy("_low")
    inside = busy.select(*carried, cell, "_low", "_high").select(*carried, F.lag("_high").over(inner).alias("_a"), F.col("_low").alias("_b"))
    outer = Window.partitionBy(*carried).orderBy("_cell")
    ends = busy.groupBy(*carried, cell).agg(F.min("_low").alias("_first"), F.max("_high").alias("_last"))
    across = ends.select(
        *carried,
        F.array(
            F.struct(F.lag("_last", 1, 0).over(outer).alias("_a"), F.col("_first").alias("_b")),
            F.struct(F.when(F.lead("_first").over(outer).isNull(), F.col("_last")).alias("_a"), F.col("_extent").alias("_b")),
        ).alias("_s"),
    ).select(*carried, F.inline("_s"))
    gaps = inside.unionByName(across).where(F.col("_a") < F.col("_b"))
    out = lambda d, kind, a, b: d.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], F.lit(kind).alias("seg_kind"), F.col(a).alias("seg_start"), F.col(b).alias("seg_stop"))
    return out(busy, "busy", "_low", "_high").unionByName(out(gaps, "gap", "_a", "_b"))
