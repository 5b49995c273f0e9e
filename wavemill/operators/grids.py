"""Time-frequency grids in long form: ``frame, row, col, value``.

Window frames over (frame, row) and (frame, col) give centred filters with edges
that shrink; offsets joined or clamped give replicated edges. A window partition
is one line of one frame, so no task holds more than lines.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense(cells: DataFrame, frames: DataFrame, rows: int, cols: int, fill: float = 0.0) -> DataFrame:
    """Every cell of every frame; cells without a value have ``fill``."""
    all_cells = frames.select("frame").distinct().select("frame", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("col"))
    # By frame: lines and columns of a frame are then in one place, and all windows over them need no further shuffle.
    return all_cells.join(cells, ["frame", "row", "col"], "left").fillna(fill, ["value"]).repartition("frame")


def _line(along: str, radius: int) -> Window:
    across = "row" if along == "col" else "col"
    return Window.partitionBy("frame", across).orderBy(along).rowsBetween(-radius, radius)


def box_mean(grid: DataFrame, along: str, radius: int, value: str = "value", out: str = "value") -> DataFrame:
    """Mean of the cells within ``radius`` along one axis; fewer at the edges."""
    return grid.withColumn(out, F.avg(value).over(_line(along, radius)))


def dilate(grid: DataFrame, along: str, radius: int, value: str = "value") -> DataFrame:
    return grid.withColumn(value, F.max(value).over(_line(along, radius)))


def erode(grid: DataFrame, along: str, radius: int, value: str = "value") -> DataFrame:
    return grid.withColumn(value, F.min(value).over(_line(along, radius)))


def morphology(grid: DataFrame, steps: list[tuple[str, int, int]], value: str = "value") -> DataFrame:
    """Steps of ``("dilate" or "erode", row radius, column radius)`` one after the other. Neighbouring steps of a kind are one with the radii added, at the edges too."""
    merged: list[list] = []
    for kind, r, c in steps:
        if merged and merged[-1][0] == kind:
            merged[-1][1] += r
            merged[-1][2] += c
        else:
            merged.append([kind, r, c])
    for kind, r, c in merged:
        step = dilate if kind == "dilate" else erode
        grid = step(grid, "row", r, value) if r else grid
        grid = step(grid, "col", c, value) if c else grid
    return grid


def opening(rows: int, cols: int) -> list[tuple[str, int, int]]:
    """Erode, then dilate, by a box of odd size."""
    return [("erode", rows // 2, cols // 2), ("dilate", rows // 2, cols // 2)]


def closing(rows: int, cols: int) -> list[tuple[str, int, int]]:
    """Dilate, then erode, by a box of odd size."""
    return opening(rows, cols)[::-1]


def replicated(grid: DataFrame, along: str, radius: int, size: int, value: str, weights: list[float] | None = None) -> Column:
    """Weighted sum over ``radius`` to either side, the edge cell standing in for cells beyond it. One pass: frames of three windows."""
    across = "row" if along == "col" else "col"
    w = Window.partitionBy("frame", across).orderBy(along)
    weights = weights or [1.0] * (2 * radius + 1)
    first, last = (F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    total: Column = F.lit(0.0)
    for k, x in zip(range(-radius, radius + 1), weights, strict=True):
        moved = F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w)
        if k < 0:
            moved = F.coalesce(F.lag(value, -k).over(w), first)
        elif k > 0:
            moved = F.coalesce(F.lead(value, k).over(w), last)
        else:
            moved = F.col(value)
        total = total + moved * F.lit(float(x))
    return total


def gaussian_weights(sigma: float) -> list[float]:
    radius = max(1, math.ceil(max(sigma, 1.0) * 1.5))
    return [math.exp(-(o * o) / (2 * sigma * sigma)) for o in range(-radius, radius + 1)]


def gaussian_smooth(grid: DataFrame, along: str, sigma: float, size: int, value: str, out: str) -> DataFrame:
    """Normalised Gaussian smoothing with replicated edges."""
    ws = gaussian_weights(sigma)
    return grid.withColumn(out, replicated(grid, along, len(ws) // 2, size, value, ws) / sum(ws))


def persistent(grid: DataFrame, along: str, radius: int, least: int, size: int, mask: str, out: str) -> DataFrame:
    """Set cells with at least ``least`` set cells around them along one axis; edge cells count once per place they stand in for."""
    m = grid.withColumn("_m", F.col(mask).cast("double"))
    return m.withColumn(out, F.col(mask) & (replicated(m, along, radius, size, "_m") >= least)).drop("_m")


def majority3(grid: DataFrame, rows: int, cols: int, mask: str, out: str) -> DataFrame:
    """3 x 3 majority with replicated edges; five of nine cells are enough."""
    g = grid.withColumn("_m", F.col(mask).cast("double"))
    g = g.withColumn("_h", replicated(g, "col", 1, cols, "_m"))
    return g.withColumn(out, replicated(g, "row", 1, rows, "_h") >= 5).drop("_m", "_h")


def block_edges(i: Column, size: int, blocks: int) -> Column:
    """The block an index lies in when ``size`` cells are cut at ``floor(k * size / blocks)``."""
    return F.floor(((i + 1) * blocks - 1) / F.lit(size)).cast("int")


def downsample(grid: DataFrame, rows: int, cols: int, to_rows: int, to_cols: int, how: str = "avg", value: str = "value") -> DataFrame:
    """Block reduction to a smaller grid."""
    g = grid.select("frame", block_edges(F.col("row"), rows, to_rows).alias("row"), block_edges(F.col("col"), cols, to_cols).alias("col"), value)
    return g.groupBy("frame", "row", "col").agg(getattr(F, how)(value).alias(value))


def preview(grid: DataFrame, value: str = "value") -> DataFrame:
    """0..255 by each frame's least and most, cut off; a flat frame is 0."""
    span = grid.groupBy("frame").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    unit = F.coalesce((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(0.0))
    return grid.join(span, "frame").select("frame", "row", "col", F.least(F.greatest(unit * 255, F.lit(0.0)), F.lit(255.0)).cast("int").alias("pixel"))


def pixelate(grid: DataFrame, size: int, value: str = "value") -> DataFrame:
    """Every cell gets the mean of its block; edge blocks are padded with 0, so they darken. Cut off to whole numbers."""
    b = [F.floor(F.col(c) / size) for c in ("row", "col")]
    w = Window.partitionBy("frame", *b)
    return grid.select("frame", "row", "col", F.floor(F.sum(value).over(w) / (size * size)).cast("int").alias("pixel"))


def resample(grid: DataFrame, rows: int, cols: int, to_rows: int, to_cols: int, value: str = "value") -> DataFrame:
    """Per axis: maximum over adaptive windows where the grid shrinks, nearest cell where it grows."""

    def targets(i: Column, size: int, to: int) -> Column:
        if to <= size:  # windows [floor(k * size / to), ceil((k + 1) * size / to)) may share an edge cell
            low, high = F.floor(i * to / F.lit(size)), F.ceil((i + 1) * to / F.lit(size)) - 1
            return F.sequence(low.cast("int"), F.least(high, F.lit(to - 1)).cast("int"))
        low, high = F.ceil(i * to / F.lit(size)), F.ceil((i + 1) * to / F.lit(size)) - 1
        return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))

    g = grid.select("frame", F.explode(targets(F.col("row"), rows, to_rows)).alias("row"), "col", value)
    g = g.select("frame", "row", F.explode(targets(F.col("col"), cols, to_cols)).alias("col"), value)
    return g.groupBy("frame", "row", "col").agg(F.max(value).alias(value))


def cropped(grid: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """The cells of half-open ranges of rows and columns, counted from the range's start."""
    inside = (F.col("row") >= rows[0]) & (F.col("row") < rows[1]) & (F.col("col") >= cols[0]) & (F.col("col") < cols[1])
    return grid.where(inside).withColumn("row", (F.col("row") - rows[0]).cast("int")).withColumn("col", (F.col("col") - cols[0]).cast("int"))


def heat(grid: DataFrame, low: float, high: float, value: str = "value") -> DataFrame:
    """Values between ``low`` and ``high`` as colours from blue over green to red: ``frame, row, col, red, green, blue``, each 0..255; values beyond have the colours of the ends, a null or NaN one has null."""
    v = F.col(value).cast("double")
    t = F.when(v.isNotNull() & ~F.isnan(v), F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0)))
    part = lambda middle: F.floor(F.when(t.isNotNull(), F.least(F.greatest(1.5 - F.abs(4 * t - middle), F.lit(0.0)), F.lit(1.0))) * 255).cast("int")
    return grid.select("frame", "row", "col", part(3).alias("red"), part(2).alias("green"), part(1).alias("blue"))


def equalised(grid: DataFrame, rows: int, cols: int, tiles: tuple[int, int], clip: float = 2.0, levels: int = 256, value: str = "value") -> DataFrame:
    """Contrast-limited adaptive equalisation: ``frame, row, col, pixel``.

    Per tile a histogram of the levels, of which none may hold more than ``clip``
    times an even share (at least 1); what is over goes to all levels evenly, the
    rest of that to every n-th one. Its running sum, scaled to the levels, maps a
    tile's cells; between tile centres the four nearest maps are mixed linearly.
    Values are cut to 0..``levels`` - 1 first, nulls count as 0. Rows and columns
    are multiples of the tiles; every cell must be there.
    """
    down, across = tiles
    if rows % down or cols % across:
        raise ValueError("tiles must divide the grid")
    height, width = rows // down, cols // across
    area = height * width
    limit = max(1, int(clip * area / levels))
    g = grid.select("frame", "row", "col", F.least(F.greatest(F.coalesce(F.floor(value), F.lit(0)), F.lit(0)), F.lit(levels - 1)).cast("int").alias("_v"))
    tile = F.floor(F.col("row") / height) * across + F.floor(F.col("col") / width)
    histogram = g.groupBy("frame", tile.cast("int").alias("tile"), "_v").agg(F.count(F.lit(1)).alias("n"))
    # A tile has at most as many levels as cells, a frame as many maps as tiles.
    by = histogram.groupBy("frame", "tile").agg(F.map_from_entries(F.collect_list(F.struct("_v", F.least("n", F.lit(limit)).alias("n")))).alias("n"), F.sum(F.greatest(F.col("n") - limit, F.lit(0))).alias("over"))
    rest = F.col("over") % levels
    step = F.greatest(F.floor(levels / F.nullif(rest, F.lit(0))), F.lit(1))

    def mapped(done: Column, v: Column) -> Column:
        upto = done["sum"] + F.coalesce(F.try_element_at("n", v), F.lit(0))
        even = F.floor(F.col("over") / levels) * (v + 1) + F.coalesce(F.least(rest, F.floor(v / step) + 1), F.lit(0))
        level = F.least(F.rint((upto + even) * F.lit((levels - 1) / area)), F.lit(float(levels - 1)))
        return F.struct(upto.alias("sum"), F.concat(done["map"], F.array(level)).alias("map"))

    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<double>").alias("map"))
    by = by.select("frame", F.struct("tile", F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, mapped, lambda d: d["map"]).alias("map")).alias("entry"))
    maps = by.groupBy("frame").agg(F.map_from_entries(F.collect_list("entry")).alias("_maps"))

    def near(i: str, size: int, n: int) -> tuple[Column, Column, Column]:
        at = F.col(i) / size - 0.5
        return F.greatest(F.floor(at), F.lit(0)).cast("int"), F.least(F.floor(at) + 1, F.lit(n - 1)).cast("int"), at - F.floor(at)

    (top, bottom, y), (left, right, x) = near("row", height, down), near("col", width, across)
    get = lambda r, c: F.element_at(F.element_at("_maps", (r * across + c).cast("int")), F.col("_v") + 1)
    mixed = (get(top, left) * (1 - x) + get(top, right) * x) * (1 - y) + (get(bottom, left) * (1 - x) + get(bottom, right) * x) * y
    return g.join(maps, "frame").select("frame", "row", "col", F.rint(mixed).cast("int").alias("pixel"))


def undistorted(grid: DataFrame, rows: int, cols: int, focal: float, k1: float, k2: float, value: str = "value") -> DataFrame:
    """Lens distortion taken out: ``frame, row, col, value``.

    A cell at distance r (in ``focal`` lengths) from the middle gets the value
    at r (1 + k1 r^2 + k2 r^4) in its direction, mixed from the four cells
    around that place; cells outside the grid, and nulls, count as 0. Every cell must
    be there. The table of places has a grid's size.
    """
    spark = grid.sparkSession
    cy, cx = (rows - 1) / 2, (cols - 1) / 2
    cells = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("to_row"), (F.col("id") % cols).cast("int").alias("to_col"))
    y, x = (F.col("to_row") - cy) / focal, (F.col("to_col") - cx) / focal
    r2 = x * x + y * y
    grow = 1 + k1 * r2 + k2 * r2 * r2
    places = cells.select("to_row", "to_col", (y * grow * focal + cy).alias("y"), (x * grow * focal + cx).alias("x"))
    corner = F.array(*[F.struct((F.floor("y") + a).cast("int").alias("row"), (F.floor("x") + b).cast("int").alias("col"), ((1 - F.abs(F.col("y") - F.floor("y") - a)) * (1 - F.abs(F.col("x") - F.floor("x") - b))).alias("w")) for a in (0, 1) for b in (0, 1)])
    places = places.select("to_row", "to_col", F.inline(corner))
    from wavemill.session import small_side

    seen = grid.select("frame", "row", "col", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_x")).join(small_side(places, 4_000_000), ["row", "col"])
    got = seen.groupBy("frame", "to_row", "to_col").agg(F.sum(F.col("w") * F.col("_x")).alias("_s"))
    every = grid.select("frame", "row", "col").join(got.select("frame", F.col("to_row").alias("row"), F.col("to_col").alias("col"), "_s"), ["frame", "row", "col"], "left")
    return every.select("frame", "row", "col", F.coalesce("_s", F.lit(0.0)).alias("value"))


def rings(grid: DataFrame, rows: int, cols: int, value: str = "value") -> DataFrame:
    """Mean per distance from the edge: ``frame, ring, n, mean``."""
    ring = F.least(F.col("row"), F.lit(rows - 1) - F.col("row"), F.col("col"), F.lit(cols - 1) - F.col("col"))
    return grid.groupBy("frame", ring.alias("ring")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def cfar(grid: DataFrame, rows: int, cols: int, guard: tuple[int, int], train: tuple[int, int], rate: float, value: str = "value") -> DataFrame:
    """Cell-averaging detection: ``hit`` where a cell exceeds ``n * (rate ** (-1 / n) - 1)`` times the mean of its training cells, the box ``train`` without the box ``guard``. Every cell of the grid must be there."""

    def total(g: DataFrame, r: int, c: int, name: str) -> DataFrame:
        return g.withColumn("_x", F.sum(value).over(_line("col", c))).withColumn(name, F.sum("_x").over(_line("row", r))).drop("_x")

    def cells(r: int, c: int) -> Column:
        """How many cells of the box are on the grid."""
        side = lambda i, radius, size: F.least(F.col(i) + radius, F.lit(size - 1)) - F.greatest(F.col(i) - radius, F.lit(0)) + 1
        return side("row", r, rows) * side("col", c, cols)

    g = total(total(grid, *train, "_st"), *guard, "_sg").withColumn("_n", (cells(*train) - cells(*guard)).cast("double"))
    n = F.col("_n")
    alpha = n * (F.pow(F.lit(rate), F.lit(-1.0) / n) - 1)
    return g.withColumn("hit", (n > 0) & (F.col(value) > alpha * ((F.col("_st") - F.col("_sg")) / n))).drop("_st", "_sg", "_n")


def runs(mask: DataFrame, along: str = "col") -> DataFrame:
    """Maximal runs of set cells along one axis: ``frame, line, start, stop`` (inclusive), by gaps and islands."""
    line = "row" if along == "col" else "col"
    w = Window.partitionBy("frame", line).orderBy(along)
    g = mask.select("frame", line, along, (F.col(along) - F.row_number().over(w)).alias("_g"))
    return g.groupBy("frame", line, "_g").agg(F.min(along).alias("start"), F.max(along).alias("stop")).select("frame", F.col(line).alias("line"), "start", "stop")


def _labelled_runs(mask: DataFrame) -> DataFrame:
    """``frame, line, start, stop, label``: runs of set cells, each with the least run of its component.

    Runs of neighbouring rows that share a column are joined; the least run of
    each component is found by passing minima along the joints until nothing
    changes. All frames go on at once; a diagonal alone doesn't connect.
    """
    from wavemill.session import written

    r = written(runs(mask).withColumn("id", F.shiftleft(F.col("line").cast("long"), 32) + F.col("start")), "runs")
    a, b = r.alias("a"), r.alias("b")
    touch = (F.col("a.frame") == F.col("b.frame")) & (F.col("a.line") + 1 == F.col("b.line")) & (F.col("a.start") <= F.col("b.stop")) & (F.col("b.start") <= F.col("a.stop"))
    down = a.join(b, touch).select(F.col("a.frame").alias("frame"), F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    edges = written(down.unionByName(down.select("frame", F.col("y").alias("x"), F.col("x").alias("y"))), "joints")
    labels = r.select("frame", "id", F.col("id").alias("label"))
    while True:
        heard = edges.join(labels.select("frame", F.col("id").alias("y"), "label"), ["frame", "y"]).groupBy("frame", F.col("x").alias("id")).agg(F.min("label").alias("heard"))
        new = labels.join(heard, ["frame", "id"], "left").select("frame", "id", "label", F.least("label", "heard").alias("new"))
        jump = new.select("frame", F.col("id").alias("new"), F.col("new").alias("further"))
        new = written(new.join(jump, ["frame", "new"]).select("frame", "id", "label", F.least("new", "further").alias("new")), "labels")
        done = new.where("new <> label").isEmpty()
        labels = new.select("frame", "id", F.col("new").alias("label"))
        if done:
            break
    return r.join(labels, ["frame", "id"]).drop("id")


def label_components(mask: DataFrame, min_pixels: int = 1) -> DataFrame:
    """4-connected components of set cells: ``frame, component, row0, row1, col0, col1`` (inclusive), ``pixel_count``; those of fewer than ``min_pixels`` are left out.

    ``component`` numbers a frame's components by their first cell.
    """
    boxes = _labelled_runs(mask).groupBy("frame", "label").agg(
        F.min("line").alias("row0"), F.max("line").alias("row1"), F.min("start").alias("col0"), F.max("stop").alias("col1"), F.sum(F.col("stop") - F.col("start") + 1).alias("pixel_count")
    )
    boxes = boxes.where(F.col("pixel_count") >= min_pixels)
    return boxes.withColumn("component", F.row_number().over(Window.partitionBy("frame").orderBy("label"))).drop("label")


def label_map(mask: DataFrame, rows: tuple[int, int] | None = None) -> DataFrame:
    """The component of every set cell: ``frame, row, col, component``, numbered as by :func:`label_components`. Only rows from the first to before the second of ``rows`` count, if given."""
    m = mask.where((F.col("row") >= rows[0]) & (F.col("row") < rows[1])) if rows else mask
    r = _labelled_runs(m).withColumn("component", F.dense_rank().over(Window.partitionBy("frame").orderBy("label")))
    return r.select("frame", F.col("line").alias("row"), F.explode(F.sequence("start", "stop")).alias("col"), "component")
