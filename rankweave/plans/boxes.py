"""Points in boxes without comparing every point with every box."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions.bitmath import ilog2

#: A box covers at most so many cells and one more in each dimension.
CELLS = 8


def in_boxes(points: DataFrame, boxes: DataFrame, names: str) -> DataFrame:
    """points x boxes where each coordinate lies between the box's corners (``x0 <= x <= x1``, ...).

    Every box is laid on a grid whose cells are powers of two, coarse enough that it covers few of them;
    points carry their cell on each grid that some box uses (at most one for each power of two), and cells
    are joined by equality. Boxes with a corner out of order hold nothing.
    """
    side = F.greatest(*[F.col(f"{n}1") - F.col(f"{n}0") + 1 for n in names])
    sound = F.lit(True)
    for n in names:
        sound = sound & (F.col(f"{n}0") <= F.col(f"{n}1"))
    grid = F.greatest(ilog2(F.greatest(side, F.lit(1))) - (CELLS.bit_length() - 2), F.lit(0)).cast("int")
    laid = boxes.where(sound).withColumn("_g", grid)
    shift = lambda c: F.call_function("shiftright", F.col(c).cast("long"), F.col("_g"))
    cells = laid
    for n in names:
        cells = cells.withColumn(f"_{n}", F.explode(F.sequence(shift(f"{n}0"), shift(f"{n}1"))))
    grids = laid.select("_g").distinct()  # at most 64 rows
    placed = points.join(F.broadcast(grids)).withColumns({f"_{n}": shift(n) for n in names})
    inside = F.lit(True)
    for n in names:
        inside = inside & F.col(n).between(F.col(f"{n}0"), F.col(f"{n}1"))
    keys = ["_g", *(f"_{n}" for n in names)]
    return placed.join(cells, keys).where(inside).drop(*keys)
