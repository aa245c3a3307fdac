"""Points (x, y, id): which ids lie in boxes, where given ids lie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions.zorder import encode2
from rankweave.plans.boxes import in_boxes


def ids_in_box(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """``(box, id, cnt)``: ids with points in each of ``boxes(box, x0, x1, y0, y1)``, corners included."""
    return in_boxes(points, boxes, "xy").groupBy("box", "id").agg(F.count("*").alias("cnt"))


def cells_of_ids(points: DataFrame, ids: DataFrame, ignore_bits: int = 0) -> DataFrame:
    """``(code, cnt)``: points of the wanted ids per Morton cell."""
    return cells(points.join(ids.select("id").distinct(), "id", "left_semi"), ignore_bits)


def cells(points: DataFrame, ignore_bits: int = 0) -> DataFrame:
    """``(code, cnt)``: points per Morton cell; ignore_bits merges cells."""
    code = encode2(F.col("x"), F.col("y"))
    return points.groupBy(F.shiftleft(F.shiftright(code, ignore_bits), ignore_bits).alias("code")).agg(F.count("*").alias("cnt"))
