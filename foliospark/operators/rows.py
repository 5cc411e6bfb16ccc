"""Boxes to rows of text, and choices among recognition attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_TOLERANCE = 15.0
MOST_ROWS = 60


def grouped_rows(boxes: Column, tolerance: float = ROW_TOLERANCE, most: int = MOST_ROWS) -> Column:
    """Rows (y, text) of an array of (y, x, text): a box joins the row whose first box is near enough.

    The anchor is the row's first box, not the one before, so this is a fold and no
    session window.
    """
    row = "struct<y:double,text:string>"
    start = F.struct(F.array().cast(f"array<{row}>").alias("done"), F.lit(None).cast(row).alias("now"))

    def step(state: Column, box: Column) -> Column:
        now = state["now"]
        near = now.isNotNull() & (F.abs(box["y"] - now["y"]) <= tolerance)
        text = F.when(near, F.concat(now["text"], box["text"])).otherwise(box["text"])
        y = F.when(near, now["y"]).otherwise(box["y"])
        keep = F.when(near | now.isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(now)))
        return F.struct(keep.alias("done"), F.struct(y.alias("y"), text.alias("text")).alias("now"))

    def close(state: Column) -> Column:
        return F.when(state["now"].isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(state["now"])))

    return F.slice(F.aggregate(F.array_sort(boxes), start, step, close), 1, most)


def build_rows(boxes: DataFrame, keys: list[str], tolerance: float = ROW_TOLERANCE, most: int = MOST_ROWS) -> DataFrame:
    """One row a page: keys and ``rows``. boxes: keys, box (array of x, y points), text."""
    top = F.array_min(F.transform("box", lambda p: p["y"]))
    left = F.array_min(F.transform("box", lambda p: p["x"]))
    item = F.struct(top.cast("double").alias("y"), left.cast("double").alias("x"), F.col("text"))
    return boxes.groupBy(*keys).agg(grouped_rows(F.collect_list(item), tolerance, most).alias("rows"))


def row_text(rows: Column, separator: str = "") -> Column:
    return F.array_join(F.transform(rows, lambda r: r["text"]), separator)


def char_count(rows: Column) -> Column:
    return F.aggregate(rows, F.lit(0), lambda n, r: n + F.length(r["text"]))


def has_text(rows: Column, least: int = 1) -> Column:
    return char_count(rows) >= least


def best_attempts(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """The first attempt with a mapping; without one, the first with most text.

    attempts: keys, attempt_ord, mapping, rows, angle. One aggregate, no sort.
    """
    hit = F.col("mapping").isNotNull() & (F.col("mapping") != "")
    value = F.struct("mapping", "rows", "angle")
    rank = F.struct(
        F.when(hit, 0).otherwise(1).alias("miss"),
        F.when(hit, 0).otherwise(-char_count(F.col("rows"))).alias("less"),
        F.col("attempt_ord"),
    )
    return attempts.groupBy(*keys).agg(F.min_by(value, rank).alias("v")).select(*keys, "v.*")


# Regions of a page as fractions (left, top, right, bottom), and the order of angles by orientation.
TOPS = ((0.0, 0.0, 1.0, 0.15), (0.0, 0.0, 1.0, 0.30), (0.0, 0.0, 1.0, 0.50), (0.0, 0.0, 1.0, 1.0))
CORNERS = ((0.6, 0.6, 1.0, 1.0), (0.0, 0.7, 1.0, 1.0), (0.4, 0.4, 1.0, 1.0))
WHOLE = TOPS[-1]
ANGLES = {0: (0, 90, 270, 180), 90: (90, 270, 0, 180)}

Region = tuple[float, float, float, float]


def attempt_order(drawing: bool = False, orientation: int = 0) -> list[tuple[int, int, Region]]:
    """(order, angle, region) of the recognition ladder of a page."""
    regions = TOPS + (CORNERS if drawing else ())
    return [(i, a, c) for i, (a, c) in enumerate((a, c) for a in ANGLES[orientation] for c in regions)]


def rows_of(boxes: list[tuple[float, float, str]], tolerance: float = ROW_TOLERANCE, most: int = MOST_ROWS) -> list[tuple[float, str]]:
    """``grouped_rows`` of one page's boxes (top, left, text), for loops that stop at the first match."""
    done: list[list] = []
    for y, _, text in sorted(boxes):
        if done and abs(y - done[-1][0]) <= tolerance:
            done[-1][1] += text
        else:
            done.append([y, text])
    return [(y, text) for y, text in done[:most]]
