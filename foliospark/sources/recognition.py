"""Page recognition as a pluggable provider.

The engine starts at tables of text boxes. A provider turns a region of a page into boxes
and is made once in each Python worker; without one, the plan fails with a clear message.
A file that can't be read, or whose recognition fails, gives one row with its error; the
others go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.config import Config
from foliospark.operators import rules as R
from foliospark.operators.rows import ANGLES, CORNERS, MOST_ROWS, ROW_TOLERANCE, TOPS, WHOLE, Region, grouped_rows, rows_of

Boxes = list[tuple[float, float, str]]
BOXES = "pdf_id string, page int, angle int, boxes array<struct<y:double,x:double,text:string>>, error string"
CLASSES = "pdf_id string, page int, mapping string, angle int, boxes array<struct<y:double,x:double,text:string>>, error string"
_BOX = pa.list_(pa.struct([("y", pa.float64()), ("x", pa.float64()), ("text", pa.string())]))


class Provider(Protocol):
    def pages(self, content: bytes, first_only: bool) -> int:
        """Number of pages to recognise."""

    def recognise(self, content: bytes, page: int, angle: int, region: Region) -> Boxes:
        """Boxes (top, left, text) in a region of a page turned by ``angle``; none without text."""

    def orientation(self, content: bytes, page: int) -> int:
        """0 if text runs across, 90 if upright."""


class NoProvider(RuntimeError):
    """Not an error of a file."""


class MissingProvider:
    """Stands in where no recognition library is installed."""

    def pages(self, content: bytes, first_only: bool) -> int:
        raise NoProvider("no page recognition provider: pass a factory that makes one")

    recognise = orientation = pages


_MADE: dict[Callable, Provider] = {}


def engine(factory: Callable[[], Provider]) -> Provider:
    """The worker's one engine for a factory."""
    if factory not in _MADE:
        _MADE[factory] = factory()
    return _MADE[factory]


def _structs(boxes: Boxes) -> list[dict]:
    return [{"y": float(y), "x": float(x), "text": t} for y, x, t in boxes]


def _each_page(files: DataFrame, factory: Callable[[], Provider], first_only: bool, schema: str, page_of: Callable) -> DataFrame:
    """Rows (path, page, *page_of(reader, content, page), no error) of every page; one with the error of a file that fails."""
    kinds = {"string": pa.string(), "int": pa.int32()}
    fields = [x.split(" ", 1) for x in schema.split(", ")]
    target = pa.schema([(n, kinds.get(t, _BOX)) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = engine(factory)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out = [(path, page, *page_of(reader, content, page), None) for page in range(reader.pages(content, first_only))]
                except NoProvider:
                    raise
                except Exception as e:
                    out = [(path, *[None] * (len(fields) - 2), str(e) or type(e).__name__)]
                columns = list(zip(*out, strict=True)) or [()] * len(fields)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return files.select("path", "content").mapInArrow(run, schema)


def recognise(
    files: DataFrame, factory: Callable[[], Provider] = MissingProvider, first_only: bool = False, angles: tuple[int, ...] = ANGLES[0], prescan: bool = True
) -> DataFrame:
    """Boxes of every whole page (path, content), by the first angle that shows text.

    ``prescan``: a page without text at the first angle counts as blank, one call instead of many.
    """

    def page_of(reader: Provider, content: bytes, page: int) -> tuple[int, list[dict]]:
        for angle in angles[:1] if prescan else angles:
            if boxes := reader.recognise(content, page, angle, WHOLE):
                return angle, _structs(boxes)
        return angles[0], []

    return _each_page(files, factory, first_only, BOXES, page_of)


def classify(
    files: DataFrame,
    rules: DataFrame,
    factory: Callable[[], Provider] = MissingProvider,
    config: Config | None = None,
    first_only: bool = False,
    drawing: bool = True,
    prescan: bool = True,
) -> DataFrame:
    """mapping, angle and boxes of every page (path, content), by the recognition ladder.

    Angles by orientation; at each, ever larger tops of the page (as long as they show text) and then its
    corners. The first region whose rows match a rule decides; a match in a part of the top is followed by
    one reading of the whole page, whose rows names are taken from. Without a match the region with most text
    stands. No call is made after the decision.
    """
    config = config or Config()
    judge = R.matcher(R.prepare(rules, config), config)
    corners = CORNERS if drawing else ()

    def page_of(reader: Provider, content: bytes, page: int) -> tuple[str | None, int, list[dict]]:
        if prescan and not reader.recognise(content, page, 0, WHOLE):
            return None, 0, []
        fullest: tuple[int, int, Boxes] = (0, 0, [])
        for angle in ANGLES[reader.orientation(content, page)]:
            silent = False
            for region in (*TOPS, *corners):
                if silent and region in TOPS:
                    continue
                boxes = reader.recognise(content, page, angle, region)
                letters = sum(len(t) for _, _, t in boxes)
                silent = silent or not letters
                if letters > fullest[0]:
                    fullest = letters, angle, boxes
                mapping = judge("\n".join(t for _, t in rows_of(boxes))) if letters else None
                if mapping:
                    if region in TOPS and region != WHOLE:
                        boxes = reader.recognise(content, page, angle, WHOLE) or boxes
                    return mapping, angle, _structs(boxes)
        return None, fullest[1], _structs(fullest[2])

    return _each_page(files, factory, first_only, CLASSES, page_of)


def page_rows(boxes: DataFrame, tolerance: float = ROW_TOLERANCE, most: int = MOST_ROWS) -> DataFrame:
    """pdf_id, page, angle, rows of the pages that were read, and mapping where there is one."""
    kept = boxes.filter("error IS NULL")
    own = ["pdf_id", "page", *[c for c in ("mapping",) if c in boxes.columns], "angle"]
    return kept.select(*own, grouped_rows(F.col("boxes"), tolerance, most).alias("rows"))


def orientation(gray: np.ndarray) -> int:
    """0 if the middle of a page has its text across, 90 if upright: the direction in which ink varies more."""
    h, w = gray.shape
    part = gray[int(h * 0.3) : int(h * 0.7), int(w * 0.3) : int(w * 0.7)]
    if not part.size:
        return 0
    ink = part < part.mean()
    return 0 if ink.sum(axis=1).var() >= ink.sum(axis=0).var() else 90
