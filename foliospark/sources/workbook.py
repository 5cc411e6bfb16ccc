"""Workbooks (.xlsx) as cells, read with the standard library, and header sniffing on top.

``xlsx_cells`` is a data source of (sheet, sheet_ord, row, col, value); what a table is
gets decided by DataFrame operations: the first row of a sheet's first ten that holds all
wanted headers names its columns.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foliospark.operators.rules import DEFAULT_RULES

HEADER_ROWS = 10
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx_cells"

    def schema(self) -> str:
        return "sheet string, sheet_ord int, row int, col int, value string"

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader(self.options["path"], int(self.options.get("maxrows", 0)))


class SheetPartition(InputPartition):
    def __init__(self, order: int, name: str, member: str) -> None:
        self.order, self.sheet, self.member = order, name, member


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, most: int) -> None:
        self.path, self.most = path.removeprefix("file://").removeprefix("file:"), most

    def partitions(self) -> list[InputPartition]:
        with zipfile.ZipFile(self.path) as z:
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
            found = []
            for i, s in enumerate(sheets):
                target = targets[s.get(f"{LINKS}id")].lstrip("/")
                found.append(SheetPartition(i, s.get("name"), target if target.startswith("xl/") else f"xl/{target}"))
            return found

    def read(self, partition: SheetPartition) -> Iterator[tuple]:
        with zipfile.ZipFile(self.path) as z:
            shared = []
            if "xl/sharedStrings.xml" in z.namelist():
                items = ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")
                shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in items]
            with z.open(partition.member) as f:
                for _, node in ElementTree.iterparse(f):
                    if node.tag != f"{MAIN}c":
                        continue
                    letters, number = re.fullmatch(r"([A-Z]+)(\d+)", node.get("r")).groups()
                    row = int(number)
                    if self.most and row > self.most:
                        return
                    if (value := _value(node, shared)) is not None:
                        yield partition.sheet, partition.order, row, _column(letters), value
                    node.clear()


def _column(letters: str) -> int:
    number = 0
    for c in letters:
        number = number * 26 + ord(c) - 64
    return number


def _value(cell, shared: list[str]) -> str | None:
    if cell.get("t") == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    v = cell.find(f"{MAIN}v")
    if v is None or v.text is None:
        return None
    return shared[int(v.text)] if cell.get("t") == "s" else v.text


def cells(spark: SparkSession, path: str, most_rows: int = 0) -> DataFrame:
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("xlsx_cells").option("maxrows", most_rows).load(path)


def sniffed(found: DataFrame, headers: list[str]) -> DataFrame:
    """sheet_ord, row and one column a header, for the sheets that have them all in one of the first rows."""
    wanted = found.filter((F.col("row") <= HEADER_ROWS) & F.trim("value").isin(headers))
    at = wanted.groupBy("sheet_ord", F.col("row").alias("header_row")).agg(
        *[F.min(F.when(F.trim("value") == h, F.col("col"))).alias(f"c{i}") for i, h in enumerate(headers)]
    )
    for i in range(len(headers)):
        at = at.filter(f"c{i} IS NOT NULL")
    fields = [f"c{i}" for i in range(len(headers))]
    first = at.groupBy("sheet_ord").agg(F.min(F.struct("header_row", *fields)).alias("h")).select("sheet_ord", "h.*")
    joined = found.join(F.broadcast(first), "sheet_ord").filter("row > header_row")  # one row a sheet
    return joined.groupBy("sheet_ord", "row").agg(
        *[F.max(F.when(F.col("col") == F.col(f"c{i}"), F.trim("value"))).alias(h) for i, h in enumerate(headers)]
    )


def read_rules(spark: SparkSession, path: str, pattern: str = "识别内容", mapping: str = "映射内容") -> DataFrame:
    """rule_ord, pattern, mapping of the first sheet that yields rules; rows without a pattern are dropped."""
    rows = sniffed(cells(spark, path), [pattern, mapping]).filter(F.coalesce(pattern, F.lit("")) != "")
    first = rows.agg(F.min("sheet_ord").alias("sheet_ord"))
    return rows.join(F.broadcast(first), "sheet_ord").select(
        F.col("row").alias("rule_ord"), F.col(pattern).alias("pattern"), F.coalesce(mapping, F.lit("")).alias("mapping")
    )


RULE_SHEET, RULE_HEADERS = "映射规则", ["识别内容", "映射内容"]  # fixed values


def save_rules(rules: DataFrame, path: str) -> None:
    """Rules (rule_ord, pattern, mapping) as a workbook that ``read_rules`` reads."""
    kept = rules.orderBy("rule_ord").select(F.trim("pattern"), F.trim(F.coalesce("mapping", F.lit(""))))
    write_workbook(path, {RULE_SHEET: [RULE_HEADERS, *(list(r) for r in kept.toLocalIterator())]})


def load_rules(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """The rules of a workbook, and whether it was made just now, with the default rules, as there was none."""
    if made := not Path(path).exists():
        write_workbook(path, {RULE_SHEET: [RULE_HEADERS, *map(list, DEFAULT_RULES)]})
    return read_rules(spark, path), made


def read_names(spark: SparkSession, path: str, column: str = "项目名称", most_rows: int = 5000, distinct: bool = True) -> DataFrame:
    """name, ord of all sheets; distinct names at their first place, or every row."""
    rows = sniffed(cells(spark, path, most_rows), [column]).filter(F.coalesce(column, F.lit("")) != "")
    named = rows.select(F.col(column).alias("name"), (F.col("sheet_ord") * F.lit(1 << 32) + F.col("row")).alias("ord"))
    return named.groupBy("name").agg(F.min("ord").alias("ord")) if distinct else named


def write_workbook(path: str, sheets: dict[str, list[list]]) -> None:
    """A small workbook of inline strings: rules and reports, made on the driver."""
    from xml.sax.saxutils import escape

    def letters(n: int) -> str:
        out = ""
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(65 + r) + out
        return out

    kinds = "http://schemas.openxmlformats.org/package/2006/content-types"
    rels = "http://schemas.openxmlformats.org/package/2006/relationships"
    office = LINKS[1:-1]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(sheets)))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{kinds}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{rels}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i + 1}" Type="{office}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{rels}">{links}</Relationships>')
        for i, rows in enumerate(sheets.values()):
            body = "".join(
                f'<row r="{r}">' + "".join(f'<c r="{letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for c, v in enumerate(row, 1) if v is not None) + "</row>"
                for r, row in enumerate(rows, 1)
            )
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
