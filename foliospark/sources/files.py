"""File and directory scans."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foliospark.operators.segment import PRE_PAGES, UNMATCHED


def scan_pdfs(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, length, modificationTime of PDF files; contents are never read.

    Spark's file index passes over names that begin with ``_`` or ``.``; the ``dirs``
    source below sees them.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(folder).select("path", "length", "modificationTime")


def first_pdf(spark: SparkSession, root: str) -> DataFrame:
    """The first PDF by name directly in a folder."""
    return scan_pdfs(spark, root, recursive=False).agg(F.min("path").alias("path"))


class DirectorySource(DataSource):
    """Sub-directories of ``path``, empty ones included, hidden ones not.

    Option ``containers``: names, comma-separated, whose own sub-directories are listed
    instead of them. Option ``files``: true for a row a PDF file in them. For folders that
    every task can list (a mounted share).
    """

    @classmethod
    def name(cls) -> str:
        return "dirs"

    def schema(self) -> str:
        return "folder string, path string, container string, folder_ord long, file string"

    def reader(self, schema) -> DataSourceReader:
        return DirectoryReader(self.options)


class DirectoryReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root = options["path"].removeprefix("file://").removeprefix("file:")
        self.files = options.get("files", "false").lower() == "true"
        self.containers = [c for c in options.get("containers", "").split(",") if c]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        place = 0
        for name in _folders(self.root):
            inner = os.path.join(self.root, name)
            listed = [(sub, os.path.join(inner, sub), name) for sub in _folders(inner)] if name in self.containers else [(name, inner, None)]
            for folder, path, container in listed:
                for file in _pdfs(path) if self.files else (None,):
                    yield folder, path, container, place, file
                place += 1


def _folders(root: str) -> list[str]:
    if not os.path.isdir(root):
        return []
    return sorted(e.name for e in os.scandir(root) if e.is_dir() and not e.name.startswith("."))


def _pdfs(folder: str) -> list[str]:
    return sorted(e.name for e in os.scandir(folder) if e.is_file() and e.name.lower().endswith(".pdf"))


def list_folders(spark: SparkSession, root: str, containers: tuple[str, ...] = (), pdfs: bool = False) -> DataFrame:
    spark.dataSource.register(DirectorySource)
    reader = spark.read.format("dirs").option("containers", ",".join(containers)).option("files", str(pdfs).lower())
    found = reader.load(root)
    return found if pdfs else found.drop("file")


def scan_received(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Output folders (folder, folder_ord, is_unmatched, is_pre_pages) and their PDF files (folder, file)."""
    listed = list_folders(spark, root, (UNMATCHED,))
    folders = listed.select(
        "folder", "path", "folder_ord", F.col("container").isNotNull().alias("is_unmatched"), (F.col("folder") == PRE_PAGES).alias("is_pre_pages")
    )
    return folders, list_folders(spark, root, (UNMATCHED,), pdfs=True).select("folder", "file")
