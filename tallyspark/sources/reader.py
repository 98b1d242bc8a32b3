"""Readers as data sources: ``spark.read.format("filing")`` and ``format("word_boxes")`` over folders that all executors see.

A partition is a file. A filter on ``path`` (equal to, in, starts with) is applied to the file names before any file is opened. A file that can't be read is one
row with `error`. Paths are those of the file system of the machines; a store that only Spark reads is read as binary files and
given to `filings.read_instances`, which yields the same rows.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from . import filings

WORD_BOXES = "path string, document_id string, page int, text string, words array<struct<text:string,x0:double,x1:double,top:double>>, error string"


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _FileReader(DataSourceReader):
    def __init__(self, options: dict, endings: tuple[str, ...]):
        self.most = int(options.get("most_bytes", 0))
        root = options.get("path", "")
        root = root.removeprefix("file://")
        found = [root] if os.path.isfile(root) else glob.glob(os.path.join(root, "**", "*"), recursive=True)
        self.paths = sorted(p for p in found if os.path.isfile(p) and p.lower().endswith(endings) and not os.path.basename(p).startswith(("_", ".")))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.paths = [p for p in self.paths if p == f.value]
            elif isinstance(f, In) and f.attribute == ("path",):
                self.paths = [p for p in self.paths if p in f.value]
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.paths = [p for p in self.paths if p.startswith(f.value)]
            else:
                yield f

    def partitions(self) -> list[File]:
        return [File(p) for p in self.paths]

    def read(self, partition: File) -> Iterator[tuple]:
        if not hasattr(partition, "path"):
            return  # a folder without files has one empty partition
        try:
            if self.most and os.path.getsize(partition.path) > self.most:
                raise ValueError(f"over {self.most} bytes")
            with open(partition.path, "rb") as f:
                rows = self.parse(partition.path, f.read())
        except (OSError, ValueError, KeyError, TypeError) as e:
            rows = [self.broken(partition.path, str(e))]
        yield from rows


class _FilingReader(_FileReader):
    def parse(self, path: str, content: bytes) -> list[tuple]:
        return [(path, context, _day(start), _day(end), *rest, None) for context, start, end, *rest in filings.parse_instance(content)]

    def broken(self, path: str, error: str) -> tuple:
        return (path, *[None] * 7, error)


def _day(text: str | None) -> date | None:
    """A date as the table has it; null for what is none."""
    try:
        return date.fromisoformat((text or "")[:10])
    except ValueError:
        return None


class FilingSource(DataSource):
    """Tagged XML filings: a row for each fact, with the columns of `filings.read_instances`. Options: path, most_bytes."""

    @classmethod
    def name(cls) -> str:
        return "filing"

    def schema(self) -> str:
        return filings.ELEMENTS

    def reader(self, schema) -> DataSourceReader:
        return _FilingReader(self.options, (".xml", ".xbrl"))


class _WordReader(_FileReader):
    def parse(self, path: str, content: bytes) -> list[tuple]:
        name = os.path.splitext(os.path.basename(path))[0]
        pages = [json.loads(line) for line in content.decode().splitlines() if line.strip()]
        return [(path, name, int(p["page"]), p.get("text"), [(w["text"], float(w["x0"]), float(w["x1"]), float(w["top"])) for w in p["words"]], None) for p in pages]

    def broken(self, path: str, error: str) -> tuple:
        return (path, os.path.splitext(os.path.basename(path))[0], None, None, None, error)


class WordBoxSource(DataSource):
    """Words with positions, as tools that open PDF files write them: a file for each document, a line of JSON (page, text, words) for each page."""

    @classmethod
    def name(cls) -> str:
        return "word_boxes"

    def schema(self) -> str:
        return WORD_BOXES

    def reader(self, schema) -> DataSourceReader:
        return _WordReader(self.options, (".json", ".jsonl"))


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session; filters are pushed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FilingSource, WordBoxSource):
        spark.dataSource.register(source)
