"""Table functions for SQL: rows of a partition, in order, packed into chunks and runs."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

CHUNKS = "key string, chunk int, first long, n_lines int, tokens int, text string"


class PackLines:
    """Packs the lines of a partition (key, n, text) in order into chunks of at most so many tokens (a quarter of the characters, and one); a longer line has a chunk of its own.

    ``SELECT * FROM pack_lines(320, TABLE(lines) PARTITION BY key ORDER BY n)``: Spark deals and sorts the partitions, one chunk is held at a time. Null
    texts are empty lines; a chunk names its partition's key and the number of its first line.
    """

    def __init__(self):
        self.key, self.chunk, self.most = None, 0, 0
        self.lines, self.first, self.size = [], None, -1

    @staticmethod
    def tokens(size: int) -> int:
        return size // 4 + 1

    def _told(self) -> tuple:
        self.chunk += 1
        return self.key, self.chunk, self.first, len(self.lines), self.tokens(max(self.size, 0)), "\n".join(self.lines)

    def eval(self, max_tokens: int, line: Row):
        text = line["text"] or ""
        if self.lines and self.tokens(self.size + 1 + len(text)) > max_tokens:
            yield self._told()
            self.lines, self.size = [], -1
        if not self.lines:
            self.key, self.first = None if line["key"] is None else str(line["key"]), line["n"]
        self.lines.append(text)
        self.size += 1 + len(text)

    def terminate(self):
        if self.lines:
            yield self._told()


def register(spark: SparkSession) -> None:
    """Makes ``pack_lines`` known to a session's SQL."""
    spark.udtf.register("pack_lines", udtf(PackLines, returnType=CHUNKS))
