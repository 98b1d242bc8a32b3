"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of payload after which a Python stage hands an Arrow batch back.
OUT_BYTES = 4 << 20


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 8 << 20


def bounded_batches() -> None:
    """Bounds Arrow batches by bytes beside the usual row count, so that long texts don't fill a worker."""
    conf, key = SparkSession.active().conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", conf.get(key)) or 0) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only where it is unset and all of Spark is one process on one machine a local folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tallyspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Tables in the shared folder that nothing has dropped yet.
_WRITTEN: list[Written] = []


class Written:
    """A DataFrame written as Parquet to the shared folder, so that nothing below
    it is computed twice and a lost executor costs no more than the reading task."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        _WRITTEN.append(self)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        if self in _WRITTEN:
            _WRITTEN.remove(self)


@contextmanager
def scratch() -> Iterator[Callable[[Written], Written]]:
    """Drops the tables written inside the block at its end, but for those given to what it yields."""
    before, kept = set(map(id, _WRITTEN)), set()

    def keep(written: Written) -> Written:
        kept.add(id(written))
        return written

    try:
        yield keep
    finally:
        for written in [w for w in _WRITTEN if id(w) not in before | kept]:
            written.drop()


def release() -> None:
    """Drops all tables that operators have written and that their results still read: call it when those are no longer needed."""
    for written in list(_WRITTEN):
        written.drop()


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_label: tuple[int, int], most_bytes: tuple[int, int], id_col: str = "doc_id", text_col: str = "text") -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of a bounded sample: of the rows of `labels` with label 0 and 1 the
    `per_label` lowest by a hash of the id, and of their texts, in that order, each that still
    fits into `most_bytes` of its label.

    An id with several labels has the lowest of them; of rows of `docs` that share an id one of the
    shortest text counts. The sample's ids are chosen from `labels` alone; only they (at most
    as many rows as the bounds say) are broadcast to two scans of `docs`, one for the sizes
    of their texts and one for the texts that fit, so no text is shuffled.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.xxhash64(id_col).alias("h")).where("id is not null and label in (0, 1)")
    rows = rows.groupBy("id", "h").agg(F.min("label").alias("label"))
    low, high = (rows.where(F.col("label") == label).orderBy("h", "id").limit(n) for label, n in enumerate(per_label))
    chosen = low.unionByName(high)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sized = texts.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(F.broadcast(chosen), "id")
    sized = sized.groupBy("label", "h", "id").agg(F.min("size").alias("size")).toPandas().sort_values(["h", "id"], ignore_index=True)
    fits, left = [], dict(enumerate(most_bytes))
    for row in sized.itertuples():
        if row.size <= left[row.label]:
            left[row.label] -= row.size
            fits.append((row.id, row.label, row.h, row.size))
    if not fits:
        return [], np.zeros(0, np.int64)
    ids = docs.sparkSession.createDataFrame(fits, f"id {chosen.schema['id'].dataType.simpleString()}, label int, h long, size long")
    same = texts.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    found = same.join(F.broadcast(ids), ["id", "size"]).groupBy("label", "h", "id").agg(F.min("text").alias("text")).toPandas().sort_values(["h", "id"], ignore_index=True)
    return [(t or "").encode() for t in found["text"]], found["label"].to_numpy()


def ascii_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case."""
    return text.lower().split()


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def joined_text(texts: list[bytes], gap: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each followed by `gap`; the start of each and the end of all."""
    lengths = np.fromiter((len(t) + len(gap) for t in texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=starts[1:])
    return np.frombuffer(gap.join([*texts, b""]), np.uint8), starts
