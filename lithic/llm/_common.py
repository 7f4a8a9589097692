"""What the operators share: the shared folder, written intermediate tables, Arrow batch bounds."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z only; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A cluster without one is an error.

    A session in one process (tests) shares any folder: there a temporary one is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lithic-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path for one written table; a rerun of the job writes another one."""
    return f"{shared_dir(spark)}/lithic/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = 512, mb: int = 8) -> Iterator[None]:
    """Bound what one Arrow batch holds, by rows and by bytes, for what runs inside: Python workers stay small."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(mb << 20)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 1 << 15, mb: int = 4) -> Iterator[pa.Table]:
    """Rows that come sorted by their first `keys` columns, in tables of whole groups and about so many rows or bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= mb << 20:
            t = pa.Table.from_batches(held).combine_chunks()
            last = np.ones(t.num_rows, bool)
            for k in range(keys):
                last &= pc.equal(t.column(k), t.column(k)[-1]).to_numpy()
            cut = int(np.argmax(last))  # the last group may go on in the next batch
            if cut:
                yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks()


def fixed(column: pa.ChunkedArray, dtype: type, width: int) -> np.ndarray:
    """Binaries of `width` items each, as a (rows, width) array."""
    joined = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(joined.to_pylist()), dtype).reshape(len(joined), width)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
