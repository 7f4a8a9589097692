"""What the classifiers share: a bounded sample of labelled rows for fitting, and scoring of whole texts by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, text_or_empty, written


def held_out(id_col: str) -> Column:
    """Rows never learnt from: crc32 of the id as text is divisible by 5. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows_per_label: tuple[int, int], max_mb: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels to fit on: up to `rows_per_label` rows labelled 0 and 1, at most `max_mb` MB of text.

    Rows go by a hash of their id, so reruns draw the same ones, whatever the partitions. Held-out rows, null
    labels and ids without a document are left out. Long texts are drawn whole or not at all.
    """
    marked = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id"))
    ranked = [marked.where(F.col("_y") == y).select("_id", "_y", F.xxhash64("_id").alias("_h")).distinct().orderBy("_h", "_id").limit(rows_per_label[y]) for y in (0, 1)]
    drawn = ranked[0].union(ranked[1]).toPandas()  # bounded: ids only
    if not len(drawn):
        return [], np.zeros(0, int)
    spark = docs.sparkSession
    chosen = spark.createDataFrame(drawn[["_id", "_y", "_h"]], "_id long, _y int, _h long")
    # Both sides of this join are bounded by the sample but for the documents, which are read once.
    found = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), text_or_empty(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    share = max_mb * 1_000_000 / max(1, found.agg(F.sum(F.octet_length("_text"))).first()[0] or 0)
    if share < 1:
        found = found.where(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = found.select("_text", "_y", "_h", "_id").toPandas().sort_values(["_h", "_id", "_text"], kind="stable")
    return rows["_text"].tolist(), rows["_y"].to_numpy(int)


def scored(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], threshold: float, id_col: str = "doc_id", text_col: str = "text", mb: int = 4) -> DataFrame:
    """(id, held_out, score, predicted) for each row, from its text alone. score: strings without nulls -> probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.clip(np.nan_to_num(score(pc.fill_null(b.column(2), "").cast(pa.string())), nan=0.0), 0.0, 1.0).astype(float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), held_out(id_col).alias("_h"), text_or_empty(text_col).alias("_text"))
    with bounded_batches(docs.sparkSession, rows=1024, mb=mb):
        return written(base.mapInArrow(run, f"`{id_col}` long, held_out boolean, score double, predicted int"), "scores")
