"""Token counts by heap-and-linked-list byte-pair merging, with no identifiers emitted."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import HeapCounter, default_path

LIMIT = 1024


@lru_cache(maxsize=2)
def counter(path: str) -> HeapCounter:
    return HeapCounter(path)


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id with ``n_bytes`` (UTF-8) and ``n_tokens``.

    A narrow pass: no shuffle, each text stands alone. Null and empty texts have 0 of both; repeated rows and null
    ids are kept as they come; other columns are neither read nor returned. Special strings in a text count one
    token each, as the library has it by default.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([0 if t is None else count(t) for t in texts.to_pylist()], pa.int64()), batch.column(2)], ["id", "n_tokens", "n_bytes"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(run, f"id {kind}, n_tokens long, n_bytes long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count by byte_bpe_50k.json and whether it is over 1024."""
    counted = count_tokens(common.table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
