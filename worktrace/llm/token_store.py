"""Token ids as Parquet list columns, readable by part.

Documents are dealt out by ranges of doc_id and sorted, so each file holds a
range and its row groups and pages have narrow minima and maxima; readers find a
document through the page index and take only the columns they ask for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worktrace.llm import tokens
from worktrace.llm.common import lookup_join, materialise, quoted, small_batches

#: Layout of the files: ids in dictionary pages (a vocabulary repeats), falling
#: back to delta-packed integers; doc_id and offsets delta-packed; small row groups
#: and pages; the writer adds column and offset indexes of the pages.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "1000",
}

_SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"
_ROWS = 500  # documents in an Arrow batch to Spark


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (part, doc_id, local_start, n_tokens, ids) in order of doc_id within each part, parts in order of doc_id.

    ids are those of the tokenizers library for the whole text (null: empty),
    special tokens not added, with `end_id` appended; local_start counts the ids
    before the document in its part. Null ids come first; rows that repeat an id
    follow each other in order of text.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.byte_level(tokenizer)
        part, start, end = TaskContext.get().partitionId(), 0, end_id.to_bytes(4, "little")
        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS):
                some = batch.slice(k, _ROWS)
                parts = [ids + end for ids in encoder.ids(some.column(1).to_pylist())]
                offsets = [0]
                for p in parts:
                    offsets.append(offsets[-1] + len(p) // 4)
                values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(parts))])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(parts), pa.int32()),
                        some.column(0),
                        pa.array([start + o for o in offsets[:-1]], pa.int64()),
                        pa.array([b - a for a, b in zip(offsets, offsets[1:], strict=False)], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values),
                    ],
                    names=["part", "doc_id", "local_start", "n_tokens", "ids"],
                )
                start += offsets[-1]

    small_batches(docs.sparkSession)
    slim = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    ordered = slim.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return ordered.mapInArrow(encode, _SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, **columns: str) -> None:
    """Encode `docs` and write the store at `path`. Fails if there is something already."""
    encoded(docs, tokenizer, end_id, **columns).write.options(**LAYOUT).parquet(path)


def read(
    spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None, between: tuple[int, int] | None = None,
    columns: Sequence[str] = ("doc_id", "ids"),
) -> DataFrame:
    """Selected columns of selected documents; the filters reach row groups and pages."""
    rows = spark.read.schema(_SCHEMA).parquet(path)
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin(*doc_ids))
    if between is not None:
        rows = rows.filter(F.col("doc_id").between(*between))
    return rows.select(*columns)


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """Per part: the ids of all parts before it. Reads one column; the ordered window holds a row per part."""
    parts = read(spark, path, columns=["part", "n_tokens"]).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids.

    An empty store gives no rows. The parts' offsets, one short row per file, are
    written first; up to a measured size they are broadcast, so that the ids
    are not shuffled.
    """
    rows = read(spark, path, columns=["part", "doc_id", "local_start", "n_tokens", "ids"])
    parts = materialise(offsets(spark, path), "token-store-offsets")
    return lookup_join(rows, parts, ["part"], F.xxhash64("doc_id", "local_start")).select(
        "doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "ids",
    )


def ids_crc32(ids: Column) -> Column:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return F.arrow_udf(_crc32, "long")(ids)


def _crc32(ids: pa.Array) -> pa.Array:
    ids = ids.cast(pa.list_(pa.int32())) if not pa.types.is_list(ids.type) else ids
    values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
    at = ids.offsets.to_numpy()
    return pa.array([zlib.crc32(values[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.int64())
