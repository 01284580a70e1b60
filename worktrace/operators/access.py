"""Reads of the stored tables: by video, by time, by step, by similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def of_video(table: DataFrame, video_id: int) -> DataFrame:
    """Rows of one video; files clustered by video_id are skipped by their minima and maxima."""
    return table.filter(F.col("video_id") == video_id)


def in_range(frames: DataFrame, first: int, last: int, column: str = "ts_ms") -> DataFrame:
    """Frames with first <= time <= last. On tables of tables.write_parquet() the filter reaches the scan, whose files are sorted by video and time."""
    return frames.filter(F.col(column).between(first, last))


def by_step(insights: DataFrame) -> DataFrame:
    """Insights per step number."""
    return insights.groupBy("step_number").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("video_id").alias("n_videos"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Queries that a task holds at a time.
QUERY_BLOCK = 2_000
#: Bytes of queries that a task holds at most.
QUERY_BYTES = 16 << 20
#: Vectors that meet a block in one task.
PART = 5_000
#: Pairs that a task compares at a time.
PAIRS = 1 << 20


def _matrices(vectors: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows) for each length that vectors have."""
    vectors = vectors.combine_chunks()
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from the first number to the last: equal vectors have equal ones."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _nearest(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k nearest of a part for each query of a block. A matrix product says which may be among them, up to its last digits."""

    def nearest(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        names, ids = queries.column("query_id"), vectors.column("id")
        codes = pa.chunked_array([*names.chunks, *ids.chunks], ids.type).combine_chunks().dictionary_encode()
        place = np.empty(len(codes.dictionary), dtype=np.int64)
        place[pc.array_sort_indices(codes.dictionary).to_numpy()] = np.arange(len(place))
        order = place[codes.indices.to_numpy()]
        mine, theirs = order[: len(names)], order[len(names) :]
        rows = {len(v[0]): (at, v) for at, v in _matrices(vectors.column("embedding"))} if vectors.num_rows else {}
        found = []
        for at, q in _matrices(queries.column("q")) if queries.num_rows else ():
            if len(q[0]) not in rows:
                continue
            other, v = rows[len(q[0])]
            nq, nv = _dots(q, q), _dots(v, v)
            unit, units = q / np.sqrt(nq)[:, None], (v / np.sqrt(nv)[:, None]).T
            step = max(1, PAIRS // len(v))
            for a in range(0, len(q), step):
                about = unit[a : a + step] @ units
                about[mine[at[a : a + step]][:, None] == theirs[other][None, :]] = -np.inf
                least = np.partition(about, -k, axis=1)[:, -k] if len(v) > k else np.full(len(about), -2.0)
                i, j = np.nonzero((about >= least[:, None] - 1e-9) & np.isfinite(about))
                score = np.concatenate([_dots(q[a + i[b : b + PAIRS // 8]], v[j[b : b + PAIRS // 8]]) for b in range(0, max(len(i), 1), PAIRS // 8)])
                score = np.clip(score / np.sqrt(nq[a + i] * nv[j]), -1, 1)
                best = np.lexsort((theirs[other[j]], -score, i))
                i, j, score = i[best], j[best], score[best]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                found.append((at[a + i[keep]], other[j[keep]], score[keep]))
        i, j, score = (np.concatenate([f[n] for f in found]) if found else np.zeros(0, int) for n in range(3))
        return pa.table([names.take(pa.array(i, pa.int64())), ids.take(pa.array(j, pa.int64())), pa.array(score, pa.float64())], ["query_id", "id", "similarity"])

    return nearest


def most_similar(queries: DataFrame, vectors: DataFrame, k: int = 5, block: int = QUERY_BLOCK, part: int = PART) -> DataFrame:
    """query_id, id, similarity, rank: the k nearest of `vectors` (id, embedding) by cosine, for each of `queries` (the same columns).

    Counts the queries and their length first: a block has `block` of them, fewer if
    these are over QUERY_BYTES. Blocks of queries meet parts of `part` vectors or so:
    each vector is copied once per block and each query once per part, so no task
    holds all of either. Each task ranks its vectors for each query and keeps k, so
    what meets per query is k rows per part. All pairs are compared: the work grows
    as queries times vectors, a task's memory does not. A vector does not answer
    itself; ties go to the smaller id; rows without id, zero vectors and those with
    NaN have no neighbours, and vectors of another length are none.
    """
    usable = lambda rows: rows.select("id", F.col("embedding").cast("array<double>").alias("embedding")).filter(
        F.col("id").isNotNull() & (dot(F.col("embedding"), F.col("embedding")) > 0) & ~F.isnan(dot(F.col("embedding"), F.col("embedding")))
    )
    about = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims")).first()
    blocks = max(1, -(-about["n"] // max(1, min(block, QUERY_BYTES // (8 * max(1, about["dims"] or 1))))))
    parts = max(1, -(-vectors.count() // part))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = usable(queries).select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    q = q.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("_part", each(parts))
    v = usable(vectors).withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn("_block", each(blocks))
    kind = vectors.schema["id"].dataType.simpleString()
    q = q.withColumn("query_id", F.col("query_id").cast(kind))
    pairs = q.groupBy("_block", "_part").cogroup(v.groupBy("_block", "_part")).applyInArrow(_nearest(k), f"query_id {kind}, id {kind}, similarity double")
    best = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("id"))))
    return best.filter(F.col("rank") <= k).select("query_id", "id", "similarity", "rank")
