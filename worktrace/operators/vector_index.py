"""An inverted-file index for cosine similarity: cells, short codes, exact re-ranking.

Centroids are fitted on a sample of SAMPLE_ROWS vectors, less if they are long; every
vector is then assigned to its nearest one and written with an 8-bit code of what the
centroid leaves, a quarter of its size. A search reads the codes of the cells nearest
to each query, keeps the best candidates and ranks them by their full vectors. How many
cells that takes for a recall of TARGET is measured on the sample.

The exact search goes on from there. The cells hold their widest angle, so it is known
which of them may hold something better than what a query has, and codes come with the
largest error they can have; what may be better is ranked by full vectors as well.

A cell of more than PART_ROWS vectors is split into parts, and queries meet a part
QUERY_ROWS at a time, so no task holds more than that, however many vectors or queries
one cell draws. Parts are numbered through all cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worktrace.operators.access import dot
from worktrace.sources.storage import materialise

SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 32 << 20  # of the sample, and of the centroids
MAX_CELLS = 4096
TARGET = 0.95
PART_ROWS = 20_000
QUERY_ROWS = 2_000
ASSIGN_ROWS = 1_024  # vectors that are compared with all centroids at a time
PROBE_ROWS = 8_192  # rows of queries and cells in one batch, about
RERANK = 4  # candidates per query: so many times k

_ENTRY = "cell int, part int, id long, scale float, code binary, embedding array<double>"
_FOUND = "query_id long, id long, cell int, part int, score double"


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of numbers as unit vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector that has a direction."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.filter("id is not null and embedding is not null").filter(dot(F.col("embedding"), F.col("embedding")) > 0)


def _sample(vectors: DataFrame, n: int, dims: int) -> DataFrame:
    rows = min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    return vectors.filter(place < F.lit(int(min(1.0, rows / n) * (1 << 30))))


def _least_probes(sample: np.ndarray, centroids: np.ndarray, k: int = 5, queries: int = 200) -> int:
    """How many of the nearest cells hold TARGET of the k nearest neighbours inside the sample."""
    cell = np.argmax(sample @ centroids.T, axis=1)
    step = max(1, len(sample) // queries)
    ranks = []
    for i in range(0, len(sample), step):
        near = sample @ sample[i]
        near[i] = -np.inf
        order = np.empty(len(centroids), dtype=int)
        order[np.argsort(-(centroids @ sample[i]))] = np.arange(len(centroids))
        ranks += order[cell[np.argsort(-near)[: min(k, len(sample) - 1)]]].tolist()
    return int(np.quantile(ranks, TARGET, method="higher")) + 1 if ranks else 1


def _assign(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, ASSIGN_ROWS) for whole in batches for a in range(0, whole.num_rows, ASSIGN_ROWS)):
            unit = _matrix(batch.column(1))
            cell = np.argmax(unit @ centroids.T, axis=1)
            rest = unit - centroids[cell]
            scale = (np.abs(rest).max(axis=1) / 127).astype(np.float32)
            codes = np.rint(rest / np.maximum(scale, 1e-30)[:, None]).astype(np.int8)
            cosine = np.einsum("ij,ij->i", unit, centroids[cell])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cell.astype(np.int32)), batch.column(0), pa.array(scale), pa.array([c.tobytes() for c in codes], pa.binary()),
                    batch.column(1), pa.array(cosine),
                ],
                ["cell", "id", "scale", "code", "embedding", "cosine"],
            )

    return assign


def build(vectors: DataFrame, path: str, cells: int | None = None, seed: int = 1) -> None:
    """Write an index of `vectors` (id, embedding) below `path`: cells, entries and settings.

    Rows without id, vector or direction are left out; repeated rows are entries of
    their own; all vectors have one length. Other columns are not read. An empty
    table gives an index in which nothing is found.
    """
    spark, rows = vectors.sparkSession, _usable(vectors)
    about = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims")).first()
    n, dims = about["n"], about["dims"] or 1
    cells = min(cells or max(1, int(n**0.5)), MAX_CELLS, SAMPLE_BYTES // (8 * dims), max(1, n))
    sample = _sample(rows, max(n, 1), dims).select("id", "embedding").orderBy("id")
    held = np.array([r["embedding"] for r in sample.select("embedding").collect()], dtype=float).reshape(-1, dims)  # bounded by SAMPLE_BYTES
    held = held / np.linalg.norm(held, axis=1, keepdims=True) if len(held) else np.eye(1, dims)
    if n and len(held) > cells:
        norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
        unit = sample.select(array_to_vector(F.transform("embedding", lambda x: x / norm)).alias("features"))
        centroids = np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(unit).clusterCenters())
    else:
        centroids = held[:cells]
    probes = _least_probes(held, centroids)
    assigned = rows.mapInArrow(_assign(centroids), "cell int, id long, scale float, code binary, embedding array<double>, cosine double")
    assigned = materialise(assigned, "assigned")
    counts = sorted((r["cell"], -(-r["n"] // PART_ROWS)) for r in assigned.groupBy("cell").agg(F.count("*").alias("n")).collect())  # a row per cell
    starts = np.cumsum([0] + [c for _, c in counts]).tolist()
    parts = spark.createDataFrame([(c, a, m) for (c, m), a in zip(counts, starts, strict=False)], "cell int, _first int, _parts int")
    part = (F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_parts"))).cast("int")
    entries = assigned.join(F.broadcast(parts), "cell").withColumn("part", part).drop("_first", "_parts")
    entries.repartitionByRange("cell", "part", "id").sortWithinPartitions("cell", "part", "id").write.parquet(f"{path}/entries")
    stored = spark.read.parquet(f"{path}/entries")
    sizes = stored.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("cosine").alias("least"), F.max("scale").cast("double").alias("scale"),
        F.array_sort(F.collect_set("part")).alias("parts"),
    )
    center = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    center.join(sizes, "cell").coalesce(1).write.parquet(f"{path}/cells")
    settings = spark.createDataFrame([(n, dims, len(centroids), probes, len(held))], "n long, dims int, cells int, probes int, sample_rows int")
    settings.coalesce(1).write.parquet(f"{path}/settings")


class _Cells:
    """Cells as arrays; at most SAMPLE_BYTES of centroids."""

    def __init__(self, rows: list[Any]):
        self.cell = [r["cell"] for r in rows]
        self.parts = [r["parts"] for r in rows]
        self.centroid = np.array([r["centroid"] for r in rows], dtype=float).reshape(len(rows), -1 if rows else 1)
        norm = np.linalg.norm(self.centroid, axis=1)
        self.norm = np.maximum(norm, 1e-12)
        # the widest angle between a member and the centroid
        self.angle = np.arccos(np.clip(np.array([r["least"] for r in rows]) / self.norm, -1, 1))
        self.error = np.array([r["scale"] for r in rows]) / 2 * self.centroid.shape[1] ** 0.5

    def highest(self, unit: np.ndarray) -> np.ndarray:
        """The largest cosine that a member of each cell can have with each query."""
        to_center = np.arccos(np.clip(unit @ self.centroid.T / self.norm, -1, 1))
        return np.cos(np.maximum(to_center - self.angle, 0))


def _probed(cells: _Cells, probes: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(query_id, embedding, least) -> a row per part of a cell to look into: the nearest cells, or all that may hold more than `least`."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PROBE_ROWS // max(1, sum(map(len, cells.parts))))
        for batch in (whole.slice(a, step) for whole in batches for a in range(0, whole.num_rows, step)):
            unit, least = _matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            if probes is None:
                wanted = [np.flatnonzero(row >= t - 1e-9) for row, t in zip(cells.highest(unit), least, strict=True)]
            else:
                wanted = np.argsort(-(unit @ cells.centroid.T), axis=1)[:, :probes]
            rows = [(i, cells.cell[c], p) for i, found in enumerate(wanted) for c in found for p in cells.parts[c]]
            at, cell, part = (pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32())))
            yield pa.RecordBatch.from_arrays(
                [cell, part, *(batch.column(k).take(at) for k in range(3))],
                ["cell", "part", "query_id", "q", "least"],
            )

    return probe


def _scored(cells: _Cells, keep: int | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Candidates of one part for the queries that look into it: the best `keep` by their codes, or all that may reach `least`."""
    where = {c: i for i, c in enumerate(cells.cell)}

    def score(queries: pa.Table, entries: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        cell = part = 0
        if queries.num_rows and entries.num_rows:
            cell, part = entries.column("cell")[0].as_py(), entries.column("part")[0].as_py()
            i = where[cell]
            unit, least = _matrix(queries.column("q")), queries.column("least").to_numpy()
            codes = np.frombuffer(b"".join(entries.column("code").to_pylist()), np.int8).reshape(entries.num_rows, -1)
            rebuilt = (cells.centroid[i] + codes * entries.column("scale").to_numpy()[:, None]).T
            ids, names = entries.column("id").to_numpy(), queries.column("query_id").to_numpy()
            for a in range(0, len(unit), 128):
                about = unit[a : a + 128] @ rebuilt
                about[names[a : a + 128, None] == ids[None, :]] = -np.inf
                if keep is None:
                    chosen = about + cells.error[i] + 1e-6 >= least[a : a + 128, None]
                else:
                    chosen = np.zeros(about.shape, bool)
                    np.put_along_axis(chosen, np.argpartition(-about, min(keep, len(ids)) - 1, axis=1)[:, :keep], True, axis=1)
                q, e = np.nonzero(chosen & np.isfinite(about))
                found.append((names[a + q], ids[e], about[q, e]))
        name, other, value = (np.concatenate([f[n] for f in found]) for n in range(3))
        place = [pa.array(np.full(len(name), x, np.int32)) for x in (cell, part)]
        return pa.Table.from_arrays([pa.array(name), pa.array(other), *place, pa.array(value)], [f.split()[0] for f in _FOUND.split(", ")])

    return score


def _ranked(spark: SparkSession, path: str, queries: DataFrame, cells: _Cells, k: int, probes: int | None, keep: int | None) -> DataFrame:
    """(query_id, id, similarity, rank) of the candidates that codes leave, by full vectors. queries: query_id, embedding, least."""
    entries = spark.read.parquet(f"{path}/entries")
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    mine = queries.mapInArrow(_probed(cells, probes), "cell int, part int, query_id long, q array<double>, least double").withColumn("block", block)
    codes = entries.select("cell", "part", "id", "scale", "code").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["cell", "part", "block"]
    found = mine.groupBy(*keys).cogroup(codes.groupBy(*keys)).applyInArrow(_scored(cells, keep), _FOUND)
    found = found.dropDuplicates(["query_id", "cell", "part", "id"])
    if keep is not None:
        nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
        found = found.withColumn("_r", F.row_number().over(nearest)).filter(F.col("_r") <= keep)
    full = entries.select("cell", "part", "id", "embedding")
    pairs = found.select("query_id", "id", "cell", "part").join(full, ["cell", "part", "id"]).join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    norm = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    pairs = pairs.select("query_id", "id", "part", (dot(F.col("q"), F.col("embedding")) / (norm("q") * norm("embedding"))).alias("similarity"))
    order = [F.desc("similarity"), F.asc("id")]
    for by in (["query_id", "part"], ["query_id"]):
        pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    return pairs.select("query_id", "id", "similarity", "rank")


def search(queries: DataFrame, path: str, k: int = 5, probes: int | None = None, exact: bool = False) -> DataFrame:
    """query_id, id, similarity, rank: for each of `queries` (id, embedding) the k entries with the largest cosine.

    By default from the `probes` nearest cells (as many as the index was measured to
    need), RERANK * k candidates a query; with `exact`, the same as by comparing all.
    An entry does not answer a query of its own id; ties go to the smaller id. Queries
    without id, vector or direction have no answers; repeated ids ask once.
    """
    spark = queries.sparkSession
    settings = spark.read.parquet(f"{path}/settings").first()
    cells = _Cells(sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"]))  # at most MAX_CELLS rows, SAMPLE_BYTES
    asked = _usable(queries).dropDuplicates(["id"]).select(F.col("id").alias("query_id"), "embedding", F.lit(-2.0).alias("least"))
    if not cells.cell:
        return spark.createDataFrame([], "query_id long, id long, similarity double, rank int")
    few = probes or settings["probes"]
    if not exact:
        return _ranked(spark, path, asked, cells, k, few, RERANK * k)
    # what the nearest cells hold is enough for a bound; all that may be better is read after that
    first = _ranked(spark, path, asked, cells, k, probes or max(1, few // 8), RERANK * k)
    worst = first.groupBy("query_id").agg(F.min(F.when(F.col("rank") == k, F.col("similarity"))).alias("kth"))
    bounded = asked.join(worst, "query_id", "left").select("query_id", "embedding", F.coalesce("kth", F.lit(-2.0)).alias("least"))
    return _ranked(spark, path, bounded, cells, k, None, None)
