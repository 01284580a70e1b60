"""Small helpers that the operators share: shared storage, size-checked joins, names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrace.sources.storage import materialise, new_path, shared_dir

__all__ = [
    "BROADCAST_BYTES", "WORD", "bitmap", "bitmap_parts", "in_bitmap", "lookup_join", "materialise", "new_path", "packed", "quoted", "salt_count", "shared_dir", "small_batches",
    "with_bit",
]

#: A word: a maximal run of anything but ASCII white space (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"

#: A lookup side of up to this many bytes (as measured, see `lookup_join`) is broadcast.
BROADCAST_BYTES = 8 << 20


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows in an Arrow batch to Python: texts can be long, so fewer than Spark's default."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, but: Sequence[str] = ()) -> Column:
    """All columns of `df` (but those named) as one struct, so that no helper column can clash with them."""
    names = [c for c in df.columns if c not in but]
    return F.struct(*[quoted(c).alias(c) for c in names]) if names else F.struct(F.lit(True).alias("none"))


def salt_count(spark: SparkSession) -> int:
    """Salts for hot keys: as many as there are shuffle partitions, so a hot key can fill the whole cluster."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


BITMAP_BITS = 26  # log of the places of a bitmap: 8 MB, whatever the input


def bitmap_parts(keys: DataFrame, column: str) -> DataFrame:
    """The bitmap of the 64-bit keys as at most 2048 rows (part, bits) of 4 KB; parts without a key are left out."""
    place = F.col(column).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    return keys.groupBy(F.shiftright(place, 15).alias("part")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))


def with_bit(rows: DataFrame, parts: DataFrame, key: Column, name: str) -> DataFrame:
    """`rows` and whether the place of their 64-bit key is set in `parts`, which are broadcast: 8 MB at most."""
    place = key.bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    at = place.bitwiseAND(F.lit((1 << 15) - 1)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("long")
    bits = F.broadcast(parts.select(F.col("part").alias("_part"), F.col("bits").alias("_bits")))
    joined = rows.join(bits, F.shiftright(place, 15) == F.col("_part"), "left")
    return joined.withColumn(name, F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1, F.lit(False))).drop("_part", "_bits")


def bitmap(keys: DataFrame, column: str) -> bytes:
    """One bit for each of 2^BITMAP_BITS places, set for those of the 64-bit keys: a filter of fixed size that passes all keys, and some others."""
    out = bytearray(1 << (BITMAP_BITS - 3))
    for row in bitmap_parts(keys, column).toLocalIterator():  # at most 2048 rows of 4 KB
        out[row["part"] << 12 : (row["part"] + 1) << 12] = row["bits"]
    return bytes(out)


def in_bitmap(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """Which of the keys' places are set."""
    place = keys.view(np.int64) & ((1 << BITMAP_BITS) - 1)
    return (np.frombuffer(bits, dtype=np.uint8)[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def lookup_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], salt: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Left join of `rows` with a (materialised) lookup `table`, one row per key, null keys equal.

    The size of `table` is measured: up to `limit` bytes of text it is broadcast;
    beyond, both sides shuffle by the key and a salt, so that a hot key spreads
    over many tasks while each key's row is copied once per salt.
    `salt`: an expression over `rows` that spreads rows of one key.
    """
    spark = rows.sparkSession
    size = table.select(F.sum(F.length(F.to_json(F.struct(*table.columns)))).alias("b")).first()["b"] or 0
    mine = {k: f"_key_{i}" for i, k in enumerate(keys)}
    right = table.withColumnsRenamed(mine)
    on = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(right[m]) for k, m in mine.items()])
    if size <= limit:
        return rows.join(F.broadcast(right), on, "left").drop(*mine.values())
    salts = min(64, salt_count(spark))
    left = rows.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    right = right.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[m]) for k, m in mine.items()])
    return left.join(right, on & (F.col("_salt") == F.col("_salt_r")), "left").drop("_salt", "_salt_r", *mine.values())
