"""Near-duplicate groups by HyperMinHash.

A document's set of word shingles goes through one hash into REGISTERS buckets; of
each bucket's smallest value the register keeps the number of leading zeros and
MANTISSA bits after the first one bit (16 bits in all). Bands of BAND registers
deal documents into buckets; pairs get a Jaccard estimate, corrected for registers
that agree by chance, and those near the threshold or above it are confirmed on the
full sets. Each shingle of a set up to DENSE goes in under SEEDS seeds, so that
small sets fill the registers too; larger sets use one. Sets between DENSE and
DENSE / threshold have both kinds, so any two that could be linked share one.

No bucket emits its pairs. Each sends its members to one hub, the member that meets
most others; members and hub that prove alike fall into one component, and pairs
inside a component need no look. What is left are pairs of different components in
one bucket. Of the documents in such buckets the shingles are counted, and each
document shows only its rarest, a quarter of its set: two that are alike at the
threshold have one of these in common, at places that leave room for all they must
share. Shingles of a passage that many documents hold are the commonest and are
shown by none of them but those that hold little else.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worktrace.llm.common import WORD, bitmap, in_bitmap, materialise, quoted, small_batches
from worktrace.llm.hashing import mix, word_hashes

SHINGLE = 5
PERCENT = 75  # similarity from which documents are linked
REGISTERS = 360
MANTISSA = 10
BAND = 6  # a pair at the threshold misses all 60 bands with probability (1 - 0.75^6)^60 = 8e-6
SEEDS = 8
DENSE = 1024  # largest set that uses all seeds
SMALL = 64  # pairs of smaller sets are confirmed whatever the estimate
MARGIN = 6.0  # pairs up to so many standard deviations below the threshold are confirmed

_WORD = re.compile(WORD.encode())
_U = np.uint64


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; a shorter text is one shingle."""
    if not len(words):
        return words
    left = min(SHINGLE, len(words))
    with np.errstate(over="ignore"):
        h, done, run, width = np.full(len(words), _U(left), dtype=_U), 0, words, 1
        while True:  # runs of 1, 2, 4, ... words, each from its halves
            if left & width:
                n = len(words) - done - width + 1
                h = mix(h[:n] * _U(0x9FB21C651E98DF25) + run[done : done + n])
                done += width
            width *= 2
            if width > left:
                return np.unique(h)
            run = mix(run[: -width // 2] * _U(0x9FB21C651E98DF25) + run[width // 2 :])


def registers(hashes: np.ndarray, seeds: int) -> np.ndarray:
    """HyperMinHash registers of distinct hashes: (leading zeros + 1) << MANTISSA | mantissa; 0: empty."""
    out = np.zeros(REGISTERS, dtype="<u2")
    if not len(hashes):
        return out
    least = _smallest(hashes, seeds, REGISTERS)
    full = np.flatnonzero(least < _U(1 << 56))
    low = least[full]
    length = np.frexp(low.astype(np.float64))[1].astype(np.int64)
    length -= (low >> (length - 1).astype(_U)) == 0  # where the float was rounded up
    shift = length - 1 - MANTISSA
    mantissa = np.where(shift >= 0, low >> np.maximum(shift, 0).astype(_U), low << np.maximum(-shift, 0).astype(_U)) & _U((1 << MANTISSA) - 1)
    out[full] = ((56 - length + 1) << MANTISSA) | mantissa.astype(np.int64)
    return out


def _smallest(hashes: np.ndarray, seeds: int, buckets: int) -> np.ndarray:
    """The smallest 56-bit value of each bucket, 2^56 where it is empty; each hash goes in under each seed."""
    with np.errstate(over="ignore"):
        items = mix((hashes[None, :] + _U(1)) * (np.arange(seeds, dtype=_U)[:, None] * _U(0x9E3779B97F4A7C16) + _U(0xD6E8FEB86659FD93))).ravel()
        values = mix(items * _U(3)) >> _U(8) | _U(1)
    least = np.full(buckets, _U(1 << 56), dtype=_U)
    np.minimum.at(least, ((items >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64), values)
    return least


def expected_collisions(n: int, m: int) -> float:
    """Expected share of buckets whose registers agree though their minima differ, for set sizes n and m.

    A register's cell of z zeros and mantissa j covers values from a to b; both
    minima fall into it with probability ((1-a)^n' - (1-b)^n')((1-a)^m' - (1-b)^m'),
    n' and m' being the elements in a bucket; summed over all cells.
    """
    z = np.arange(1, 30)[:, None].astype(float)
    j = np.arange(1 << MANTISSA)[None, :].astype(float)
    size = 2.0 ** (-z - MANTISSA)
    a = 2.0**-z + j * size
    log_a, log_b = np.log1p(-a), np.log1p(-np.minimum(a + size, 1 - 1e-16))
    p, q = (np.exp(x / REGISTERS * log_a) - np.exp(x / REGISTERS * log_b) for x in (n, m))
    return float((p * q).sum())


@lru_cache(maxsize=4096)
def _collisions(n: int, m: int) -> float:
    return expected_collisions(1 << n, 1 << m) * REGISTERS


def estimates(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of rows of registers, and the number of registers each rests on; n, m: items in the sets."""
    used = ((a != 0) | (b != 0)).sum(axis=1)
    agree = ((a == b) & (a != 0)).sum(axis=1)
    chance = np.array([_collisions(int(x).bit_length(), int(y).bit_length()) for x, y in zip(n, m, strict=True)])
    return np.maximum(agree - chance, 0) / np.maximum(used, 1), used


def shingle_set(text: str) -> set[bytes]:
    """The full set, of the shingles themselves."""
    words = _WORD.findall(text.encode("utf-8", "replace").lower())
    width = min(SHINGLE, len(words))
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def similarity(a: set, b: set) -> tuple[bool, float]:
    """Whether two sets are linked, and their Jaccard similarity."""
    both = len(a & b)
    return bool(both) and 100 * both >= PERCENT * (len(a) + len(b) - both), both / max(len(a) + len(b) - both, 1)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for t in batch.column(1):
            data = (t.as_py() or "").encode("utf-8", "replace").lower()  # lowers A-Z only
            hashes = shingle_hashes(word_hashes(data))
            n = len(hashes)
            used = SEEDS if n * PERCENT <= DENSE * 100 else None, 1 if n > DENSE else None
            dense, wide = (seeds and registers(hashes, seeds).tobytes() for seeds in used)
            for column, value in zip(rows, (hashlib.sha256(b" ".join(data.split())).digest(), n, dense, wide), strict=True):
                column.append(value)
        kinds = [pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]],
            names=["id", "words", "n", "dense", "wide"],
        )


def _shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, n, text) -> a row (shingle, id, label, n) for each shingle."""
    for batch in batches:
        for i in range(batch.num_rows):
            text = (batch.column(3)[i].as_py() or "").encode("utf-8", "replace").lower()
            hashes = shingle_hashes(word_hashes(text)).view(np.int64)
            same = [pa.array(np.full(len(hashes), batch.column(k)[i].as_py(), dtype=np.int64)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(hashes), *same], names=["shingle", "id", "label", "n"])


def _maybe(known) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows whose first column may be one of the keys of a broadcast bitmap."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(known.value, batch.column(0).to_numpy())))

    return some


def _estimated(a: pa.Array, b: pa.Array, n: pa.Array, m: pa.Array, dense: pa.Array) -> pa.Array:
    """Whether a pair may be linked: its estimate is not more than MARGIN standard deviations below the threshold, or its sets are small."""
    n, m = n.to_numpy(), m.to_numpy()
    x, y = (np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(-1, REGISTERS) for c in (a, b))
    items = np.where(dense.to_numpy(zero_copy_only=False), SEEDS, 1)
    j, used = estimates(x, y, n * items, m * items)
    t = PERCENT / 100
    slack = MARGIN * np.sqrt(np.maximum(j * (1 - j), t * (1 - t)) / np.maximum(used, 1))
    return pa.array((np.minimum(n, m) <= SMALL) | (j + slack >= t))


@lru_cache(maxsize=32)
def _cached_set(text: str) -> set[bytes]:
    return shingle_set(text)


def _confirmed(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([similarity(shingle_set(x.as_py()), _cached_set(y.as_py()))[0] for x, y in zip(a, b, strict=True)], pa.bool_())


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, words (SHA-256 of the lower-cased word sequence), n (set size), its registers: dense (SEEDS seeds) and wide (one)."""
    small_batches(docs.sparkSession)
    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    return rows.mapInArrow(_sketches, "id long, words binary, n long, dense binary, wide binary")


def bucket_keys(sketches: DataFrame) -> DataFrame:
    """Rows (key, id): the bands that are not empty."""
    width = 2 * BAND

    def bands(kind: str) -> Column:
        each = F.transform(
            F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)),
            lambda i: F.struct(F.lit(kind).alias("k"), i.alias("i"), F.substring(F.col(kind), i * width + 1, F.lit(width)).alias("r")),
        )
        return F.filter(each, lambda s: s["r"].isNotNull() & (s["r"] != F.lit(bytes(width))))

    keys = F.transform(F.concat(bands("dense"), bands("wide")), lambda s: F.xxhash64(s["k"], s["i"], s["r"]))
    return sketches.select(F.explode(F.array_distinct(keys)).alias("key"), "id")


def components(links: DataFrame) -> DataFrame:
    """(id, label) of all ids in `links` (a, b): the smallest id that can be reached. Labels spread and jump until none changes."""
    edges = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    labels = materialise(
        edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")),
        "near-labels",
    )
    while True:
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels["id"] == near["a"], "left").select(
            "id", F.col("label").alias("old"), F.least("label", "near").alias("label"),
        )
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        spread = spread.join(jump, "label", "left").select("id", "old", F.least("label", "next").alias("label"))
        spread = materialise(spread, "near-labels")
        labels = spread.select("id", "label")
        if spread.filter("old <> label").isEmpty():
            return labels


def _links(pairs: DataFrame, involved: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked: those whose estimate allows it are confirmed on their full sets. Written to the shared folder."""
    regs = involved.select("id", "n", "dense", "wide")
    left, right = (regs.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "dense", "wide")]) for x in "ab")
    dense = F.col("dense_a").isNotNull() & F.col("dense_b").isNotNull()
    kinds = [F.when(dense, F.col(f"dense_{x}")).otherwise(F.col(f"wide_{x}")) for x in "ab"]
    rows = pairs.join(left, "a").join(right, "b").filter(_sizes_allow("n_a", "n_b"))
    rows = rows.select("a", "b", *[k.alias(f"r_{x}") for k, x in zip(kinds, "ab", strict=True)], "n_a", "n_b", dense.alias("dense"))
    rows = rows.filter("r_a is not null and r_b is not null")  # else too different in size for a link
    near = rows.withColumn("may", F.arrow_udf(_estimated, "boolean")("r_a", "r_b", "n_a", "n_b", "dense"))
    near = materialise(near.filter("may").select("a", "b"), "near-pairs")
    left, right = (involved.select(F.col("id").alias(x), F.col("text").alias(f"t_{x}")) for x in "ab")
    texts = near.distinct().join(left, "a").join(right, "b")
    linked = texts.withColumn("linked", F.arrow_udf(_confirmed, "boolean")("t_a", "t_b")).filter("linked")
    return materialise(linked.select("a", "b").distinct(), "near-links")


def _sizes_allow(n: str, m: str) -> Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents (id, label) in buckets that hold more than one component."""
    labelled = members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    labelled = materialise(labelled, "near-labelled")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    mixed = materialise(mixed.select("key"), "near-mixed")
    return labelled.join(mixed, "key", "left_semi").select("id", "label").distinct()


def _open_pairs(rest: DataFrame, involved: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents of different components that may be linked; rest: (id, label) of those in question.

    One order holds for all shingles: first those that one component holds, then
    the others by the number of documents that hold them. What two linked
    documents have in common fills PERCENT of either set and all of the room
    behind the first shingle that both hold, so that one stands in the first
    quarter of both, and the room is large enough.
    """
    texts = rest.join(involved.select("id", "n", "text"), "id").select("id", "label", "n", "text")
    shown = materialise(texts.mapInArrow(_shown, "shingle long, id long, label long, n long"), "near-shingles")
    held = shown.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    held = materialise(held.filter("lo <> hi").select("shingle", "c"), "near-held")
    # most shingles are one component's: they stay out of the shuffles
    known = shown.sparkSession.sparkContext.broadcast(bitmap(held, "shingle"))
    shown = shown.mapInArrow(_maybe(known), "shingle long, id long, label long, n long")
    by_id = Window.partitionBy("id")
    place = F.row_number().over(by_id.orderBy("c", "shingle")) - 1 + F.col("n") - F.count(F.lit(1)).over(by_id)
    rare = shown.join(held, "shingle").withColumn("room", F.col("n") - place).filter(100 * F.col("room") >= PERCENT * F.col("n"))
    rare = materialise(rare.select("shingle", "id", "label", "n", "room"), "near-rare")
    mine, other = (rare.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "label", "n", "room")]) for x in "ab")
    both = F.least("room_a", "room_b")
    fits = (F.col("label_a") > F.col("label_b")) & (100 * both >= PERCENT * (F.col("n_a") + F.col("n_b") - both))
    pairs = mine.join(other, (mine["shingle"] == other["shingle"]) & fits)
    return pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Words are those of the text with A-Z lowered. Links join documents whose sets
    of SHINGLE-word shingles have PERCENT or more of their union in common; a
    shorter text is one shingle; null, empty and wordless texts have no
    shingles and no links. component_id is the smallest id that links reach.

    Documents with the same words in the same order are one class from the start
    (map-side, so thousands of copies cost one row per task); the smallest id
    stands for it. Rows that repeat an id are one document. Rows without id are
    not linked: component_id null, kept true. Empty table: no rows. Other columns
    are ignored, whatever their names.
    """
    texts = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    sketches = materialise(sketch(docs, id_col, text_col), "near-sketches")
    real = sketches.filter("n > 0 and id is not null")
    classes = materialise(real.groupBy("words").agg(F.min("id").alias("id")), "near-classes")
    reps = real.join(classes.select("id"), "id", "left_semi")
    keys = bucket_keys(reps)
    sizes = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi")
    members = materialise(keys.join(materialise(sizes.select("key", "size"), "near-sizes"), "key"), "near-buckets")
    # the hub is the member that meets most others over all its buckets: of edited copies, their original
    central = materialise(members.groupBy("id").agg(F.sum("size").alias("met")), "near-central")
    hubs = members.join(central, "id").groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("minus"))).alias("h"))
    hubs = materialise(hubs.select("key", (-F.col("h.minus")).alias("hub")), "near-hubs")
    involved = texts.join(central.select("id"), "id", "left_semi").join(reps.select("id", "n", "dense", "wide"), "id")
    involved = materialise(involved, "near-involved")
    to_hub = members.join(hubs, "key").filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    links = _links(to_hub, involved)
    labels = components(links)
    links = links.unionByName(_links(_open_pairs(_open(members.select("key", "id"), labels), involved), involved))
    labels = components(links)
    found = classes.join(labels, "id", "left").select("words", F.coalesce("label", "id").alias("component_id"))
    rows = sketches.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("words")).alias("words"))
    out = rows.join(found, "words", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")
    )
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of each group those with the smallest id, and all rows without id.

    Rows that repeat the smallest id all stay. Null, empty and wordless texts are
    in no group and stay. Empty table: no rows.
    """
    dropped = materialise(groups(docs, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("_dropped")).distinct(), "near-dropped")
    return docs.join(dropped, quoted(id_col).cast("long") == F.col("_dropped"), "left_anti")

