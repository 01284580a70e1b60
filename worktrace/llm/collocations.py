"""Phrase collocations by marginalising the counts of the longest windows.

Each word leads one window of SPAN words, padded behind the end of its piece. Equal
windows are counted once; ROLLUP over their words then sums them to the counts of
all shorter phrases, since every occurrence of a phrase begins exactly one window.

A first pass counts hashes of neighbouring words. A pair whose hash is seen too rarely
lies in no candidate, so a window is padded from there on, which leaves far fewer
different windows. Hashes that collide only let more windows through; all counts that
come out are sums of windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worktrace.llm.common import bitmap, in_bitmap, materialise, quoted, salt_count, small_batches
from worktrace.llm.hashing import mix

SPAN = 4  # words of the longest phrase
MIN_COUNT = 30  # a candidate's least count
COVERED = 80  # percent of its occurrences inside one longer candidate that drop a candidate
TOP = 2000  # phrases of a language in the report

BATCH = 1_500_000  # words that a task counts at once
VOCABULARY = 400_000  # different words that a task numbers before it begins anew
CHUNK = 4 << 20  # bytes of a text that are split at once

# one byte for all that ends a piece; it stands in no UTF-8 text
_CLASSES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz " + b"\xff" * 10)


class _Words(dict):
    """Numbers of words from 1; 0 ends a piece."""

    def __init__(self) -> None:
        super().__init__({b"\xff": 0})
        self.list: list[bytes] = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.list)
        self.list.append(word)
        return n


def _chunks(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > CHUNK:
        cut = max(data.rfind(b, at + 1, at + CHUNK) for b in (b" ", b"\xff"))
        if cut < 0:  # a word of megabytes
            cut = min((k for k in (data.find(b, at + CHUNK) for b in (b" ", b"\xff")) if k >= 0), default=len(data))
        yield data[at:cut]
        at = cut
    yield data[at:]


def _numbers(data: bytes, words: _Words) -> Iterator[np.ndarray]:
    """The words of a text as numbers, with zeros where pieces end, some megabytes of text at a time."""
    for chunk in _chunks(data.translate(_CLASSES)):
        found = chunk.replace(b"\xff", b" \xff ").split()
        yield np.fromiter(map(words.__getitem__, found), dtype=np.int64, count=len(found))


def _batches(batches: Iterator[pa.RecordBatch], ahead: int) -> Iterator[tuple[str, np.ndarray, int, list[bytes]]]:
    """(language, numbers, how many of them lead a window, words), so that each word of the task's texts leads once.

    Some `ahead` words behind the last that leads are there too.
    """
    words, held, total = _Words(), {}, 0

    def flush(whole: bool) -> Iterator[tuple[str, np.ndarray, int, list[bytes]]]:
        for lang, parts in held.items():
            numbers = np.concatenate(parts)
            keep = 0 if whole else min(ahead, len(numbers))
            yield lang, np.concatenate([numbers, np.zeros(ahead - keep, dtype=np.int64)]), len(numbers) - keep, words.list
            held[lang] = [numbers[len(numbers) - keep :]]

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not text.is_valid:
                continue
            for numbers in _numbers(text.as_buffer().to_pybytes(), words):
                held.setdefault(lang, []).append(numbers)
                total += len(numbers)
                if total >= BATCH:  # inside a text; what the last words lead comes with the next part
                    yield from flush(False)
                    total = 0
            held[lang].append(np.zeros(1, dtype=np.int64))
            if len(words.list) > VOCABULARY:
                yield from flush(True)
                words, held, total = _Words(), {}, 0
    yield from flush(True)


def _pair_keys(lang: str, numbers: np.ndarray, words: list[bytes]) -> np.ndarray:
    """A 64-bit key for each word and its successor, 0 where a piece ends between them."""
    used = np.unique(numbers)
    of = np.zeros(len(words), dtype=np.uint64)
    seed = xxhash.xxh3_64_intdigest(lang)
    of[used] = [xxhash.xxh3_64_intdigest(words[i], seed) for i in used.tolist()]
    h = of[numbers]
    with np.errstate(over="ignore"):
        keys = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    keys[(numbers[:-1] == 0) | (numbers[1:] == 0)] = 0
    return keys


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, numbers, n, words in _batches(batches, 1):
        keys, counts = np.unique(_pair_keys(lang, numbers, words)[:n], return_counts=True)
        keys, counts = keys[keys != 0], counts[keys != 0]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], ["key", "n"])


def _count_windows(frequent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """frequent: a broadcast bitmap of the pairs that may be frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, numbers, n, words in _batches(batches, SPAN - 1):
            goes_on = in_bitmap(frequent.value, _pair_keys(lang, numbers, words))
            goes_on &= (numbers[:-1] > 0) & (numbers[1:] > 0)
            lead = np.flatnonzero(numbers[:n] > 0)
            # equal windows: those of k words by the group of their first k - 1 and the next word
            group, columns, alive = numbers[lead], [numbers[lead]], np.ones(len(lead), dtype=bool)
            for k in range(1, SPAN):
                alive = alive & goes_on[lead + k - 1]
                word = np.where(alive, numbers[lead + k], 0)
                columns.append(word)
                some = np.flatnonzero(alive)
                _, where = np.unique(group[some] * len(words) + word[some], return_inverse=True)
                group = group.copy()
                group[some] = where + (group.max(initial=0) + 1)
                if k < SPAN - 1:  # small numbers again
                    group = np.unique(group, return_inverse=True)[1]
            _, first, counts = np.unique(group, return_index=True, return_counts=True)
            text = pa.array(words, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(first), pa.string()), *(text.take(pa.array(c[first])).cast(pa.string()) for c in columns), pa.array(counts, pa.int64())],
                ["lang", *(f"w{k}" for k in range(SPAN)), "n"],
            )

    return count


def _may_be_frequent(rows: DataFrame) -> bytes:
    """A bitmap of the pairs that are seen MIN_COUNT times."""
    pairs = rows.mapInArrow(_count_pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)
    return bitmap(pairs, "key")


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, words, f): all phrases of up to SPAN words that occur MIN_COUNT times, and for each lang its n, of no words."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(quoted(lang_col), F.lit("und")).alias("lang"), quoted(text_col).alias("text"))
    frequent = spark.sparkContext.broadcast(_may_be_frequent(rows))
    names = [f"w{k}" for k in range(SPAN)]
    windows = rows.mapInArrow(_count_windows(frequent), f"lang string, {', '.join(f'{c} string' for c in names)}, n long")
    windows = materialise(windows.groupBy("lang", *names).agg(F.sum("n").alias("n")), "collocation-windows")
    # windows are the counts of the longest phrases; the rollup sums them to those of all shorter ones and to n
    *shorter, longest = names
    summed = windows.rollup("lang", *shorter).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    words = F.filter(F.array(*shorter), lambda w: w.isNotNull())  # null: summed over; empty: padded
    counts = summed.filter(F.col("g") < (1 << len(shorter))).select("lang", words.alias("words"), "f")
    counts = counts.unionByName(windows.filter(F.col(longest) != "").select("lang", F.array(*names).alias("words"), F.col("n").alias("f")))
    last = F.get("words", F.size("words") - 1)
    return counts.filter((F.size("words") == 0) | (last != "") & (F.col("f") >= MIN_COUNT))


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and line ends, pieces
    into words at spaces and tabs. n: all words of the language; a: occurrences of the
    phrase within pieces; l, r: those of its parts at the cut with the lowest score
    floor(2000000 * a / (l + r)), the first of equal ones. Phrases of which COVERED
    percent lie in one longer candidate are left out. Ranks are by score and a,
    descending, then by phrase in byte order, so there are no ties.

    Null and empty texts have no words; a null language is `und`, together with rows
    that say so; repeated rows count as often as they stand there; ids and other
    columns are not read. A language without candidates, and an empty table, give no
    rows. Texts of any length count whole.
    """
    counts = materialise(phrase_counts(docs, text_col, lang_col), "collocation-phrases")
    part = lambda begin, n: F.array_join(F.slice("words", begin, n), " ")
    size, wide = F.size("words"), lambda c: F.col(c).cast("decimal(20,0)")
    phrases = counts.filter(size > 0).select("lang", F.array_join("words", " ").alias("part"), "f")
    candidates = counts.filter(size > 1).select("lang", "words", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"))

    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    sides = cuts.select("lang", "phrase", "a", "k", F.posexplode(F.array(part(F.lit(1), F.col("k")), part(F.col("k") + 1, size - F.col("k")))).alias("side", "part"))
    found = sides.join(phrases, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r")
    )
    score = F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("b")
    scored = found.groupBy("lang", "phrase", "a").agg(lowest)

    spans = [(b, n) for n in range(2, SPAN) for b in range(1, SPAN - n + 2)]
    parts = F.array(*[F.when(size >= b + n - 1, part(F.lit(b), F.lit(n))) for b, n in spans])
    inner = candidates.filter(size > 2).select("lang", "a", "phrase", F.explode(parts).alias("part")).filter("part is not null and part <> phrase")
    inner = inner.groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("longer"))
    stands = scored.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * COVERED))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = stands.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("b.score").alias("score"))
    rows = rows.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(salt_count(docs.sparkSession))))
    for keys in (["lang", "_s"], ["lang"]):  # the first of each salt, then of those
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    n = counts.filter(size == 0).select("lang", F.col("f").alias("n"))
    return rows.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
