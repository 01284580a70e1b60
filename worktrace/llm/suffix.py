"""Repeated passages through sparse suffix arrays.

Of each document only the suffixes at content-selected positions are kept: the
least hash of KGRAM words among SPREAD positions (a minimiser). A passage of LENGTH
words belongs to the position selected in its first SPREAD; two copies of it select
the same one, so both keep a suffix there, and the suffixes agree on CORE words at
least. Each suffix knows the passages that belong to it, from the one that begins
most words before its position to the one that begins least before.

Suffixes that agree on all of these are one class, found by two hashes alone; only
classes whose core another class shares go on, with the words around the core as
64-bit hashes. They are dealt out by core, and a core of many classes by parts of
it. Each task sorts its own, compares neighbours in the order and extends the
matches right and left; what a part leaves open is settled between the parts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worktrace.llm.common import materialise, quoted, small_batches
from worktrace.llm.hashing import hashed_words, mix

LENGTH = 50  # words of the shortest passage reported
KGRAM = 8  # a power of two
SPREAD = 24
CORE = LENGTH - SPREAD + 1  # words that copies share from the selected position on
REST = LENGTH - CORE  # words to extend by, right and left together
PART = 8_192  # classes of one core that a task sorts together
_BATCH_BYTES = 4 << 20  # of text, and
_CHUNK = 16_384  # suffixes that a task holds as arrays

_U = np.uint64
_SELECTED = "core long, own long, id long, at long"
_SUFFIX = "core long, part int, id long, at long, left binary, right binary"
_COMPARED = "id long, start long, end long, passage long"


def _step(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(h * _U(0x9FB21C651E98DF25) + word)


def _grams(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of KGRAM words, each from those of its halves."""
    width = 1
    while width < KGRAM:
        words = _step(words[:-width], words[width:])
        width *= 2
    return words


def _least(grams: np.ndarray, n: int) -> np.ndarray:
    """The position of the least of SPREAD grams from each of the first n positions on; of equal ones the first."""
    out, some, bits = np.empty(n, dtype=np.int64), 1 << 16, _U(17)
    for a in range(0, n, some):
        k = min(some, n - a)
        own = grams[a : a + k + SPREAD - 1]
        key = (own >> bits << bits) | np.arange(len(own), dtype=_U)
        width = 1
        while 2 * width <= SPREAD:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        least = np.minimum(key[:k], key[SPREAD - width : SPREAD - width + k])
        out[a : a + k] = (least & _U((1 << 17) - 1)).astype(np.int64) + a
    return out


def selected(words: np.ndarray, counts: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Selected positions of texts one after the other, and the first and last beginning of the passages that belong to each.

    words: the hashes of all texts' words; counts: words of each text. Positions
    are numbers in `words`.
    """
    none = np.empty(0, dtype=np.int64)
    if len(words) < LENGTH:
        return none, none, none
    with np.errstate(over="ignore"):
        least = _least(_grams(words), len(words) - LENGTH + 1)
    ends = np.cumsum(np.asarray(counts, dtype=np.int64))
    text = np.repeat(np.arange(len(ends)), counts)[: len(least)]
    begin = np.flatnonzero(np.arange(len(least)) + LENGTH <= ends[text])
    if not len(begin):
        return none, none, none
    at, of = least[begin], text[begin]
    fresh = np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])])
    first = np.flatnonzero(fresh)
    return at[first], begin[first], begin[np.concatenate([first[1:], [len(begin)]]) - 1]


def _hashes(words: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each suffix: the hash of its core, and of all passages that belong to it."""
    with np.errstate(over="ignore"):
        core = np.full(len(at), _U(CORE), dtype=_U)
        for k in range(CORE):
            core = _step(core, words[at + k])
        own = _step(core, (at - first).astype(_U) << _U(32) | (at - last).astype(_U))
        span, k = last + LENGTH - first, 0
        rest = np.arange(len(at))
        while len(rest):
            own[rest] = _step(own[rest], words[first[rest] + k])
            k += 1
            rest = rest[span[rest] > k]
    return core.view(np.int64), own.view(np.int64)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, words, counts): the word hashes of rows from..to of a text column, some megabytes at a time."""
    raw = [(t.as_py() or "").encode("utf-8", "replace") for t in column]
    a = 0
    while a < len(raw):
        b, size = a + 1, len(raw[a])
        while b < len(raw) and size + len(raw[b]) < _BATCH_BYTES:
            size += len(raw[b]) + 1
            b += 1
        words, starts = hashed_words(b"\n".join(raw[a:b]))
        ends = np.cumsum([len(t) + 1 for t in raw[a:b]])
        yield a, b, words, np.diff(np.searchsorted(starts, ends), prepend=0)
        a = b


def _packed(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A position in its text, with how many words before it the first and the last passage begin."""
    return at << 16 | (at - first) << 8 | (at - last)


def _selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, words, counts in _texts(batch.column(1)):
            at, first, last = selected(words, counts)
            if len(at):
                core, own = _hashes(words, at, first, last)
                begins = np.cumsum(counts) - counts
                text = np.searchsorted(begins, at, side="right") - 1
                pack = _packed(at - begins[text], first - begins[text], last - begins[text])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (core, own, ids[a:b][text], pack)], names=["core", "own", "id", "at"])


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] of them), begin[1], ..."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def _binary(words: np.ndarray, begin: np.ndarray, size: np.ndarray, step: int = 1) -> pa.Array:
    """The words from each begin on (step -1: backwards) as binaries of 8 bytes a word."""
    ends = np.cumsum(size)
    at = np.repeat(begin, size) + step * (np.arange(ends[-1]) - np.repeat(ends - size, size))
    offsets = np.concatenate([[0], 8 * ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(words[at].tobytes())])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, [(core, own, at, part)]) -> the suffixes' words beyond the core: right of it, and left of the position backwards."""
    for batch in batches:
        found = batch.column(2)
        rows, offsets = found.values, found.offsets.to_numpy()
        core, own, pack, part = (rows.field(k).to_numpy(zero_copy_only=False) for k in range(4))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, words, counts in _texts(batch.column(1)):
            begins, size = np.cumsum(counts) - counts, offsets[a + 1 : b + 1] - offsets[a:b]
            text, mine = np.repeat(np.arange(b - a), size), slice(offsets[a], offsets[b])
            at, before, least = pack[mine] >> 16, pack[mine] >> 8 & 255, pack[mine] & 255
            there = at - least + LENGTH <= counts[text]  # else of another text under the same id
            text, at, before, least = text[there], at[there] + begins[text[there]], before[there], least[there]
            c, o, p = core[mine][there], own[mine][there], part[mine][there]
            same = np.array([], dtype=bool)
            if len(at):
                own_core, own_all = _hashes(words, at, at - before, at - least)
                same = (own_core == c) & (own_all == o)
            if not same.any():
                continue
            at, before, least, i = at[same], before[same], least[same], ids[a:b][text[same]]
            columns = [pa.array(c[same]), pa.array(p[same]), pa.array(i), pa.array(at - begins[text[same]])]
            yield pa.RecordBatch.from_arrays(
                [*columns, _binary(words, at - 1, before, -1), _binary(words, at + CORE, REST - least)],
                names=["core", "part", "id", "at", "left", "right"],
            )


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Binaries of 8 bytes a word as rows of REST words (0 beyond their end), and their numbers of words."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = np.diff(offsets) // 8
    out = np.zeros((len(size), REST), dtype=_U)
    flat = np.frombuffer(column.buffers()[2] or b"", _U)[offsets[0] // 8 : offsets[-1] // 8]
    out[np.repeat(np.arange(len(size)), size), _ranges(np.zeros(len(size), dtype=np.int64), size)] = flat
    return out, size


def _prefixes(words: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, ... words of each row."""
    out = np.zeros((len(words), REST + 1), dtype=_U)
    with np.errstate(over="ignore"):
        for k in range(REST):
            out[:, k + 1] = _step(out[:, k], words[:, k])
    return out


def matches(core: np.ndarray, part: np.ndarray, left: tuple, right: tuple) -> np.ndarray:
    """Which passages of the sorted suffixes occur twice: rows by words before the position from 0 to REST.

    core, part: runs of equal ones are compared. left, right: words and their
    numbers. Neighbours in the order share most to the right; for each extent to
    the right, a stretch of neighbours that share it is extended to the left: the
    suffixes of the stretch are sorted by what lies before them and neighbours
    compared again.
    """
    (_, before), (rights, after) = left, right
    n = len(core)
    twice = np.zeros((n, REST + 1), dtype=bool)
    if n < 2:
        return twice
    same = (core[1:] == core[:-1]) & (part[1:] == part[:-1])
    equal = (rights[1:] == rights[:-1]) & (np.arange(REST) < np.minimum(after[1:], after[:-1])[:, None])
    shared = np.where(same, np.where(equal.all(axis=1), REST, equal.argmin(axis=1)), -1)
    most = np.maximum(np.concatenate([[-1], shared]), np.concatenate([shared, [-1]]))
    lefts = _prefixes(left[0])
    for extent in range(REST + 1):
        to_left = REST - extent
        rows = np.flatnonzero((most >= extent) & (after >= extent) & (before >= to_left))
        if len(rows) < 2:
            continue
        stretch = np.concatenate([[0], np.cumsum(shared < extent)])[rows].astype(_U)
        with np.errstate(over="ignore"):
            key = _step(stretch + _U(1), lefts[rows, to_left])
        order = np.argsort(key, kind="stable")
        pairs = key[order][1:] == key[order][:-1]
        found = np.concatenate([[False], pairs]) | np.concatenate([pairs, [False]])
        twice[rows[order[found]], to_left] = True
    return twice


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes -> spans (id, start, end, null) of the passages found twice.

    Of cores in several parts also (id, start, end, hash) of each other passage, and
    (null, null, null, hash) of one passage of each kind found twice.
    """

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = [c.chunk(0) for c in table.combine_chunks().columns]
        core, part, ids, at = (c.to_numpy() for c in columns[:4])
        left, right = map(_matrix, columns[4:])
        twice = matches(core, part, left, right)
        some = twice.any(axis=1)
        furthest, nearest = REST - twice[:, ::-1].argmax(axis=1), twice.argmax(axis=1)
        rows = [(ids[some], at[some] - furthest[some], at[some] - nearest[some] + LENGTH, None)]
        many = np.flatnonzero(part >= 0)
        if len(many):
            own = np.zeros_like(twice)
            for k in range(REST + 1):
                own[:, k] = (left[1] >= k) & (right[1] >= REST - k) & (part >= 0)
            before, after = _prefixes(left[0]), _prefixes(right[0])
            row, k = np.nonzero(own)
            with np.errstate(over="ignore"):
                passage = _step(_step(core[row].view(_U) + k.astype(_U), before[row, k]), after[row, REST - k]).view(np.int64)
            known = twice[row, k]
            rows.append((ids[row[~known]], at[row[~known]] - k[~known], at[row[~known]] - k[~known] + LENGTH, passage[~known]))
            rows.append((None, None, None, np.unique(passage[known])))
        for columns in rows:
            n = max((len(c) for c in columns if c is not None), default=0)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(n, pa.int64()) if c is None else pa.array(c) for c in columns],
                    names=["id", "start", "end", "passage"],
                )

    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) >= _CHUNK:
            table = pa.concat_tables(held).combine_chunks()
            core, part = table.column(0).to_numpy(), table.column(1).to_numpy()
            ends = np.flatnonzero((core[1:] != core[:-1]) | (part[1:] != part[:-1]))
            if len(ends):
                yield from out(table.slice(0, int(ends[-1]) + 1))
                table = table.slice(int(ends[-1]) + 1)
            held = [table]
    if held:
        yield from out(pa.concat_tables(held))


def _between_parts(compared: DataFrame) -> DataFrame:
    """Spans of the passages that the parts of a core have only together. A passage has a row of each part at most."""
    by = compared.filter("passage is not null").groupBy("passage").agg(
        F.count(F.lit(1)).alias("n"),
        F.collect_list(F.when(F.col("id").isNotNull(), F.struct("id", "start", "end"))).alias("spans"),
    )
    return by.filter("n > 1").select(F.explode("spans").alias("s")).select("s.*")


def _joined(spans: DataFrame) -> DataFrame:
    """Spans of a document that touch or overlap become one."""
    by_doc = Window.partitionBy("id").orderBy("start", "end")
    reach = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1))
    numbered = marked.withColumn("_n", F.sum("_new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("id", "_n").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """doc_id, start, end, n_words: the stretches of words (from 0, end excluded) in passages found twice or more.

    A word is in if a passage of LENGTH words around it occurs at two places or
    more, in other documents or in its own; stretches are as long as they can be
    and don't touch. Words are compared as they are, by 64-bit hashes. Null, empty
    and short texts have none. Rows that repeat an id are one document, but copies
    of each other. Rows without id are not compared. Empty table: no rows. Other
    columns are ignored, whatever their names.

    `part`: classes of one core that are sorted together; the result is the same
    for any.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text")).filter("id is not null and text is not null")
    found = materialise(texts.mapInArrow(_selected, _SELECTED), "suffix-positions")
    cores = found.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("own").alias("lo"), F.max("own").alias("hi")).filter("n > 1")
    shared = materialise(cores.select("core", (F.col("lo") < F.col("hi")).alias("mixed")), "suffix-cores")
    kept = materialise(found.join(shared, "core"), "suffix-shared")
    order, mixed = F.xxhash64("id", "at"), kept.filter("mixed")
    classes = mixed.groupBy("core", "own").agg(F.count(F.lit(1)).alias("n"), F.max_by("id", order).alias("id"), F.max_by("at", order).alias("at"))
    classes = materialise(classes, "suffix-classes")
    large = materialise(classes.groupBy("core").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > part), "suffix-large")
    dealt = classes.join(large, "core", "left").select(
        "id",
        F.struct("core", "own", "at", F.coalesce(F.pmod("own", F.ceil(F.col("c") / part)), F.lit(-1)).cast("int").alias("part")).alias("f"),
    )
    by_text = dealt.groupBy("id").agg(F.collect_list("f").alias("found"))
    suffixes = texts.join(by_text, "id").select("id", "text", "found").mapInArrow(_suffixes, _SUFFIX)
    sorted_runs = suffixes.repartition("core", "part").sortWithinPartitions("core", "part", "right")
    compared = materialise(sorted_runs.mapInArrow(_compared, _COMPARED), "suffix-compared")
    copies = mixed.join(classes.filter("n > 1").select("core", "own"), ["core", "own"], "left_semi")
    spans = kept.filter("not mixed").unionByName(copies).select("id", *span(F.col("at")))
    spans = spans.unionByName(compared.filter("passage is null").select("id", "start", "end")).unionByName(_between_parts(compared))
    return _joined(spans).select(F.col("id").alias("doc_id"), "start", "end", (F.col("end") - F.col("start")).alias("n_words"))


def span(at: Column) -> list[Column]:
    """start and end of all passages that belong to a packed position."""
    place = F.shiftright(at, 16)
    return [(place - F.shiftright(at, 8).bitwiseAND(F.lit(255))).alias("start"), (place - at.bitwiseAND(F.lit(255)) + LENGTH).alias("end")]
