"""BPE encoding and decoding of whole texts, with tree concatenation for long ones.

Texts without long stretches are encoded where they are. A text longer than
SEGMENT characters, or with more than UNSPLIT of them unsplit, falls into parts that
tasks encode in parallel: at white space where there is some, and a long pre-token
by halves down to leaves. Joining two halves re-encodes a window around the seam,
twice as wide each time, until both of its ends agree with their neighbours: a
sequence of tokens is the encoding of its text exactly if each pair of neighbours
encodes to itself, so agreement at both ends proves the whole.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrace.llm import tokens
from worktrace.llm.common import materialise, packed, quoted, salt_count, small_batches

SEGMENT = 1 << 16  # characters of a text, and of a part
UNSPLIT = 4096  # characters without white space, and symbols of a pre-token


class Merges:
    """The merges of a file with word ends, run on symbols; knows each token's symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.end, self.ids = model["end_of_word_suffix"] or "", model["vocab"]
        self.ranks = {(a, b): k for k, (a, b) in enumerate(model["merges"])}
        self.parts = {a + b: (a, b) for a, b in model["merges"]}
        self.names = {i: t for t, i in self.ids.items()}

    def symbols(self, token: str) -> list[str]:
        """The symbols a token was merged from."""
        out, todo = [], [token]
        while todo:
            t = todo.pop()
            if t in self.parts:
                todo.extend(reversed(self.parts[t]))
            else:
                out.append(t)
        return out

    def merge(self, symbols: Sequence[str]) -> list[str]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        items: list[str | None] = list(symbols)
        n = len(items)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, items[i], items[i + 1]) for i in range(n - 1) if (r := self.ranks.get((items[i], items[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if items[i] != a or j >= n or items[j] != b:
                continue
            items[i], items[j] = a + b, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                m = after[k] if k >= 0 else n
                if k >= 0 and m < n and (r := self.ranks.get((items[k], items[m]))) is not None:
                    heapq.heappush(heap, (r, k, items[k], items[m]))
        return [x for x in items if x is not None]

    def agree(self, a: str, b: str) -> bool:
        return self.merge(self.symbols(a) + self.symbols(b)) == [a, b]

    def join(self, left: list[str], right: list[str]) -> list[str]:
        """The encoding of the two halves' text, from their encodings."""
        if not left or not right:
            return left or right
        width = 1
        while True:
            a, b = max(len(left) - width, 0), min(width, len(right))
            middle = self.merge([s for t in left[a:] + right[:b] for s in self.symbols(t)])
            if (a == 0 or self.agree(left[a - 1], middle[0])) and (b == len(right) or self.agree(middle[-1], right[b])):
                return left[:a] + middle + right[b:]
            width *= 2

    def tree(self, leaves: list[list[str]]) -> list[str]:
        while len(leaves) > 1:
            leaves = [self.join(leaves[i], leaves[i + 1]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else []


@lru_cache(maxsize=2)
def _merges(path: str) -> Merges:
    return Merges(path)


def halves(symbols: Sequence[str], most: int) -> list[Sequence[str]]:
    """Leaves of at most `most` symbols, by halving."""
    if len(symbols) <= most:
        return [symbols]
    middle = len(symbols) // 2
    return halves(symbols[:middle], most) + halves(symbols[middle:], most)


def parts(text: str, path: str, segment: int = SEGMENT, unsplit: int = UNSPLIT) -> Iterator[tuple[int, int, str, str]]:
    """(part, leaf, kind, content) of a text, in order.

    Kinds: text (encode it), ids (tokens known), leaf and last (symbols of a
    pre-token longer than `unsplit`, the last with its word end to come).
    """
    tokenizer, k = tokens.load(path), 0
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    run = re.compile(r"(?:\S|[\x1c-\x1f]){%d,}" % (unsplit + 1))

    def stretches(some: str) -> Iterator[str]:
        at = 0
        while len(some) - at > segment:
            cut = max(some.rfind(c, at + 1, at + segment) for c in " \n")
            if cut < 0:
                cut = min((j for j in (some.find(c, at + segment) for c in " \n") if j >= 0), default=len(some))
            yield some[at:cut]
            at = cut
        yield some[at:]

    at = 0
    for m in [*run.finditer(text), None]:
        for s in stretches(text[at : m.start()] if m else text[at:]):
            yield k, 0, "text", s
            k += 1
        if m is None:
            return
        at = m.end()
        for piece in re.split("(" + "|".join(map(re.escape, special)) + ")", m.group()) if special else [m.group()]:
            if piece in special:
                yield k, 0, "ids", str(special[piece])
                k += 1
                continue
            normal = tokenizer.normalizer.normalize_str(piece) if tokenizer.normalizer else piece
            for letters, _ in tokenizer.pre_tokenizer.pre_tokenize_str(normal):
                if len(letters) <= unsplit:
                    yield k, 0, "ids", " ".join(str(t.id) for t in tokenizer.model.tokenize(letters))
                else:
                    leaves = halves(letters, unsplit)
                    for n, leaf in enumerate(leaves):
                        yield k, n, "last" if n == len(leaves) - 1 else "leaf", leaf
                k += 1


def encode_part(kind: str, content: str, path: str) -> bytes:
    """The ids of one part or leaf, as little-endian 32-bit integers."""
    if kind == "text":
        return tokens.word_level(path).ids([content])[0]
    if kind == "ids":
        return np.array(content.split(), "<u4").tobytes()
    merges = _merges(path)
    symbols = [*content[:-1], content[-1] + merges.end] if kind == "last" else list(content)
    return np.array([merges.ids[t] for t in merges.merge(symbols)], "<u4").tobytes()


def assemble(encoded: Sequence[tuple[int, int, str, bytes]], path: str) -> bytes:
    """The ids of a text from those of its parts, in order; leaves are joined as a tree."""
    out, leaves = [], []
    for _, _, kind, ids in encoded:
        if kind in ("leaf", "last"):
            leaves.append([_merges(path).names[i] for i in np.frombuffer(ids, "<u4").tolist()])
            if kind == "last":
                out.append(np.array([_merges(path).ids[t] for t in _merges(path).tree(leaves)], "<u4").tobytes())
                leaves = []
        else:
            out.append(ids)
    return b"".join(out)


def decode_ids(ids: bytes, path: str) -> str:
    return tokens.load(path).decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def _struct(ids: list[bytes], path: str) -> pa.Array:
    return pa.StructArray.from_arrays(
        [pa.array(ids, pa.binary()), pa.array([decode_ids(i, path) for i in ids], pa.string())], names=["ids", "decoded"],
    )


_CODED = "ids binary, decoded string"


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", segment: int = SEGMENT, unsplit: int = UNSPLIT) -> DataFrame:
    """Rows (row, ids, decoded): all columns of a row of `docs`, its ids, and their text.

    ids are those of the tokenizers library for the whole text, special tokens
    not added, as little-endian unsigned 32-bit integers; decoded is the library's
    decode of them, special tokens kept. Null and empty texts have no ids and
    decode to the empty text. Repeated rows each get their own. An empty table
    gives no rows. Each different long text is encoded once, its parts in parallel;
    the encoded parts of one text, some bytes a token, meet in one task. Rows of
    one long text take its ids in as many places as they have salts.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    text = quoted(text_col)
    long_run = F.length(text) > unsplit
    is_long = F.coalesce((F.length(text) > segment) | (long_run & text.rlike(r"[\S\x1c-\x1f]{%d}" % (unsplit + 1))), F.lit(False))

    def whole(texts: pa.Array) -> pa.Array:
        return _struct(tokens.word_level(tokenizer).ids(texts.to_pylist()), tokenizer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, t in zip(batch.column(0), batch.column(1), strict=True):
                found = [(digest.as_py(), *p) for p in parts(t.as_py(), tokenizer, segment, unsplit)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)],
                    names=["digest", "part", "leaf", "kind", "content"],
                )

    def each(kinds: pa.Array, contents: pa.Array) -> pa.Array:
        return pa.array([encode_part(k.as_py(), c.as_py(), tokenizer) for k, c in zip(kinds, contents, strict=True)], pa.binary())

    def joined(lists: pa.Array) -> pa.Array:
        rows = [[(p["part"], p["leaf"], p["kind"], p["ids"]) for p in x.as_py()] for x in lists]
        return _struct([assemble(r, tokenizer) for r in rows], tokenizer)

    short = docs.filter(~is_long).select(packed(docs).alias("row"), F.arrow_udf(whole, _CODED)(text).alias("c"))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salt_count(spark))).cast("int")
    rows = materialise(docs.filter(is_long).select(packed(docs).alias("row"), F.sha2(text, 256).alias("digest"), salt.alias("salt")), "bpe-long")
    texts = rows.groupBy("digest").agg(F.first(F.col("row").getField(text_col)).alias("text"))
    pieces = texts.mapInArrow(cut, "digest string, part int, leaf int, kind string, content string")
    spread = pieces.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "digest", "part", "leaf")
    coded = spread.withColumn("ids", F.arrow_udf(each, "binary")("kind", "content"))
    lists = coded.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("part", "leaf", "kind", "ids"))).alias("parts"))
    whole_again = lists.select("digest", F.arrow_udf(joined, _CODED)("parts").alias("c"))
    needed = whole_again.join(rows.select("digest", "salt").distinct(), "digest")
    long = rows.join(needed, ["digest", "salt"]).select("row", "c")
    return short.unionByName(long).select("row", "c.ids", "c.decoded")


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
