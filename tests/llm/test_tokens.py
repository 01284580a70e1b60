import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F

from tests.llm.conftest import words
from worktrace.llm import bpe_tree, token_counts, token_store, tokens
from worktrace.llm.common import new_path

PIECES = [
    "a", "the", "ing", "é", "İ", "ß", " ", "  ", "   ", "\n", "\t", "\r\n", "'s", "'ll", "12", "½", "<|endoftext|>",
    "<|startoftext|>", "\xa0", "\x1c", "\x85", "é", "漢字", "😀", "!!", "‍", "Σ", "\x00", "K",
]


def odd_texts(n=3000):
    r = random.Random(1)
    return ["".join(r.choices(PIECES, k=r.randint(1, 30))) for _ in range(n)] + ["", " ", "  a", "a ", "a  ", "\n a", "x" * 500]


def le(ids):
    return np.array(ids, "<u4").tobytes()


def test_ids_and_counts_equal_the_library(tokenizer):
    texts = odd_texts()
    for name, make in (("byte_bpe_50k.json", tokens.byte_level), ("word_bpe_49k.json", tokens.word_level)):
        library, mine = tokens.load(tokenizer(name)), make(tokenizer(name))
        want = [le(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
        assert mine.ids(texts) == want and [mine.ids([t])[0] for t in texts] == want
    counter = tokens.ByteLevel(tokenizer("byte_bpe_50k.json"), tokens.whole_tokens(tokenizer("byte_bpe_50k.json")))
    library = tokens.load(tokenizer("byte_bpe_50k.json"))
    assert counter.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_a_small_cache_changes_nothing(tokenizer, monkeypatch):
    texts = odd_texts(300)
    want = tokens.word_level(tokenizer("word_bpe_49k.json")).ids(texts)
    monkeypatch.setattr(tokens, "CACHE", 6)
    assert tokens.WordLevel(tokenizer("word_bpe_49k.json")).ids(texts) == want


def test_many_pre_tokens_are_not_merged_again(tokenizer):
    """Prose of ever new words: most of 300,000 different ones are known when they come again."""
    path, r = tokenizer("byte_bpe_50k.json"), random.Random(3)
    different = sorted({"".join(r.choices("abdeghilmnorstuz", k=9)) for _ in range(300_000)})
    texts = [" ".join(different[k : k + 1000]) for k in range(0, len(different), 1000)]
    mine, asked = tokens.ByteLevel(path), []
    find = mine._ids.cache.find
    mine._ids.cache.find = lambda w: asked.append(w) or find(w)
    first, n = mine.ids(texts), len(asked)
    assert n >= 299_000 and mine.ids(texts) == first
    assert len(asked) - n < n // 4
    assert first[-3:] == [le(e.ids) for e in tokens.load(path).encode_batch(texts[-3:], add_special_tokens=False)]


def test_pre_tokens_that_share_a_place_are_told_apart(tokenizer, monkeypatch):
    """Few places and few ids in each; characters of one byte and of two, up to the longest key and beyond."""
    r = random.Random(4)
    some = ["a", "A", "\xe9", "\u0141", "\u0142", "\u0220", "Aa", "zz", "9", "!", "'s"]
    plain = [" ".join("".join(r.choices(some[: r.choice([3, 11])], k=r.randint(1, 40))) for _ in range(20)) for _ in range(200)]
    texts = plain + odd_texts(300)
    for name, make in (("byte_bpe_50k.json", tokens.ByteLevel), ("word_bpe_49k.json", tokens.WordLevel)):
        want = [le(e.ids) for e in tokens.load(tokenizer(name)).encode_batch(texts, add_special_tokens=False)]
        for slots, kept in ((1, 1), (16, 3), (1 << 10, 12)):
            monkeypatch.setattr(tokens, "SLOTS", slots)
            monkeypatch.setattr(tokens, "KEPT", kept)
            mine = make(tokenizer(name))
            assert [mine.ids([t])[0] for t in texts] == want and mine.ids(texts) == want


def test_plain_pre_tokens_are_those_of_the_patterns():
    r = random.Random(8)
    plain = ["a", "The", "é", "ß", " ", "  ", "\n", "\t", "\r", "'", "'s", "'re", "'l", "'ll", "1", "23", "½", "!", "#'", "s", "ve", "d"]
    for _ in range(300):
        texts = ["".join(r.choices(plain, k=r.randint(0, 12))) for _ in range(r.randint(1, 6))]
        for attach, pattern in ((True, tokens.BYTE_LEVEL_PATTERN), (False, tokens.WordLevel.PATTERN)):
            joined = "\0".join([*texts, ""])
            at, kind = tokens.pre_tokens(np.frombuffer(joined.encode("utf-32-le"), "<u4"), attach)
            cut = [joined[a:b] for a, b in zip(at, [*at[1:], len(joined)], strict=True)]
            cut = [c for c, k in zip(cut, kind, strict=True) if attach or k != tokens._SPACE]
            assert cut == [x for t in texts for x in [*regex.findall(pattern, t), "\0"]]


def test_texts_of_megabytes(tokenizer):
    """Runs without a place to cut, and a long text with many different chunks, that the cache does not keep."""
    n = 2_000_000
    texts = [" " * n, "\n" * n, "a" * n, " " * n + "x", "ab" * n]
    for name, make in (("byte_bpe_50k.json", tokens.ByteLevel), ("word_bpe_49k.json", tokens.WordLevel)):
        library, mine = tokens.load(tokenizer(name)), make(tokenizer(name))
        for t in texts:
            assert mine.ids([t])[0] == le(library.encode(t, add_special_tokens=False).ids)
        long = [chr(97 + k) * 500_000 for k in range(8)] + [words(k, 40_000) for k in range(3)]
        assert [len(x) for x in mine.ids(long)] == [4 * len(library.encode(t, add_special_tokens=False).ids) for t in long]
        assert len(mine._ids.cache.new) + len(mine._ids.cache.old) <= tokens.CACHE


def test_whole_tokens_are_proven(tokenizer):
    path = tokenizer("byte_bpe_50k.json")
    whole, library = tokens.whole_tokens(path), tokens.load(path)
    assert len(whole) > 40_000 and "<|endoftext|>" not in whole
    for t in random.Random(2).sample(sorted(whole), 500):
        assert library.encode(t, add_special_tokens=False).ids == [whole[t]]


def test_counts_on_edge_rows(edge_docs, edge_rows, no_docs, null_docs, tokenizer):
    path = tokenizer("byte_bpe_50k.json")
    library = tokens.load(path)
    rows = token_counts.count_tokens(edge_docs, path).collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert tuple(r._tokens) == (len((r.text or "").encode()), n, n > 512)
    assert token_counts.count_tokens(no_docs, path).count() == 0
    assert all(r._tokens.n_tokens == 0 for r in token_counts.count_tokens(null_docs, path).collect())


def test_store_round_trip(spark, edge_docs, edge_rows, tokenizer):
    byte = tokenizer("byte_bpe_50k.json")
    library, path = tokens.load(byte), new_path(spark, "test-store")
    token_store.write(edge_docs.repartition(5), path, byte, end_id=2)
    rows = token_store.listing(spark, path).select("*", token_store.ids_crc32("ids").alias("crc")).collect()
    assert len(rows) == len(edge_rows)
    order = sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start = 0
    for r, (i, text, *_) in zip(sorted(rows, key=lambda r: (r.start, r.n_tokens)), order, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids, r.crc) == (i, start, len(ids), ids, zlib.crc32(le(ids)))
        start += len(ids)
    some = token_store.read(spark, path, doc_ids=[4, 7])
    assert {r.doc_id for r in some.collect()} == {4, 7}
    plan = token_store.read(spark, path, between=(4, 7), columns=["n_tokens"])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,4)" in plan and "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan


def test_store_layout(spark, edge_docs, tokenizer):
    path = new_path(spark, "test-store")
    token_store.write(edge_docs, path, tokenizer("byte_bpe_50k.json"), end_id=2)
    seen = {}
    for f in spark.read.parquet(path).inputFiles():
        meta = pq.ParquetFile(f.removeprefix("file://")).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                seen.setdefault(column.path_in_schema, set()).update(column.encodings)
                assert column.has_offset_index and column.compression == "ZSTD"
    assert "DELTA_BINARY_PACKED" in seen["doc_id"] and any("DICTIONARY" in e for e in seen["ids.list.element"])


def test_empty_store(spark, no_docs, null_docs, tokenizer):
    for docs, n in ((no_docs, 0), (null_docs, 5)):
        path = new_path(spark, "test-store")
        token_store.write(docs, path, tokenizer("byte_bpe_50k.json"), end_id=2)
        rows = token_store.listing(spark, path).collect()
        assert sorted((r.start, r.n_tokens, r.ids) for r in rows) == [(k, 1, [2]) for k in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_tree_concatenation_equals_the_library(tokenizer, seed):
    path = tokenizer("word_bpe_49k.json")
    library, r = tokens.load(path), random.Random(seed)
    for _ in range(300):
        segment, unsplit = r.choice([8, 20, 50]), r.choice([2, 3, 5, 9])
        text = "a" * r.randint(1, 200) if r.random() < 0.2 else "".join(r.choices([*PIECES, "er", "aa", "b"], k=r.randint(1, 80)))
        parts = [(p, n, k, bpe_tree.encode_part(k, c, path)) for p, n, k, c in bpe_tree.parts(text, path, segment, unsplit)]
        assert bpe_tree.assemble(parts, path) == le(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("segment,unsplit", [(bpe_tree.SEGMENT, bpe_tree.UNSPLIT), (200, 7)])
def test_encode_on_edge_rows(edge_docs, edge_rows, no_docs, null_docs, tokenizer, segment, unsplit):
    path = tokenizer("word_bpe_49k.json")
    library = tokens.load(path)
    rows = bpe_tree.encode(edge_docs, path, segment=segment, unsplit=unsplit).collect()
    assert sorted(str(r.row.doc_id) for r in rows) == sorted(str(r[0]) for r in edge_rows)
    for r in rows:
        ids = library.encode(r.row.text or "", add_special_tokens=False).ids
        assert bytes(r.ids) == le(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe_tree.encode(no_docs, path).count() == 0 and bpe_tree.encode(null_docs, path).filter(F.octet_length("ids") == 0).count() == 5


def test_op9_digests(spark, tokenizer):
    from tests.conftest import SF
    from worktrace.llm.queries import QUERIES

    library = tokens.load(tokenizer("word_bpe_49k.json"))
    got = {r.doc_id: r for r in QUERIES["op9_bpe_tree"](spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode(d.text, add_special_tokens=False).ids
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(le(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def _documents(spark):
    from tests.conftest import SF

    return SF, sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_op7_counts(spark, tokenizer):
    from worktrace.llm.queries import QUERIES

    library, (sf, docs) = tokens.load(tokenizer("byte_bpe_50k.json")), _documents(spark)
    want = [(i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 512) for i, t in docs]
    rows = QUERIES["op7_token_counts"](spark, sf).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert sorted(map(tuple, rows)) == want


def test_op8_listing(spark, tokenizer):
    from worktrace.llm.queries import QUERIES

    library, (sf, docs) = tokens.load(tokenizer("byte_bpe_50k.json")), _documents(spark)
    want, start = [], 0
    for i, t in docs:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(le(ids))))
        start += len(ids)
    rows = QUERIES["op8_token_store"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, rows)) == want
