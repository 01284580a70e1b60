from __future__ import annotations

import collections
import random
import re

from worktrace.llm import collocations as C
from worktrace.llm import common

SCHEMA = "doc_id long, text string, lang string, words int, n string, `w0` int, `a.b` string"


def brute(rows, top=C.TOP):
    counts, total = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", lower):
            w = [x for x in re.split("[ \t]", piece) if x]
            total[lang] += len(w)
            for k in range(1, 5):
                counts.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    candidates = {p: n for p, n in counts.items() if len(p[1]) > 1 and n >= C.MIN_COUNT}
    longer = collections.Counter()
    for (lang, w), n in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], n)
    found = collections.defaultdict(list)
    for (lang, w), a in candidates.items():
        cuts = [(2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if 100 * longer[lang, w] < C.COVERED * a:
            found[lang].append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return {
        (lang, i + 1, p.decode(), -a, left, right, total[lang], -s)
        for lang, all_rows in found.items() for i, (s, a, p, left, right) in enumerate(sorted(all_rows)[:top])
    }


def made(seed):
    r = random.Random(seed)
    words = ["of", "the", "New", "York", "new", "state", "é", "naïve", "in", "a\x00b", "x" * 70]
    texts = [" ".join(r.choices(words, k=r.randint(0, 40))) + r.choice([".", ",\n", " ", "\t", "! ?"]) for _ in range(700)]
    rows = [(t, r.choice(["en", "en", "fr", None, "und"])) for t in texts]
    rows += [(" ".join(["New York state of the art"] * 12), "en")] * 3 + [("ha " * 500, "ha"), (None, "en"), ("", None), (" \n\t.", "zz")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "n", 2, None) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


def found(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def test_mine_against_brute_force(spark):
    for seed in (1, 2):
        rows = made(seed)
        expected = brute(rows)
        assert len(expected) > 100
        assert found(C.mine(frame(spark, rows))) == expected


def test_only_the_first_of_each_language(spark):
    rows = made(3)
    assert found(C.mine(frame(spark, rows), top=5)) == brute(rows, top=5)


def test_empty_and_null_tables(spark, no_docs, null_docs):
    assert C.mine(no_docs).count() == 0
    assert C.mine(null_docs).count() == 0


def test_batches_and_chunks_cut_nothing(monkeypatch):
    """Windows are the same however few words and bytes are taken at a time, also inside a text."""
    import pyarrow as pa

    class Bits:
        value = b"\xff" * (1 << (common.BITMAP_BITS - 3))

    rows = made(7)
    batch = pa.RecordBatch.from_arrays([pa.array([x or "und" for _, x in rows]), pa.array([t for t, _ in rows])], ["lang", "text"])

    def windows():
        out = collections.Counter()
        for part in C._count_windows(Bits)(iter([batch])):
            for r in part.to_pylist():
                out[r["lang"], r["w0"], r["w1"], r["w2"], r["w3"]] += r["n"]
        return out

    def pairs():
        out = collections.Counter()
        for part in C._count_pairs(iter([batch])):
            for r in part.to_pylist():
                out[r["key"]] += r["n"]
        return out

    whole = windows(), pairs()
    monkeypatch.setattr(C, "BATCH", 50)
    monkeypatch.setattr(C, "CHUNK", 64)
    assert (windows(), pairs()) == whole


def test_exact_beyond_64_bits(spark):
    row = spark.range(1).selectExpr(
        "cast(2000000 as decimal(10,0)) * cast(9000000000000000000 as decimal(20,0)) div (cast(9000000000000000001 as decimal(20,0)) + cast(9000000000000000007 as decimal(20,0))) x"
    ).first()
    assert row["x"] == 2000000 * 9000000000000000000 // (9000000000000000001 + 9000000000000000007)
