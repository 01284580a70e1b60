import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import words
from worktrace.llm import suffix


def brute(rows):
    seen, cover = Counter(), {}
    cut = [(i, (t or "").split()) for i, t in rows]
    for _, w in cut:
        seen.update(tuple(w[k : k + suffix.LENGTH]) for k in range(len(w) - suffix.LENGTH + 1))
    for i, w in cut:
        for k in range(len(w) - suffix.LENGTH + 1):
            if seen[tuple(w[k : k + suffix.LENGTH])] > 1:
                cover.setdefault(i, set()).update(range(k, k + suffix.LENGTH))
    out = []
    for i, c in cover.items():
        c = sorted(c)
        start = c[0]
        for a, b in zip(c, c[1:] + [None]):
            if b != a + 1:
                out.append((i, start, a + 1, a + 1 - start))
                start = b
    return sorted(out)


def fixture():
    rnd, rows = random.Random(9), []
    passages = [words(500 + k, n) for k, n in enumerate((49, 50, 51, 60, 200))]
    for i in range(80):
        p = rnd.choice(passages).split()
        a = rnd.randint(0, max(0, len(p) - 50))
        piece = " ".join(p[a : a + rnd.randint(40, 200)])
        rows.append((i, words(i, rnd.randint(0, 60)) + " " + piece + " " + words(1000 + i, rnd.randint(0, 40)) + (" " + piece if i % 9 == 0 else "")))
    return rows + [(200, "a " * 150), (201, None), (202, ""), (203, words(3, 49))]


@pytest.mark.parametrize("part", [suffix.PART, 1, 2, 6])
def test_equal_to_counting_all_windows(spark, part):
    rows = fixture()
    got = suffix.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), part=part).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_edge_rows(edge_docs, edge_rows, no_docs, null_docs):
    rows = [(r[0], r[1]) for r in edge_rows if r[0] is not None]
    got = sorted(set(map(tuple, suffix.repeated_passages(edge_docs).collect())))
    assert got == sorted(set(brute(rows)))
    assert suffix.repeated_passages(no_docs).count() == 0 and suffix.repeated_passages(null_docs).count() == 0


def test_an_id_with_two_texts(spark):
    rows = [(1, words(1, 80)), (1, words(2, 80)), (2, words(1, 80))]
    got = suffix.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 80, 80), (2, 0, 80, 80)]


def test_control_characters_do_not_part_equal_words(spark):
    rows = []
    for k in range(20):
        w = words(900 + k, 50).split()
        other = ["other", *w[1:49], w[49] + "\x01", *words(950 + k, 30).split()]
        rows += [(3 * k, " ".join(w)), (3 * k + 1, " ".join(w) + " " + words(970 + k, 30)), (3 * k + 2, " ".join(other))]
    got = suffix.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start, r.end) for r in got) == [(3 * k + i, 0, 50) for k in range(20) for i in (0, 1)]


@pytest.mark.parametrize("part", [suffix.PART, 3])
def test_a_passage_that_most_documents_share(spark, part):
    passage = words(700, 70).split()
    rows = []
    for k in range(120):  # cut at either end, and with one word replaced in some
        own = passage[k % 15 : 70 - k % 7]
        own = own if k % 10 else [*own[:30], f"other{k % 20}", *own[31:]]
        rows.append((k, words(2000 + k, 30 + k % 40) + " " + " ".join(own) + " " + words(3000 + k, 40)))
    rows += [(500 + k, words(4000, 300)) for k in range(60)]
    got = suffix.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), part=part).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_texts_in_batches_are_hashed_as_alone(monkeypatch):
    texts = ["", words(1, 70), " ", words(2, 49), words(3, 300) + " " + "y" * 300 + "\x0bz", "\n" + words(1, 70)]
    alone = [suffix.hashed_words(t.encode())[0].tolist() for t in texts]
    for size in (1, 500, 1 << 20):
        monkeypatch.setattr(suffix, "_BATCH_BYTES", size)
        got = []
        for _, _, hashes, counts in suffix._texts(pa.array(texts)):
            got += [h.tolist() for h in np.split(hashes, np.cumsum(counts)[:-1])]
        assert got == alone


def test_selected_positions_hold_each_passage_once():
    rnd = np.random.default_rng(3)
    counts = [0, 200, 49, 50, 7, 333, 1000, 0]
    w = rnd.integers(0, 40, sum(counts)).astype(np.uint64)  # few words, so grams repeat
    at, first, last = suffix.selected(w, counts)
    held = sorted(b for a, z in zip(first, last, strict=True) for b in range(a, z + 1))
    begins = np.cumsum(counts) - np.array(counts)
    assert held == [b + k for b, n in zip(begins, counts, strict=True) for k in range(n - suffix.LENGTH + 1)]
    assert ((at - first < suffix.SPREAD) & (at >= last)).all()
