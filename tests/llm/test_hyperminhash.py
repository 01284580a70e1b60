import random

import numpy as np

from tests.llm.conftest import words
from worktrace.llm import hashing
from worktrace.llm import hyperminhash as h


def near(text, rate, seed):
    r = random.Random(seed)
    return " ".join("zz" + str(r.random()) if r.random() < rate else w for w in text.split())


def brute(rows):
    """doc_id -> (n, component) by comparing all pairs."""
    sets = {i: h.shingle_set(t or "") for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and h.similarity(sets[a], sets[b])[0]:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_groups_equal_brute_force(spark):
    rows, i = [], 0
    for s in range(12):
        base = words(s, [6, 9, 30, 80, 200, 1500][s % 6])
        for k in range(8):
            rows.append((i := i + 1, near(base, [0, 0.01, 0.02, 0.03, 0.05, 0.1, 0.3, 0.02][k], 100 * s + k)))
    passage = words(99, 60)
    rows += [(i := i + 1, words(1000 + k, 40) + " " + passage) for k in range(25)]
    rows += [
        (i := i + 1, words(50, 300).upper()), (i := i + 1, words(50, 300)), (i := i + 1, None), (i := i + 1, "one two"),
        (i := i + 1, "ONE  two"),
    ]
    got = h.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chains_and_copies_that_miss_their_hub(spark):
    chain = words(7, 200).split()
    rows = [(k, " ".join(chain[4 * k : 4 * k + 120])) for k in range(15)]  # each links to its neighbours only
    rows += [(100 + k, near(words(8, 150), 0.03 + 0.02 * (k % 3), k)) for k in range(40)]
    got = {r.doc_id: r.component_id for r in h.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()}


def test_open_pairs_hold_all_links_and_few_others(spark):
    """Documents of a common passage and little or much else; each is a component of its own at first."""
    passage, r, rows = words(99, 60), random.Random(4), []
    for k in range(200):
        rows.append((k, words(1000 + k, r.choice([1, 3, 6, 12, 30, 60])) + " " + passage))
    sets = {i: h.shingle_set(t) for i, t in rows}
    docs = spark.createDataFrame([(i, i, len(sets[i]), t) for i, t in rows], "id long, label long, n long, text string")
    got = {tuple(sorted(p)) for p in h._open_pairs(docs.select("id", "label"), docs.select("id", "n", "text")).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and h.similarity(sets[a], sets[b])[0]}
    large = {i for i in sets if len(sets[i]) >= 86}  # 30 or 60 words of their own
    assert want <= got and not any(set(p) <= large for p in got)


def test_edge_rows(edge_docs, no_docs, null_docs):
    rows = h.groups(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, r)
    assert [by[i].n_shingles for i in (1, 2, 3)] == [0, 0, 0] and all(by[i].kept for i in (1, 2, 3))
    assert by[5].component_id == 4 and by[6].component_id == 4 and by[8].component_id == 7 and by[10].component_id == 9
    assert by[None].component_id is None and by[None].kept
    assert {by[100 + i].component_id for i in range(40)} == {100}
    assert h.groups(no_docs).count() == 0 and h.groups(null_docs).count() == 5
    kept = h.deduplicate(edge_docs)
    assert kept.columns == edge_docs.columns and h.deduplicate(no_docs).count() == 0


def test_estimates_are_near_the_truth():
    rnd = np.random.default_rng(5)
    for n, seeds in ((60, 8), (700, 8), (3000, 1)):
        for share in (0.2, 0.75, 0.95):
            pool = rnd.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            cut = int(2 * n * share / (1 + share))
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:cut], pool[n : 2 * n - cut]]))
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            got, used = h.estimates(h.registers(a, seeds)[None], h.registers(b, seeds)[None], np.array([n * seeds]), np.array([n * seeds]))
            assert abs(got[0] - j) < 6 * max(j * (1 - j), 0.01) ** 0.5 / used[0] ** 0.5
    # sets without a common element agree on few registers, and the correction takes those off
    assert 0 < h.expected_collisions(1000, 1000) < 0.01


def test_word_hashes_do_not_depend_on_the_cut(monkeypatch):
    data = (words(3, 5000) + " " + "y" * 500 + " " + "z" * 300 + "\x0b" + words(4, 50)).encode()
    want = hashing.word_hashes(data)
    monkeypatch.setattr(hashing, "PIECE", 64)
    got = hashing.word_hashes(data)
    assert (got == want).all()
