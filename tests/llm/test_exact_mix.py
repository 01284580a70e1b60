import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from worktrace.llm import exact, mix


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for r in rows:
        ids = groups[r[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(
    "digest", [lambda: None, lambda: F.lit("same"), lambda: F.substring(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256), 1, 1)],
    ids=["sha", "one", "four_bits"],
)
def test_assign_equals_brute_force_whatever_the_digest(edge_docs, edge_rows, digest):
    got = sorted(map(tuple, exact.assign(edge_docs, digest=digest()).collect()), key=str)
    assert got == brute(edge_rows)


def test_assign_on_empty_and_null_tables(no_docs, null_docs):
    assert exact.assign(no_docs).count() == 0
    rows = exact.assign(null_docs).collect()
    assert len(rows) == 5 and all(r.keep_id is None and r.group_size == 5 and r.kept for r in rows)


def test_deduplicate_leaves_one_row_per_text(edge_docs, edge_rows, no_docs, null_docs):
    got = exact.deduplicate(edge_docs).collect()
    assert Counter(r.text or "" for r in got) == Counter({r[1] or "" for r in edge_rows})
    best = {r[1] or "": max((x[0] for x in edge_rows if (x[1] or "") == (r[1] or "") and x[0] is not None), default=None) for r in edge_rows}
    assert all(r.doc_id == best[r.text or ""] for r in got)
    assert exact.deduplicate(edge_docs).columns == edge_docs.columns
    assert exact.deduplicate(no_docs).count() == 0 and exact.deduplicate(null_docs).count() == 1


def test_deduplicate_with_a_column_that_has_no_order(spark):
    rows = spark.sql("select 1L as doc_id, 'a' as text, map('k', 1) as m union all select 2L, 'a', map('k', 2)")
    assert [r.m for r in exact.deduplicate(rows).collect()] == [{"k": 2}]


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total >= 2 * sizes[s]]
        if not full:
            for s in open_:
                target[s] = left * weight[s] / total
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_targets_by_resharing(edge_docs, edge_rows, no_docs, null_docs):
    sizes = defaultdict(int)
    for r in edge_rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = targets(sizes)
    rows = mix.copies(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        assert r.source_size == sizes[r.row.source] and r.target == pytest.approx(want[r.row.source])
        assert 0 <= r.copies <= 2
    assert mix.copies(no_docs).count() == 0
    assert all(r.size == 0 and r.target == 0 and r.copies == 0 for r in mix.copies(null_docs).collect())


def test_targets_of_many_sources(spark):
    import random

    rnd = random.Random(4)
    for _ in range(5):
        sizes = {(f"s{i}" if i else None): rnd.choice([0, 1, 5, 100, 5000]) for i in range(rnd.randint(1, 12))}
        got = mix.source_plan(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        assert {r.source: pytest.approx(r.target) for r in got} == targets(sizes)


def test_mix_repeats_rows_and_comes_near_targets(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("source"),
    )
    rows = mix.copies(docs)
    for r in rows.groupBy("row.source").agg(F.max("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("n")).collect():
        assert abs(r.n - r.t) < 0.03 * r.t
    assert mix.mix(docs).count() == rows.agg(F.sum("copies")).first()[0] and mix.mix(docs).columns == docs.columns
    assert rows.drop("row").exceptAll(mix.copies(docs.repartition(7)).drop("row")).isEmpty()


def test_salted_lookup_gives_the_same(edge_docs, monkeypatch):
    from worktrace.llm import common

    want = sorted(map(str, mix.copies(edge_docs).collect()))
    monkeypatch.setattr(mix, "lookup_join", lambda *a: common.lookup_join(*a, limit=-1))
    assert sorted(map(str, mix.copies(edge_docs).collect())) == want
