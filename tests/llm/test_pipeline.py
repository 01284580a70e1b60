import hashlib
import math
import re
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_exact_mix import targets
from tests.llm.test_quality_lines import brute_repeats
from worktrace.llm import hyperminhash, quality, tokens
from worktrace.llm.queries import QUERIES


@pytest.fixture(scope="module")
def stages(spark):
    """The output of each stage over the documents table and some edge rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "'x' as `row`", "1 as size", "true as kept")
    one = docs.filter("doc_id = 1").first()
    extra = [
        (9001, None, None, None, None, "x", 1, True), (9002, "", "en", None, 0, "x", 1, True),
        (9003, one.text, "en", None, None, "x", 1, True), (9003, one.text, "en", None, None, "x", 1, True),
    ]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def _distance(p, q):
    """Jensen-Shannon distance of two histograms; None if either is empty."""
    if not sum(p) or not sum(q):
        return None
    out = 0.0
    for x, y in zip([a / sum(p) for a in p], [b / sum(q) for b in q], strict=True):
        m = (x + y) / 2
        out += sum(v * math.log2(v / m) for v in (x, y) if v > 0)
    return max(out / 2, 0) ** 0.5


def good_documents(rows):
    """The numbers of the rows (text, lang) that the quality stage keeps, by its rules, without its code."""
    return {k for k, (kept, *_) in judged_documents(rows).items() if kept}


def judged_documents(rows):
    """Number of each row (text, lang) that passes the base rules -> (kept, class distance, common distance)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    of = {c: k for k, chars in enumerate(quality.CLASSES.values()) for c in chars}
    ranges = [(a, b, len(quality.CLASSES) + k) for k, spans in enumerate(quality.SCRIPTS.values()) for a, b in spans]
    docs = []
    for k, (text, lang) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        classes, common = [0] * quality.BINS, [0] * (len(quality.VOCABULARY) + 1)
        for c in text or "":
            classes[of.get(c, next((n for a, b, n in ranges if a <= ord(c) <= b), -1))] += 1
        for x in w:
            x = x.strip(quality.MARKS).translate(low)
            common[quality.VOCABULARY.index(x) if x in quality.VOCABULARY else -1] += 1
        if len(w) >= 10 and 100 * brute_repeats(text) <= 20 * len(w):
            docs.append((k, lang, classes, common, sum(classes), len(w)))

    def verdict(d, ref):
        _, _, classes, common, chars, n = d
        by_class = _distance(classes, ref[0]) if ref is not None and chars >= quality.MIN_CLASS_CHARS else None
        by_word = _distance(common, ref[1]) if ref is not None and n >= quality.MIN_COMMON_WORDS else None
        far = by_class is not None and by_class > quality.MAX_CLASS_SPREAD + quality.CLASS_SPREAD_NOISE / chars**0.5
        far |= by_word is not None and by_word > quality.MAX_COMMON_SPREAD + quality.COMMON_SPREAD_NOISE / n**0.5
        return not far, by_class, by_word

    def judge(own, ref):
        return [d for d in own if verdict(d, ref)[0]]

    def summed(own):
        return [
            [sum(x) for x in zip(*(d[c] for d in own), strict=True)] for c in (2, 3)
        ] if sum(d[5] for d in own) >= quality.MIN_REFERENCE_WORDS else None

    out = {}
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        centre = []
        for c, total, least in ((2, 4, quality.MIN_CLASS_CHARS), (3, 5, quality.MIN_COMMON_WORDS)):
            shares = [[round(x / d[total], 4) for x in d[c]] for d in own if d[total] >= least]
            centre.append([statistics.median(x) for x in zip(*shares, strict=True)] if shares else [])
        ref = summed(judge(own, centre)) or summed(own)
        out |= {d[0]: verdict(d, ref) for d in own}
    return out


def test_robust_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    want = judged_documents([(d.text, d.lang) for d in docs])
    got = {r.doc_id: r for r in QUERIES["op2_robust_divergence"](spark, SF).collect()}
    assert len(got) == len(docs) and {r.base_failed for r in got.values()} == {True, False}
    for k, d in enumerate(docs):
        r, (kept, *distances) = got[d.doc_id], want.get(k, (False, None, None))
        assert r.kept == kept and r.base_failed == (k not in want)
        if k in want:
            for mine, theirs in zip((r.class_distance, r.common_distance), distances, strict=True):
                assert (mine is None) == (theirs is None) and (mine is None or abs(mine - theirs) < 2e-6)


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_each_stage_equals_brute_force_on_its_own_input(stages, tokenizer):
    rows = [s.collect() for s in stages]
    good = good_documents([(r.text, r.lang) for r in rows[0]])
    assert 0 < len(good) < len(rows[0])
    assert Counter(r.doc_id for r in rows[1]) == Counter(r.doc_id for k, r in enumerate(rows[0]) if k in good)
    best = {}
    for r in rows[1]:
        best[r.text or ""] = max(best.get(r.text or "", -1), r.doc_id)
    assert sorted(r.doc_id for r in rows[2]) == sorted(best.values())
    sets = {r.doc_id: hyperminhash.shingle_set(r.text or "") for r in rows[2]}
    where = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            where[x].add(i)
    reach = {i: i for i in sets}
    links = {tuple(sorted((a, b))) for ids in where.values() if len(ids) > 1 for a in ids for b in ids if a < b}
    links = [p for p in links if hyperminhash.similarity(sets[p[0]], sets[p[1]])[0]]
    for _ in sets:
        before = dict(reach)
        for a, b in links:
            reach[a] = reach[b] = min(reach[a], reach[b])
        if reach == before:
            break
    assert sorted(r.doc_id for r in rows[3]) == sorted(i for i in sets if reach[i] == i)
    sizes, taken = defaultdict(int), Counter(r.doc_id for r in rows[4])
    n = {r.doc_id: quality.measure(r.text)[0] for r in rows[3]}
    for r in rows[3]:
        sizes[r.source] += n[r.doc_id]
    want = targets(sizes)
    for r in rows[3]:
        rate = want[r.source] / max(sizes[r.source], 1)
        assert int(rate) <= taken[r.doc_id] <= -(-rate // 1)
    library = tokens.load(tokenizer("word_bpe_49k.json"))
    coded = Counter()
    for r in rows[4]:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        data = np.array(ids, "<u4").tobytes()
        coded[
            r.doc_id, r.source, len(ids), hashlib.sha256(data).hexdigest(),
            hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), data,
        ] += 1
    assert Counter((*tuple(r)[:5], bytes(r.ids)) for r in rows[5]) == coded


def test_run_equals_its_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
    assert Counter(map(str, corpus_pipeline.run(spark, SF).collect())) == Counter(map(str, out.collect()))


def test_an_empty_table_and_one_of_nulls(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for some in (docs.limit(0), spark.createDataFrame([(None,) * 5] * 3, docs.schema)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, some, SF).count() <= 3
