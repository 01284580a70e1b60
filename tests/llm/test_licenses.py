from __future__ import annotations

import random
import re

import pytest

from worktrace.llm import licenses as L
from worktrace.llm.license_rules import Rule, compiled, keywords, longest, standard_rules, sure_words


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def places(rule, words):
    """(first, last) of a rule's matches, left to right, over the whole text."""
    text, out = "".join(f" {w} " for w in words), []
    for m in re.finditer(compiled(rule.signature), text):
        first = text[: m.start()].count(" ") // 2
        out.append((first, first + m.group().count(" ") // 2 - 1))
    return out


def brute(text, rules):
    words = words_of(text)
    found = [(*p, i, r) for i, r in enumerate(rules) for p in places(r, words)]

    def covered(d):
        return any(
            o[0] <= d[0] and o[1] >= d[1]
            and (o[3].strength < d[3].strength or o[3].strength == d[3].strength and (o[1] - o[0] > d[1] - d[0] or o[2] < d[2]))
            for o in found
        )

    base = [d for d in found if d[3].base]
    stands = [d for d in found if not covered(d)]
    labels = sorted({d[3].label for d in base}), sorted({d[3].label for d in base + stands})
    first, last = (min(d[0] for d in base), max(d[0] for d in base)) if base else (None, None)
    score = max((L.WEIGHTS[d[3].strength] for d in stands), default=0.0)
    return len(words), len(base), first, last, ",".join(labels[0]), ",".join(labels[1]), score


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def same(spark, texts, rules=None):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: tuple(r)[1:] for r in L.scan(df, rules=rules).select("row.doc_id", *COLUMNS).collect()}
    for i, text in enumerate(texts):
        assert rows[i] == brute(text, rules or standard_rules()), text


def test_rules_are_sound():
    rules = standard_rules()
    assert len(rules) > 400
    for r, word in zip(rules, keywords(rules), strict=True):
        assert re.fullmatch("[a-z0-9.-]+", r.label) and word in sure_words(r.signature)
    assert max(longest(r.signature) for r in rules) < L.TILE


def test_every_rule_finds_its_own_words(spark):
    """Optional words written out and left out; gaps filled and empty."""
    r, texts = random.Random(1), []
    for rule in standard_rules():
        said = []
        for token in rule.signature.split():
            if token[0] == "*":
                said += ["gap"] * r.randint(0, int(token[1:]))
            elif not token.endswith("?") or r.random() < 0.5:
                said.append(r.choice(token.rstrip("?").split("|")))
        texts.append("Intro, " + r.choice([" ", "-", "\n", ". "]).join(said).upper() + " end")
        assert places(rule, words_of(texts[-1])), rule
    same(spark, texts)


def test_random_texts_of_rule_words_over_many_tiles(spark):
    r, rules = random.Random(2), standard_rules()
    phrases = [" ".join(t.rstrip("?").split("|")[0] for t in x.signature.split() if t[0] != "*") for x in rules]
    texts = []
    for _ in range(25):
        out = []
        for _ in range(r.randint(1, 60)):
            out += r.choice(phrases).split()[: r.randint(1, 30)] + ["filler"] * r.choice([0, 0, 1, 7, 60])
        texts.append(" ".join(out))
    same(spark, texts)


def test_base_labels_stay_under_a_longer_detection(spark):
    same(spark, ["Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3", "mit-license MIT/LICENSE", "the mit license mit license"])


def test_odd_texts(spark):
    texts = [None, "", " \n\t ", "...", "é MIT License", "MIT Licenseİ", "\x00mit\x00license\x00", "K" * 9000 + " mit license", "x " * 30000 + "MIT License " * 400, "Kelvin K license"]
    same(spark, texts)


def test_own_rules_by_strength(spark):
    rules = [Rule("long", 3, "alpha beta gamma"), Rule("short", 1, "beta"), Rule("weak", 4, "alpha beta"), Rule("twin", 3, "alpha beta gamma"), Rule("b", 2, "beta gamma", True)]
    same(spark, ["alpha beta gamma", "beta gamma alpha beta", "alpha alpha beta gamma beta"], rules)


def test_rows_of_any_shape(spark, edge_docs, edge_rows, no_docs, null_docs):
    assert L.scan(edge_docs).count() == len(edge_rows)
    assert L.scan(edge_docs).select("row.*").columns == edge_docs.columns
    assert L.scan(no_docs).count() == 0
    assert [tuple(r) for r in L.scan(null_docs).select(*COLUMNS).distinct().collect()] == [(0, 0, None, None, "", "", 0.0)]


def test_no_python_and_no_shuffle(spark, edge_docs):
    plan = L.scan(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("text", ["permission is hereby granted free of charge to any person obtaining a copy of this software", "All rights reserved"])
def test_detections_have_their_places(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (d,) = [x for x in L.scan(df).first()["detections"] if x["stands"]][:1]
    assert d["first"] == 0 and d["last"] == len(text.split()) - 1
