from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from worktrace.llm import conversations as C
from worktrace.llm.queries import QUERIES

LEGAL = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, `a.b` string, kind int, part string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        k = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def cheapest(rows):
    """By recursion over rows and the regular language of roles, apart from any LR table."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(maxsize=None)
    def best(i, at, inserts):
        found = [(0, "")] if i == len(rows) and at in ("", "a") else []
        add = lambda c, x, rest: found.append((c + rest[0], x + rest[1])) if rest else None
        if inserts < 4:
            for x in "ua":
                if (at, x) in step:
                    add(5, "I", best(i, step[at, x], inserts + 1))
        if i < len(rows):
            x, fault = rows[i]
            add(2, "D", best(i + 1, at, 0))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if (at, x) in step:
                    add(extra, "K", best(i + 1, step[at, x], 0))
                for y in "ua":
                    if (at, y) in step:
                        add(extra + 1, "R", best(i + 1, step[at, y], 0))
        return min(found) if found else None

    return best(0, "", 0)


def brute(rows, ids):
    out = {}
    for conv in ids:
        own = [r[1:] for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, marks = set(), []
        for _, role, text in own:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            marks.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [(r[1] or " ")[0] for r in own]
        cost, audit = cheapest(tuple(zip(initials, marks, strict=True)))
        lines, at, rest = [], "", list(own)
        for edit in audit:
            _, role, text = (None, None, "") if edit == "I" else rest.pop(0)
            if edit == "D":
                continue
            if edit != "K":
                role = "assistant" if at == "u" else "user"
            at = role[0]
            lines.append(f"{role}:{text}")
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, sha)
    return out


def same(df, expected):
    rows = df.collect()
    assert len(rows) == len(expected)
    for r in rows:
        assert tuple(r)[1:] == expected[r["conv_id"]], r


def made(seed, conversations=60):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "yes", "", "  \n", "A very\nlong one.", "what", "Why?  ", None]
    rows = [
        (c, r.choice([t, t, t, t + 3, None]), r.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), r.choice(texts) or f"{r.random()}.")
        for c in range(conversations) for t in range(r.randint(0, 12))
    ]
    rows += [(None, 1, "user", "No id."), (None, 2, "assistant", None), (7, None, None, None)]
    return rows + rows[:5]


def test_tables_accept_the_grammar_and_nothing_else():
    for n in range(7):
        for x in itertools.product("sua", repeat=n):
            stacks = {C.stacks()[0]}
            for symbol in x:
                stacks = {t for s in stacks for t in C.tables().shifted(s, symbol)}
            assert any(map(C.tables().accepts, stacks)) == bool(LEGAL.fullmatch("".join(x)))
    assert len(C.stacks()) < 12


def test_cheapest_edits_against_all_edits():
    r = random.Random(5)
    for _ in range(60):
        rows = [(r.choice("suatx"), r.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(r.randint(0, 4))]
        found = []
        for edits in itertools.product("KRD", repeat=len(rows)):
            for inserts in itertools.product(range(3), repeat=len(rows) + 1):
                cost, symbols, audit = 5 * sum(inserts), ["?"] * inserts[0], "I" * inserts[0]
                for (x, fault), e, k in zip(rows, edits, inserts[1:], strict=True):
                    cost += {"K": 0, "R": 1, "D": 2}[e] + 5 * (fault == "truncated" and e != "D")
                    cost += 1000 * (fault in ("blank", "duplicate") and e != "D")
                    symbols += ({"K": [x], "R": ["?"], "D": []}[e]) + ["?"] * k
                    audit += e + "I" * k
                # what is free becomes what the grammar wants there
                for first in ("s", "u"):
                    text = "".join(symbols)
                    want = ("s" if first == "s" else "") + "ua" * len(text)
                    if all(a == b or a == "?" and b != "s" for a, b in zip(text, want, strict=False)) and LEGAL.fullmatch(want[: len(text)]):
                        found.append((cost, audit))
        marked = [(x, f, f in ("blank", "duplicate")) for x, f in rows]
        best = C._best(C.parsed(marked, C.stacks()[0]))
        assert best == min(found) == cheapest(tuple(rows))


@pytest.mark.parametrize("seed", [4, 3])
def test_repair_against_brute_force(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame([(*r, None, 1, "x") for r in rows], SCHEMA).repartition(3)
    ids = {r[0] for r in rows}
    same(C.repair(C.damage(df), conv_ids=df), brute(damaged(rows), ids))
    plain = [(a, b, " " if c is None else c, " " if d is None else d) for a, b, c, d in rows]
    same(C.repair(df), brute(plain, ids))


def test_parts_join_to_the_whole():
    """A conversation in parts of one row gives what it gives whole."""
    r = random.Random(8)
    for _ in range(40):
        whole = C._Run(1)
        pieces = []
        for t in range(r.randint(1, 14)):
            row = (t // 2, r.choice(["user", "assistant", "system"]), f"{t}.", r.choice(["", "truncated", "blank", ""]))
            whole.add(*row)
            pieces.append(C._Run(1))
            pieces[-1].add(*row)
        rows = [x for i, p in enumerate(pieces) for x in C._open_rows(p, 0, i)]
        rows.sort(key=lambda x: x[11])
        batch = C._table([(x[0], x[11], x[12]) for x in rows], "conv_id long, kind int, body string")
        (out,) = C._join_parts(iter([batch]))
        assert tuple(out.to_pylist()[0].values()) == C._finished(whole)[:9]


def test_one_conversation_over_many_partitions(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Line {t % 4000}.") for t in range(9000)] + [(2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    big = {r["conv_id"]: r for r in C.repair(df).collect()}[1]
    assert (big["duplicate"], big["cost"], big["audit"]) == (5000, 10000, "K" * 4000 + "D" * 5000)
    lines = [f"{role}:{text}" for _, _, role, text in rows[:4000]]
    assert big["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_empty_and_all_null_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.repair(C.damage(none), conv_ids=none).count() == 0
    nulls = spark.createDataFrame([(None,) * 7] * 4, SCHEMA)
    same(C.repair(C.damage(nulls), conv_ids=nulls), brute(damaged([(None,) * 4] * 4), {None}))


def test_query_against_brute_force(spark):
    from tests.conftest import SF

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(QUERIES["op12_conversation_repair"](spark, SF), brute(damaged(rows), {r[0] for r in rows}))
