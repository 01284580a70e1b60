"""Repair of damaged conversations by generalised LR parsing of their roles.

The grammar of roles is turned into LR tables. Rows drive a graph-structured stack:
stacks share their lower parts, and a row may be kept, given another role or deleted,
or a row may be inserted before it, each at a cost. Stacks with the same states merge,
the least (cost, audit) stays. The grammar is left-recursive, so few different stacks
exist, however long a conversation is.

Rows are sorted over the cluster by conversation and turn, so one conversation may lie
in many partitions. A part of it that begins or ends with its partition, or has more
than PART rows, is repaired from each stack it may begin with; such parts are then put
together, one small row each. Which rows repeat an earlier one is found by counts, so
no conversation or text has to meet in one task.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrace.llm.common import materialise, quoted, small_batches

#: Roles of a conversation, by initials (fixed by the contract): (s?(ua)+)?
GRAMMAR = {"C": ["", "sP", "P"], "P": ["ua", "Pua"]}
NAMES = {"u": "user", "a": "assistant"}  # what a row may become, and what may be inserted
#: Costs of the edits (fixed by the contract).
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

PART = 4096  # rows of a conversation that are repaired at once, at most
PART_CHARS = 16 << 20  # about
_SOLID = r"[^\x20\x09-\x0D]"


class Stack(NamedTuple):
    """An LR state on top of a shared stack."""

    state: int
    below: Stack | None


class Tables:
    """LR(0) states of a grammar, with reductions by what may follow."""

    def __init__(self, grammar: dict[str, list[str]]):
        self.grammar = grammar
        start = next(iter(grammar))
        self.rules = [("", start), *((a, b) for a, bodies in grammar.items() for b in bodies)]
        self.states, self.goto = [self._closed({(0, 0)})], {}
        for i, items in enumerate(self.states):
            for x in sorted({self.rules[r][1][d] for r, d in items if d < len(self.rules[r][1])}):
                after = self._closed({(r, d + 1) for r, d in items if self.rules[r][1][d : d + 1] == x})
                if after not in self.states:
                    self.states.append(after)
                self.goto[i, x] = self.states.index(after)
        self.follow = self._follow(start)

    def _closed(self, items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        while True:
            heads = {self.rules[r][1][d : d + 1] for r, d in items}
            more = items | {(r, 0) for r, (a, _) in enumerate(self.rules) if a in heads - {""}}
            if more == items:
                return frozenset(items)
            items = more

    def _follow(self, start: str) -> dict[str, set[str]]:
        empty = {a for a, bodies in self.grammar.items() if "" in bodies}
        first: dict[str, set[str]] = {a: set() for a in self.grammar}
        follow: dict[str, set[str]] = {a: set() for a in self.grammar} | {start: {"$"}}
        for _ in range(len(self.grammar) + 1):
            for a, body in self.rules[1:]:
                for x in body:
                    first[a] |= first.get(x, {x})
                    if x not in empty:
                        break
                for i, x in enumerate(body):
                    if x in follow:
                        rest = body[i + 1 :]
                        follow[x] |= first.get(rest[0], {rest[0]}) if rest else follow[a]
        return follow

    @lru_cache(maxsize=None)  # noqa: B019  one object a process, few stacks
    def shifted(self, stack: Stack, symbol: str) -> tuple[Stack, ...]:
        """The stacks after reductions that `symbol` allows and its shift."""
        out = []
        for s in self._reduced(stack, symbol):
            if (s.state, symbol) in self.goto:
                out.append(Stack(self.goto[s.state, symbol], s))
        return tuple(dict.fromkeys(out))

    @lru_cache(maxsize=None)  # noqa: B019
    def accepts(self, stack: Stack) -> bool:
        return any((0, 1) in self.states[s.state] for s in self._reduced(stack, "$"))

    def _reduced(self, stack: Stack, ahead: str) -> list[Stack]:
        found, todo = [], [stack]
        while todo:
            s = todo.pop()
            found.append(s)
            for r, d in self.states[s.state]:
                a, body = self.rules[r]
                if r and d == len(body) and ahead in self.follow[a]:
                    base = s
                    for _ in body:
                        base = base.below
                    todo.append(Stack(self.goto[base.state, a], base))
        return found


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables(GRAMMAR)


@lru_cache(maxsize=1)
def stacks() -> list[Stack]:
    """All stacks that a part of a conversation may begin with, the empty one first."""
    found = [Stack(0, None)]
    for s in found:
        found += [t for x in "sua" for t in tables().shifted(s, x) if t not in found]
    return found


Top = dict[Stack, tuple[int, str]]


def _merge(top: Top, stack: Stack, best: tuple[int, str]) -> bool:
    if stack in top and top[stack] <= best:
        return False
    top[stack] = best
    return True


def _with_inserts(top: Top) -> Top:
    """What inserting rows adds; each costs something, so this ends."""
    todo = list(top)
    while todo:
        s = todo.pop()
        cost, audit = top[s]
        todo += [t for x in NAMES for t in tables().shifted(s, x) if _merge(top, t, (cost + INSERT, audit + "I"))]
    return top


def parsed(rows: Iterable[tuple[str, str, bool]], begin: Stack) -> Top:
    """The best (cost, audit) by stack after rows of (initial, fault, must go) that begin with a stack."""
    top = _with_inserts({begin: (0, "")})
    for initial, fault, gone in rows:
        after: Top = {}
        extra = TRUNCATED if fault == "truncated" else 0
        for s, (cost, audit) in top.items():
            _merge(after, s, (cost + DELETE, audit + "D"))
            if not gone:
                for t in tables().shifted(s, initial):
                    _merge(after, t, (cost + extra, audit + "K"))
                for x in NAMES:
                    for t in tables().shifted(s, x):
                        _merge(after, t, (cost + extra + REROLE, audit + "R"))
        top = _with_inserts(after)
    return top


def _repaired(rows: Iterable[tuple[str, str]], audit: str, begin: Stack) -> Iterator[str]:
    """The rows (role, text) after the edits, as role:text. What a row becomes follows from the stack."""
    stack, rows = begin, iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        symbol = _initial(role) if edit == "K" else next(x for x in NAMES if tables().shifted(stack, x))
        stack = tables().shifted(stack, symbol)[0]
        yield f"{role if edit == 'K' else NAMES[symbol]}:{text}"


def _initial(role: str) -> str:
    return role[:1] or " "


_LEGAL = {"su", "ua", "au"}


class _Run:
    """Rows of a conversation in order, and their counts."""

    def __init__(self, conv: int | None):
        self.conv, self.rows, self.texts = conv, [], []
        self.counts = {k: 0 for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
        self.low = self.high = None
        self.n, self.size, self.first_initial, self.last_initial = 0, 0, "", ""

    def add(self, turn: int | None, role: str, text: str | None, fault: str) -> None:
        x = _initial(role)
        gone = fault in ("blank", "duplicate")
        self.rows.append((x, fault, gone))
        self.texts.append((role, text or ""))
        self.size += len(text or "")
        if fault:
            self.counts[fault] += 1
        if self.n and self.last_initial + x not in _LEGAL:
            self.counts["illegal"] += 1
        self.first_initial = x if not self.n else self.first_initial
        self.last_initial, self.n = x, self.n + 1
        if turn is not None and turn != self.high:
            self.counts["turns"] += 1
            self.low, self.high = turn if self.low is None else self.low, turn


def _digest(lines: Iterable[str]) -> str:
    h, first = hashlib.sha256(), True
    for line in lines:
        h.update((line if first else "\n" + line).encode("utf-8", "surrogatepass"))
        first = False
    return h.hexdigest()


def _best(top: Top) -> tuple[int, str]:
    return min(best for s, best in top.items() if tables().accepts(s))


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PARTS = _RESULT + ", part long, step int, kind int, body string"


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def _finished(run: _Run) -> tuple:
    cost, audit = _best(parsed(run.rows, stacks()[0]))
    c = run.counts
    found = (run.conv, _gaps(run.low, run.high, c["turns"]), c["blank"], c["duplicate"], c["truncated"], c["illegal"], cost, audit)
    return (*found, _digest(_repaired(run.texts, audit, stacks()[0])), None, None, 0, None)


def _open_rows(run: _Run, part: int, step: int) -> list[tuple]:
    """A part as two rows: what it does to each stack (kind 1), and its texts (kind 2)."""
    index = {s: i for i, s in enumerate(stacks())}
    moves = [[i, index[t], *best] for s, i in index.items() for t, best in parsed(run.rows, s).items()]
    about = {"moves": moves, "counts": run.counts, "low": run.low, "high": run.high, "n": run.n, "first": run.first_initial, "last": run.last_initial}
    return [(run.conv, *(None,) * 8, part, step, 1, json.dumps(about)), (run.conv, *(None,) * 8, part, step, 2, json.dumps(run.texts))]


def _repair_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations that lie whole inside the partition are finished, others come out in parts."""
    run, step, conv, seen, out, part = None, 0, None, 0, [], None
    first = None  # key and text of the row before, if it brings the first of its equal rows
    for batch in batches:
        for conv_id, turn, role, digest, copies, text, fault, here in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            part = here
            if run is None or conv_id != conv:
                if run is not None:
                    # the partition's first conversation may have begun in another one
                    out += [_finished(run)] if seen > 1 and not step else _open_rows(run, part, step)
                conv, run, step, seen = conv_id, _Run(conv_id), 0, seen + 1
            if text is not None:
                first = (turn, role, digest, text)
                continue
            for _ in range(copies):
                if len(run.rows) >= PART or run.size >= PART_CHARS:
                    out += _open_rows(run, part, step)
                    run, step = _Run(conv), step + 1
                if fault == "blank":
                    run.add(turn, role, None, fault)
                elif first and first[:3] == (turn, role, digest):
                    run.add(turn, role, first[3], fault)
                    first = None
                else:
                    run.add(turn, role, None, "duplicate")
            if len(out) >= 500:
                yield _table(out, _PARTS)
                out = []
    if run is not None:
        out += _open_rows(run, part, step)
    if out:
        yield _table(out, _PARTS)


def _joined(conv: int | None, parts: list[dict]) -> tuple[tuple, list[tuple[int, str]]]:
    """A conversation's counts, cost and audit from its parts; for each part, the stack it begins with and its audit."""
    top: dict[int, tuple[int, str, tuple]] = {0: (0, "", ())}
    total, low, high, last = dict.fromkeys(parts[0]["counts"], 0), None, None, ""
    for p in parts:
        after: dict[int, tuple[int, str, tuple]] = {}
        for s, t, cost, audit in p["moves"]:
            if s in top:
                found = (top[s][0] + cost, top[s][1] + audit, (top[s][2], s, len(audit)))
                if t not in after or found[:2] < after[t][:2]:
                    after[t] = found
        top = after
        for k, v in p["counts"].items():
            total[k] += v
        if p["n"]:
            total["illegal"] += bool(last) and last + p["first"] not in _LEGAL
            last = p["last"]
        if p["low"] is not None:
            total["turns"] -= p["low"] == high  # the same turn goes on
            low, high = p["low"] if low is None else low, p["high"]
    cost, audit, path = min((x for i, x in top.items() if tables().accepts(stacks()[i])), key=lambda x: x[:2])
    begins, end = [], len(audit)
    while path:
        path, s, n = path
        begins.append((s, audit[end - n : end]))
        end -= n
    c = total
    return (conv, _gaps(low, high, c["turns"]), c["blank"], c["duplicate"], c["truncated"], c["illegal"], cost, audit), begins[::-1]


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation, first what its parts do to stacks, then their texts, which are only passed through the digest."""
    conv, parts, found, begins, h, lines = None, [], None, [], None, 0
    out = []

    def ended() -> list[tuple]:
        return [(*found, h.hexdigest())] if found else []

    for batch in batches:
        for conv_id, kind, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if kind == 1:
                if found or not parts:
                    out += ended()
                    conv, parts, found = conv_id, [], None
                parts.append(json.loads(body))
                continue
            if not found:
                found, begins = _joined(conv, parts)
                h, lines, parts = hashlib.sha256(), 0, []
            begin, audit = begins.pop(0)
            for line in _repaired(json.loads(body), audit, stacks()[begin]):
                h.update((line if not lines else "\n" + line).encode("utf-8"))
                lines += 1
        if out:
            yield _table(out, _RESULT)
            out = []
    if found:
        yield _table(ended(), _RESULT)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the rows, with faults by crc32 of `conv_id:turn` modulo 20.

    0 drops a row, 1 empties its text, 2 takes . ! and ? out, 3 repeats the row, 4 makes
    it the user's. Nulls are one space, in the key too; ids and turns stay null. Equal
    rows are damaged alike; other columns are not read.
    """
    space = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("_f")).filter("_f <> 0")
    text = F.when(F.col("_f") == 1, "").when(F.col("_f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("_f") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("_f") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_f"),
    )
    return rows.drop("_f")


def _fault(text: Column) -> Column:
    return F.when(~F.regexp_like(text, F.lit(_SOLID)), "blank").when(~F.regexp_like(text, F.lit(r"[.!?][\x20\x09-\x0D]*\z")), "truncated").otherwise("")


def repair(rows: DataFrame, conv_ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of `rows` and of `conv_ids`: faults, the cheapest edits that give a legal row of roles, and a digest.

    Rows of a conversation go by turn, nulls first; of one turn by role and SHA-256 of
    the text. A row's first fault counts: blank, duplicate (role and text seen earlier in
    the conversation), truncated. illegal: neighbours whose initials are not su, ua or
    au. gaps: turns missing between the least and the largest, nulls aside. cost and
    audit: the least cost of edits (K, R, D, I), of equal ones the least in ASCII.
    repaired_sha256: of the repaired rows as role:text, joined by newlines.

    A null role or text is one space; an empty role has a space for initial; a null id
    is a conversation of its own. Repeated rows are duplicates. A conversation without
    rows has zeros, an empty audit and the digest of the empty string; empty tables give
    an empty one. Other columns are not read.
    """
    spark = rows.sparkSession
    small_batches(spark)
    space = lambda c: F.coalesce(quoted(c), F.lit(" "))
    conv_ids = rows if conv_ids is None else conv_ids
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"))
    rows = rows.withColumns({"digest": F.sha2("text", 256), "fault": _fault(F.col("text"))})
    none = F.lit(None)
    counted = rows.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.count("*").alias("copies"))
    counted = counted.select("conv_id", "turn", "role", "digest", "copies", none.cast("string").alias("text"), "fault")
    # the earliest of equal rows, once, with its text; it sorts before its count
    turn = F.when(~F.bool_or(F.col("turn").isNull()), F.min("turn"))
    firsts = rows.filter("fault <> 'blank'").groupBy("conv_id", "role", "text", "digest").agg(turn.alias("turn"))
    firsts = firsts.select("conv_id", "turn", "role", "digest", F.lit(0).cast("long").alias("copies"), "text", F.lit("").alias("fault"))
    there = conv_ids.select("conv_id").distinct().select(
        "conv_id", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("digest"),
        F.lit(0).cast("long").alias("copies"), none.cast("string").alias("text"), F.lit("").alias("fault"),
    )
    dealt = counted.union(firsts).union(there).repartitionByRange("conv_id", "turn", "role", "digest")
    dealt = dealt.sortWithinPartitions("conv_id", "turn", "role", "digest", "copies").withColumn("here", F.spark_partition_id())
    parts = materialise(dealt.mapInArrow(_repair_sorted, _PARTS), "conversation-parts")
    names = [f.split()[0] for f in _RESULT.split(", ")]
    spread = parts.filter("kind > 0").repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "step").select("conv_id", "kind", "body")
    return parts.filter("kind = 0").select(*names).union(spread.mapInArrow(_join_parts, _RESULT))
