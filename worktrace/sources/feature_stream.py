"""Features documents of any size, read by their lines.

A document is one indented JSON object per file. A line never begins inside a string, so
what brackets it opens and closes can be told from the line alone: a first pass sums
them per part of a file, which says how deep each part begins and in which array. The
second pass cuts every part into the elements of the three arrays on its own. Elements
that lie across parts are put together, the others never meet. So a task holds one
element, whatever the length of a recording, and large files are read by many tasks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worktrace import schemas
from worktrace.functions.text import artefact_stem
from worktrace.sources.storage import materialise

SECTIONS = {"audio_transcript": schemas.SEGMENT, "frame_features": schemas.FRAME, "integrated_timeline": schemas.TIMELINE_ENTRY}
SCALARS = [f for f in schemas.FEATURES.fields if f.name not in SECTIONS]

_MARKS = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]')
_COLON = re.compile(r"\s*:\s*")
_SCALAR = re.compile(r'"(?:[^"\\]|\\.)*"|[^\s,\[\]{}"]+')
_OUTLINE = "file string, b long, net int, opened string"
_CUT = "file string, b long, section string, at int, body string, whole boolean"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, b, value): lines in order, b the place in the file where their part begins."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("b"), "value")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, own in groupby(rows, key=lambda r: (r[0], r[1])):
        yield key, (r[2] for r in own)


def _marks(line: str) -> Iterator[tuple[str, int, str | None, str | None]]:
    """(bracket or empty, place, key before it, scalar value of that key): brackets and, with an empty bracket, keys of scalars, outside strings."""
    key, value = None, -1
    for m in _MARKS.finditer(line):
        if m[0][0] != '"':
            yield m[0], m.start(), key if m.start() == value else None, None
        elif m.start() != value and (colon := _COLON.match(line, m.end())):
            key, value = m[0][1:-1], colon.end()
            if scalar := _SCALAR.match(line, value):
                yield "", m.start(), key, scalar[0]


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How much deeper each part ends than it begins, and the sections it opens with their depth from its beginning."""
    for (file, b), lines in _parts(batches):
        depth, opened = 0, []
        for line in lines:
            if not any(c in line for c in "[]{}"):
                continue
            for mark, _, key, _ in _marks(line):
                if mark in ("[", "{"):
                    if mark == "[" and key in SECTIONS:
                        opened.append((depth, key))
                    depth += 1
                elif mark:
                    depth -= 1
        row = [pa.array([file]), pa.array([b]), pa.array([depth], pa.int32()), pa.array([json.dumps(opened)])]
        yield pa.RecordBatch.from_arrays(row, ["file", "b", "net", "opened"])


def _begins(spark: SparkSession, path: str) -> dict[tuple[str, int], tuple[int, str | None]]:
    """Depth and section at the beginning of each part that is not the first of its file: as many as large files have parts more than one."""
    outline = materialise(_lines(spark, path).mapInArrow(_outline, _OUTLINE), "features-outline")
    many = outline.groupBy("file").agg(F.max("b").alias("m")).filter("m > 0").select("file")
    out: dict[tuple[str, int], tuple[int, str | None]] = {}
    file, depth, section = None, 0, None
    for r in outline.join(many, "file", "left_semi").orderBy("file", "b").toLocalIterator():
        if r["file"] != file:
            file, depth, section = r["file"], 0, None
        if r["b"]:
            out[file, r["b"]] = (depth, section if depth >= 2 else None)
        for before, name in json.loads(r["opened"]):
            if depth + before == 1:
                section = name
        depth += r["net"]
    return out


def _cutter(begins: dict[tuple[str, int], tuple[int, str | None]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines -> elements (section, number in the part, text) and scalars (their key, -2, value); -1: the rest of the element before."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for (file, b), lines in _parts(batches):
            depth, section = begins.get((file, b), (0, None))
            count: dict[str, int] = {}
            pieces: list[str] = []
            whole, at = False, -1  # of the element that is open
            for line in lines:
                begin = 0  # of what belongs to the element in this line
                for mark, place, key, value in _marks(line) if depth == 1 or any(c in line for c in "[]{}") else ():
                    if not mark:
                        if depth == 1:
                            rows.append((file, b, key, -2, value, True))
                    elif mark in "[{":
                        if depth == 1:
                            section = key if mark == "[" and key in SECTIONS else None
                        if depth == 2 and section:
                            at = count.get(section, 0)
                            count[section] = at + 1
                            begin, whole, pieces = place, True, []
                        depth += 1
                    else:
                        depth -= 1
                        if depth == 2 and section:
                            pieces.append(line[begin : place + 1])
                            rows.append((file, b, section, at, "\n".join(pieces), whole))
                            size += sum(map(len, pieces))
                            pieces, whole, at = [], False, -1
                if depth > 2 and section:
                    pieces.append(line[begin:])
                if len(rows) >= 1000 or size > 4 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if pieces and section:
                rows.append((file, b, section, at, "\n".join(pieces), False))
        if rows:
            yield _batch(rows)

    return cut


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [f.split()[0] for f in _CUT.split(", ")])


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts of the features documents at `path`: `videos` (source_path, stem and the scalars) and each array's rows (source_path, pos, fields).

    The same as read_features() and its arrays, but no task and no row holds a whole
    document. Arrays that are missing, null or empty have no rows; unknown keys are
    passed over; an empty file has nothing. Lines may be long, a document all in one
    line is one task's. Elements with odd values have nulls, as with Spark's reader.
    """
    lines, begins = _lines(spark, path), _begins(spark, path)
    found = materialise(lines.mapInArrow(_cutter(begins), _CUT), "features-cut")
    elements = found.filter("at >= -1")
    starts = elements.filter("at >= 0").groupBy("file", "section", "b").agg(F.count("*").alias("n"))
    places = elements.select("file", "section", "b").distinct().join(starts, ["file", "section", "b"], "left")
    order = Window.partitionBy("file", "section").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # a row per part of a file
    places = places.select("file", "section", "b", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(order), F.lit(0)).alias("before"))
    numbered = elements.join(places, ["file", "section", "b"]).withColumn("pos", (F.col("before") + F.col("at")).cast("int"))
    across = numbered.filter("not whole").groupBy("file", "section", "pos").agg(F.array_sort(F.collect_list(F.struct("b", "body"))).alias("x"))
    joined = across.select("file", "section", "pos", F.array_join(F.transform("x", lambda e: e["body"]), "\n").alias("body"))
    every = numbered.filter("whole").select("file", "section", "pos", "body").unionByName(joined)
    out = {}
    for name, schema in SECTIONS.items():
        rows = every.filter(F.col("section") == name).select(F.col("file").alias("source_path"), "pos", F.from_json("body", schema).alias("x"))
        out[name] = rows.select("source_path", "pos", "x.*")
    value = F.get_json_object(F.concat(F.lit('{"x":'), "body", F.lit("}")), "$.x")
    scalars = [F.max(F.when(F.col("section") == f.name, value)).try_cast(f.dataType).alias(f.name) for f in SCALARS]
    videos = found.filter("at = -2").groupBy(F.col("file").alias("source_path")).agg(*scalars)
    out["videos"] = videos.withColumn("stem", artefact_stem(F.col("source_path")))
    return out
