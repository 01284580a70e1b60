from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tests.test_documents import document
from worktrace.sources import documents, feature_stream


def same(spark, path):
    read = documents.read_features(spark, path)
    got = feature_stream.read(spark, path)
    names = [f.name for f in feature_stream.SCALARS]
    # a document of no known key has no row in the stream
    want = read.select("source_path", "stem", *names).filter(F.coalesce(*[F.col(n).cast("string") for n in names]).isNotNull())
    assert sorted(map(str, got["videos"].select("source_path", "stem", *names).collect())) == sorted(map(str, want.collect()))
    for name, schema in feature_stream.SECTIONS.items():
        rows = documents._exploded(read, "source_path", name, "pos").select("source_path", "pos", *schema.names)
        assert sorted(map(str, got[name].select("source_path", "pos", *schema.names).collect())) == sorted(map(str, rows.collect())), name


@pytest.fixture
def small_parts(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "3000")
    spark.conf.set(names[1], "100")
    yield
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


def test_stream_equals_whole_documents(spark, tmp_path, small_parts):
    """Files of several parts, whose elements lie across them, and small ones; odd strings and layouts."""
    for name, n in (("long", 60), ("short", 2), ("none", 0)):
        (tmp_path / f"{name}_features.json").write_text(json.dumps(document(f"/v/{name}.mp4", n), indent=2))
    odd = document("/v/odd [1] {x} \"q\" \\.mp4", 3)
    odd["audio_transcript"] = [{"start_sec": 1, "end_sec": 2, "text": t} for t in ("]}", '"frame_features": [', "\\", '\\"{', "a\nb", "한국어", "")] * 40
    odd["unknown"] = {"audio_transcript": [{"text": "not this"}], "x": [1, 2, {"y": []}]}
    odd["integrated_timeline"] = None
    (tmp_path / "odd_features.json").write_text(json.dumps(odd, indent=2, ensure_ascii=False))
    (tmp_path / "flat_features.json").write_text(json.dumps(document("/v/flat.mp4", 5)))
    (tmp_path / "wide_features.json").write_text(json.dumps(document("/v/wide.mp4", 9), indent=8))
    path = f"file://{tmp_path}"
    assert len(feature_stream._begins(spark, path)) > 20
    same(spark, path)


def test_empty_files_and_keys_in_any_order(spark, tmp_path):
    (tmp_path / "a_features.json").write_text(json.dumps({"integrated_timeline": [], "frame_features": [{}], "fps": 25.0}, indent=2))
    (tmp_path / "b_features.json").write_text("{\n}\n")
    same(spark, f"file://{tmp_path}")
    assert feature_stream.read(spark, f"file://{tmp_path}")["audio_transcript"].count() == 0


def test_no_row_holds_a_document(spark, tmp_path, small_parts):
    (tmp_path / "long_features.json").write_text(json.dumps(document("/v/long.mp4", 400), indent=2))
    lines = feature_stream._lines(spark, f"file://{tmp_path}")
    cut = lines.mapInArrow(feature_stream._cutter(feature_stream._begins(spark, f"file://{tmp_path}")), feature_stream._CUT)
    longest = cut.agg(F.max(F.length("body"))).first()[0]
    assert lines.rdd.getNumPartitions() > 50 and longest < 12_000
