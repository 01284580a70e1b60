import json

import pytest
from pyspark.sql import functions as F

from worktrace import schemas
from worktrace.operators import access, answers, highlights, load
from worktrace.sources import documents, tables
from worktrace.streaming import file_drop

HAND = [[0.1, 0.2, 0.3]] * 21


def document(path, n):
    tool = {"label": "car", "confidence": 0.9, "x1": 1, "y1": 2, "x2": 3, "y2": 4}
    frames = [
        {
            "timestamp_sec": 0.5 * k, "detected_tools": [tool] if k % 2 else None,
            "hand_movement_vector": {"left_hand": HAND if k == 7 else None, "right_hand": None},
        } for k in range(n)
    ]
    entry = [{**f, "audio_context": None, "detected_tools": [{"label": "car", "confidence": 0.9, "bbox": [1, 2, 3, 4]}]} for f in frames]
    segments = [{"start_sec": 0.0, "end_sec": 1.234, "text": "first 10 mm"}, {"text": "no times"}]
    return {
        "file_path": path, "duration_sec": 5.0, "fps": 30.0, "total_frames": 150, "audio_transcript": segments,
        "frame_features": frames, "integrated_timeline": entry,
    }


def dropped(folder, name, n):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}_features.json").write_text(json.dumps(document(f"/v/{name}.mp4", n), indent=2, ensure_ascii=False))


def test_features_round_trip(spark, tmp_path):
    dropped(tmp_path / "in", "one", 10)
    read = documents.read_features(spark, f"file://{tmp_path}/in")
    assert read.select("stem", "file_path").first() == ("one", "/v/one.mp4")
    f = read.withColumn("video_id", F.lit(1))
    segs, frames, line = (g(f, "video_id") for g in (documents.segments, documents.frames, documents.timeline))
    assert [(r.seg_pos, r.start_ms, r.end_ms) for r in segs.orderBy("seg_pos").collect()] == [(0, 0, 1234), (1, 0, 0)]
    again = documents.nested_features(f.select("video_id", "file_path", "duration_sec", "fps", "total_frames"), segs, frames, line)
    documents.write_features(again, f"file://{tmp_path}/out")
    names = schemas.FEATURES.names
    assert documents.read_features(spark, f"file://{tmp_path}/out").select(*names).collect() == read.select(*names).collect()


def test_many_documents_a_file_come_back(spark, tmp_path):
    for name in ("one", "two", "three"):
        dropped(tmp_path / "in", name, 4)
    read = documents.read_features(spark, f"file://{tmp_path}/in").select(*schemas.FEATURES.names)
    want = sorted(map(str, read.collect()))
    documents.write_features(read.coalesce(1), f"file://{tmp_path}/all")
    documents.write_features(read, f"file://{tmp_path}/each", one_per_file=True)
    read.coalesce(1).write.option("ignoreNullFields", "false").json(f"file://{tmp_path}/lines")
    for path, lines in (("all", False), ("each", False), ("lines", True)):
        back = documents.read_features(spark, f"file://{tmp_path}/{path}", lines).select(*schemas.FEATURES.names)
        assert sorted(map(str, back.collect())) == want
    (one,) = (tmp_path / "each" / "video=two").glob("*.txt")
    assert json.loads(one.read_text())["file_path"] == "/v/two.mp4"
    (file,) = (tmp_path / "all").glob("*.txt")
    assert len(json.loads(file.read_text())) == 3


def test_arrays_of_any_size(spark, tmp_path):
    for n, parts in ((0, 1), (1, 3), (7, 2), (25_000, 2)):
        rows = spark.range(n).repartition(parts).selectExpr("cast(id as int) step_number", "'SUCCESS' status", "cast(null as string) standard_manual_text")
        documents.write_insights(rows, f"file://{tmp_path}/{n}")
        back = documents.read_insights(spark, f"file://{tmp_path}/{n}")
        assert sorted(r.step_number for r in back.collect()) == list(range(n))
        assert all(isinstance(json.loads(f.read_text() or "[]"), list) for f in (tmp_path / str(n)).glob("*.txt"))


def test_highlights_and_tables(spark, tmp_path):
    dropped(tmp_path / "in", "one", 10)
    f = documents.read_features(spark, f"file://{tmp_path}/in").withColumn("video_id", F.lit(1).cast("long"))
    frames = documents.frames(f, "video_id")
    found = highlights.highlights(documents.segments(f, "video_id"), highlights.slim_frames(frames))
    assert [(r.highlight_type, r.ts_ms) for r in found.orderBy("section", "pos").collect()] == [("measurement_speech", 617), ("active_hands", 3500)]
    documents.write_highlights(found, f"file://{tmp_path}/h")
    assert spark.read.parquet(f"file://{tmp_path}/h").count() == 2
    assert documents.read_highlights(spark, None).columns == documents.COLUMNS
    rows = load.frame_rows(frames).orderBy("frame_timestamp").collect()
    assert rows[0].detected_tools == "null" and json.loads(rows[7].hand_movement_vector) == {"left_hand": HAND, "right_hand": None}
    assert [
        c for c in spark.read.parquet(f"file://{tmp_path}/h").columns if c != "highlight_type"
    ] == ["video_id", *[c for c in documents.COLUMNS if c != "highlight_type"]]
    documents.write_highlights(found, f"file://{tmp_path}/j", "json")
    (read,) = documents.read_highlights(spark, f"file://{tmp_path}/j").filter("highlight_type = 'active_hands'").collect()
    assert documents.read_highlights(spark, f"file://{tmp_path}/j").count() == 2
    assert (float(read.timestamp_sec), read.hand_active) == (3.5, True) and "발화 없는" in read.feature_description


def four_tables(spark, tmp_path):
    dropped(tmp_path / "in", "one", 10)
    f = load.video_keys(documents.read_features(spark, f"file://{tmp_path}/in").withColumn("ncs_code", F.lit("")))
    frames = documents.frames(f, "video_id")
    found = highlights.highlights(documents.segments(f, "video_id"), highlights.slim_frames(frames))
    raw = json.dumps([{"step_number": 2, "status": "SUCCESS", "standard_manual_text": "m", "tacit_knowledge_description": "d", "fact_evidence": {}}])
    insights = answers.insights(f.select("video_id", F.lit(raw).alias("raw_response")))
    return {
        "video_metadata": f.select("video_id", "ncs_code", "file_path"), "frame_features": load.frame_rows(frames),
        "tacit_knowledge_insights": load.insight_rows(insights), "behavioral_highlights": load.highlight_rows(found),
    }


def test_load_publishes_all_tables_or_none(spark, tmp_path):
    root, four = f"file://{tmp_path}/db", four_tables(spark, tmp_path)
    sizes = {"video_metadata": 1, "frame_features": 10, "tacit_knowledge_insights": 1, "behavioral_highlights": 2}
    for _ in range(2):  # a rerun replaces the batch
        tables.write_parquet(four, root, "b1")
        assert {n: tables.read_parquet(spark, root, n).count() for n in sizes} == sizes
    broken = four | {"behavioral_highlights": four["behavioral_highlights"].withColumn("hand_active", F.raise_error(F.lit("lost")).cast("int"))}
    with pytest.raises(Exception, match="lost"):
        tables.write_parquet(broken, root, "b2")
    assert {n: tables.read_parquet(spark, root, n).count() for n in sizes} == sizes
    some = access.in_range(
        access.of_video(tables.read_parquet(spark, root, "frame_features"), four["video_metadata"].first().video_id), 1, 2,
        "frame_timestamp",
    )
    plan = some._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters: [IsNotNull(video_id)") :].split("ReadSchema")[0]
    assert some.count() == 3 and "EqualTo(video_id" in pushed and "frame_timestamp" in pushed, plan
    # what the failed run and the replaced attempt wrote
    folders = lambda: {p.parent.name + "/" + p.name for p in (tmp_path / "db" / "frame_features").glob("batch_id=*/attempt=*")}
    assert len(folders()) == 2 and not any("b2" in f for f in folders())
    assert tables.vacuum(spark, root) == []  # too young
    assert len(tables.vacuum(spark, root, older_than_s=-1)) == 4 and len(folders()) == 1
    assert {n: tables.read_parquet(spark, root, n).count() for n in sizes} == sizes


def test_a_killed_run_leaves_nothing_after_the_vacuum(spark, tmp_path):
    root, four = f"file://{tmp_path}/db", four_tables(spark, tmp_path)
    tables.write_parquet(four, root, "b1")
    for name in ("video_metadata", "frame_features"):  # as far as the run came
        four[name].write.parquet(f"{root}/{name}/batch_id=b9/attempt=x")
    assert tables.read_parquet(spark, root, "frame_features").count() == 10
    assert len(tables.vacuum(spark, root, older_than_s=-1)) == 2
    assert not list((tmp_path / "db").glob("*/batch_id=b9/attempt=*"))


def test_batch_ids_are_text(spark, tmp_path):
    root, rows = f"file://{tmp_path}/db", spark.createDataFrame([(1, "x")], "video_id long, file_path string")
    for batch in ("first", "2", "007", "7"):
        tables.write_parquet({"video_metadata": rows}, root, batch)
    assert sorted(r.batch_id for r in tables.read_parquet(spark, root, "video_metadata").collect()) == ["007", "2", "7", "first"]
    numbers = f"file://{tmp_path}/numbers"
    for batch in ("2", "007"):
        tables.write_parquet({"video_metadata": rows}, numbers, batch)
    assert sorted(r.batch_id for r in tables.read_parquet(spark, numbers, "video_metadata").collect()) == ["007", "2"]


def test_a_long_video_is_many_files_and_a_minute_reads_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FILE_ROWS", 1000)
    root = f"file://{tmp_path}/db"
    rows = spark.range(12_000).selectExpr("if(id < 10000, 1L, id) as video_id", "cast(id / 2 as decimal(12,3)) as frame_timestamp", "'[]' as detected_tools")
    tables.write_parquet({"frame_features": rows}, root, "b")
    files = spark.read.parquet(f"{root}/frame_features").selectExpr("*", "_metadata.file_path f")
    assert files.filter("video_id = 1").select("f").distinct().count() >= 10 and files.select("f").distinct().count() < 30
    spans = files.groupBy("f").agg(F.min(F.struct("video_id", "frame_timestamp")).alias("a"), F.max(F.struct("video_id", "frame_timestamp")).alias("b"))
    minute = spans.filter("b >= struct(1L, cast(1000 as decimal(12,3))) and a <= struct(1L, cast(1060 as decimal(12,3)))")
    assert minute.count() <= 2


def test_jdbc_load_and_manual_master(spark, tmp_path):
    url, four = f"jdbc:derby:memory:{tmp_path.name};create=true", four_tables(spark, tmp_path)
    four["tacit_knowledge_insights"] = four["tacit_knowledge_insights"].drop("insight_embedding")  # Derby has no arrays
    sizes = {"video_metadata": 1, "frame_features": 10, "tacit_knowledge_insights": 1, "behavioral_highlights": 2}
    for _ in range(2):
        tables.write_jdbc(four, url, "b1")
        assert {n: tables.read_jdbc(spark, url, n).count() for n in sizes} == sizes
    broken = four | {"behavioral_highlights": four["behavioral_highlights"].withColumn("hand_active", F.raise_error(F.lit("lost")).cast("int"))}
    with pytest.raises(Exception, match="lost"):
        tables.write_jdbc(broken, url, "b1")
    assert {n: tables.read_jdbc(spark, url, n).count() for n in sizes} == sizes
    tables.write_jdbc(four, url, "b2")
    assert tables.read_jdbc(spark, url, "frame_features").count() == 20
    master = spark.createDataFrame([("c1", "m", "text")], schemas.NCS_MODULES)
    master.write.parquet(f"file://{tmp_path}/master")
    master.write.jdbc(url, "ncs_modules")
    assert documents.read_manuals(spark, f"file://{tmp_path}/master").collect() == master.collect()
    assert [tuple(r) for r in documents.read_manuals(spark, url=url, dbtable="ncs_modules").collect()] == [("c1", "m", "text")]


def test_insights_and_manual_text(spark, tmp_path):
    items = [
        {
            "step_number": 1, "status": "SUCCESS", "standard_manual_text": None, "tacit_knowledge_description": "d",
            "fact_evidence": {"detected_tools": ["car"], "verified_quotes": []},
        }
    ] * 3
    (tmp_path / "x_insights.json").write_text(json.dumps(items, indent=2))
    (tmp_path / "m.txt").write_text("line 1\nline 2")
    read = documents.read_insights(spark, f"file://{tmp_path}/x_insights.json")
    assert read.count() == 3 and read.first().stem == "x"
    documents.write_insights(read.drop("source_path", "stem"), f"file://{tmp_path}/out")
    assert documents.read_insights(spark, f"file://{tmp_path}/out").drop("source_path", "stem").collect() == read.drop("source_path", "stem").collect()
    assert documents.read_manual_text(spark, f"file://{tmp_path}/m.txt").first().manual_text == "line 1\nline 2"


def test_file_drop_takes_each_document_once(spark, tmp_path):
    where = [f"file://{tmp_path}/{d}" for d in ("in", "out", "state")]
    for name in ("one", "two"):
        dropped(tmp_path / "in", name, 10)
        file_drop.highlights_on_arrival(spark, *where).awaitTermination(120)
    found = spark.read.parquet(where[1])
    assert found.count() == 4 and {r.video_id for r in found.collect()} == {
        r.id for r in spark.createDataFrame([("/v/one.mp4",), ("/v/two.mp4",)], "p string").select(load.video_key(F.col("p")).alias("id")).collect()
    }


def test_most_similar_in_blocks(spark):
    rows = spark.createDataFrame(
        [(i, [float(i % 5), 1.0, float(i % 7)]) for i in range(40)] + [(99, [0.0, 0.0, 0.0])], "id long, embedding array<float>",
    )
    one = access.most_similar(rows, rows.repartition(3), 4).collect()
    assert sorted(one) == sorted(access.most_similar(rows, rows.repartition(5), 4, block=7).collect()) and len(one) == 160
    assert sorted(one) == sorted(access.most_similar(rows, rows, 4, block=7, part=9).collect())
