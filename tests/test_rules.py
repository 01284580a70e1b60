import pytest
from pyspark.sql import functions as F

import random

from worktrace.functions import hands, text
from worktrace.operators import answers, extraction, highlights, load, synthesis


def column(spark, values, expression, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(expression(F.col("x"))).collect()]


def test_measurements(spark):
    cases = {
        "10 mm": ["10 mm"], "half inch": ["half inch"], "5 barrels": ["5 bar"], "1,000 rpm": ["000 rpm"], "M10 bolt": [],
        "five minutes": [], "twenty-one in": ["one in"],
        "10\xa0mm": ["10\xa0mm"], "5\nmm": ["5\nmm"], "3.5 KG and 20 Ft-Lb": ["3.5 KG", "20 Ft-Lb"], "": [],
    }
    assert column(spark, cases, text.measurements) == list(cases.values())


def test_keywords(spark):
    cases = {
        "FIRST, strengthen": ["first", "then"], "monkey": ["key"], "그다음": ["다음", "그다음"], "nothing": [],
        "after that be sure": ["after that", "be sure"],
    }
    assert column(spark, cases, text.keywords) == list(cases.values())


def test_text_of_lists_and_numbers(spark):
    assert column(spark, [["5\nmm", "10\xa0mm"], []], text.list_text, "array<string>") == [repr(["5\nmm", "10\xa0mm"]), "[]"]
    times = [0, 50, 150, 250, 1250, 12350, 999_950, 3]
    assert column(spark, times, text.one_decimal, "long") == [f"{t / 1000:.1f}" for t in times]
    assert column(spark, ["  a b　", "\xa0\n"], text.strip) == ["a b", ""]
    assert column(spark, ["s3://x/a_features.json", "/y/b.json"], text.artefact_stem) == ["a", "b"]


def test_priority_and_order_of_highlights(spark):
    segs = [
        (1, 0, 0, 1001, " tighten to 10 mm, then check "), (1, 1, 2000, 3000, "then next"), (1, 2, 4000, 5000, "hello"),
        (1, 3, 6000, 7000, "hello"), (1, 4, 8000, 9000, " "),
    ]
    frames = [
        (1, 0, 500, ["chair", "car", "car", "bus"], True), (1, 1, 4000, ["knife"], False), (1, 2, 6500, ["chair"], False),
        (1, 3, 8500, ["car"], True), (1, 4, 20250, ["bus", "chair", "bus"], True),
    ]
    s = spark.createDataFrame(segs, "video_id long, seg_pos long, start_ms long, end_ms long, text string")
    f = spark.createDataFrame(frames, "video_id long, frame_pos long, ts_ms long, labels array<string>, hand_active boolean")
    rows = highlights.highlights(s, f).orderBy("section", "pos").collect()
    assert [(r.pos, r.highlight_type, r.ts_ms, r.detected_tools, r.hand_active) for r in rows] == [
        (0, "measurement_speech", 501, ["bus", "car"], True), (1, "procedural_speech", 2500, [], False),
        (2, "tool_active_speech", 4500, ["knife"], False), (4, "active_hands", 20250, ["bus", "bus"], True)
    ]
    assert rows[0].trigger_reason == "수치 단위 발화: ['10 mm']" and rows[0].feature_description == "[0.5초] 정비 수치 발화 감지 — 10 mm 언급, 손 동작 활성"
    assert rows[1].trigger_reason == "절차 키워드 발화: ['then', 'next']" and rows[1].feature_description == "[2.5초] 작업 절차/주의사항 발화 — 키워드: then, next"
    assert rows[2].feature_description == "[4.5초] 작업 중 발화 감지 — 감지 객체: knife" and rows[3].feature_description == "[20.2초] 발화 없는 손 작업 집중 구간"
    assert rows[3].speech_quote is None


@pytest.mark.parametrize("n", [0, 1, 30, 31, 59, 60, 61, 95])
def test_sample(spark, n):
    rows = spark.range(n).select(F.lit(7).alias("video_id"), (F.col("id") * 3).alias("frame_pos"))
    items = [3 * i for i in range(n)]
    want = items if n <= 30 else items[:: max(1, n // 30)][:30]
    got = synthesis.sampled(rows).orderBy("sample_pos").collect()
    assert [r.frame_pos for r in got] == want and [r.sample_pos for r in got] == list(range(len(want)))


def test_prompts_have_all_keys_of_an_entry(spark):
    import json

    from tests.conftest import SF
    from worktrace.plans.queries import QUERIES

    said = {}
    for r in QUERIES["timeline_sample30"](spark, SF).collect():
        said.setdefault(r.video_id, {})[r.sample_pos] = r.audio_context
    head, _, middle = synthesis.PROMPT.partition("{timeline}")
    seen = []
    for r in QUERIES["prompt_entries"](spark, SF).filter("prompt is not null").collect():
        entries = json.loads(r.prompt[len(head) :].split(middle.split("{manual}")[0])[0])
        assert [e["audio_context"] for e in entries] == [said[r.video_id][k] for k in sorted(said[r.video_id])]
        seen += [h for e in entries for h in e["hand_movement_vector"].values()]
    assert None in seen and any(h and h["landmark_count"] == 21 and len(h["wrist_xy"]) == 2 for h in seen)


ITEM = '{"step_number": 1, "status": "SUCCESS", "standard_manual_text": null, "tacit_knowledge_description": "d", "fact_evidence": {"detected_tools": ["car"], "verified_quotes": ["q"]}}'


def test_answers(spark):
    raw = [
        f"[{ITEM}]", f"```json\n[{ITEM}]\n```", f"```\n[{ITEM}]", ITEM, "[1, 2]", f"[{ITEM}] and more",
        f"[{ITEM}, {ITEM.replace('SUCCESS', 'OTHER')}, {{}}]", "[]", "", f" \n[{ITEM.replace('1,', '2.9,', 1)}]\n",
        f"[{ITEM.replace('standard_manual_text', 'other')}]",
    ]
    df = spark.createDataFrame(list(enumerate(raw)), "video_id long, raw_response string")
    got = answers.insights(df).orderBy("video_id", "item_pos").collect()
    assert [(r.video_id, r.step_number) for r in got] == [(0, 1), (1, 1), (2, 1), (6, 1), (9, 2)]
    assert got[0].fact_evidence.detected_tools == ["car"] and got[0].standard_manual_text is None
    assert {r.video_id: r.reason for r in answers.rejected_answers(df).collect()} == {
        3: "not_a_json_array", 4: "not_a_json_array", 5: "not_a_json_array", 7: "no_valid_insight", 8: "not_a_json_array",
        10: "no_valid_insight",
    }
    bad = {(r.video_id, r.item_pos): r.reason for r in answers.rejected_items(df).collect()}
    assert bad[6, 1] == "status: OTHER" and bad[6, 2].startswith("missing: step_number, ") and bad[10, 0] == "missing: standard_manual_text"


def test_steps_that_are_no_numbers_are_reported(spark):
    steps = ["1", "2.9", "null", '"3"', '"three"', '""', "1e20", '"NaN"']
    df = spark.createDataFrame([(i, f"[{ITEM.replace('1,', f'{s},', 1)}]") for i, s in enumerate(steps)], "video_id long, raw_response string")
    assert [r.step_number for r in answers.insights(df).orderBy("video_id").collect()] == [1, 2, None, 3, None, None, None, None]
    lost = answers.rejected_steps(df).orderBy("video_id").collect()
    assert [(r.video_id, r.item_pos) for r in lost] == [(4, 0), (5, 0), (6, 0), (7, 0)] and lost[0].step_number == "three"


def test_evidence_audit(spark):
    df = spark.createDataFrame([(1, f"[{ITEM}, {ITEM.replace('SUCCESS', 'MISMATCH')}]"), (2, f"[{ITEM}]")], "video_id long, raw_response string")
    labels = spark.createDataFrame([(1, "car")], "video_id long, label string")
    said = spark.createDataFrame([(2, 0, " q ")], "video_id long, seg_pos long, text string")
    rows = answers.evidence_audit(answers.insights(df), labels, said).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, "quote", "q"), (1, 1, "description", "d"), (1, 1, "quote", "q"), (2, 0, "tool", "car")]


def test_hands(spark):
    points = [[0.1, 0.2, 0.3], [0.5, 0.7, 0.0], [9.0]]
    assert column(spark, [points, [], None], hands.summary, "array<array<double>>") == [([0.1, 0.2], 0.3, 0.45, 3), None, None]
    rows = [(1, "Left", [[0.12345]], 0), (1, "Left", [[0.5]], 2), (1, "odd", [[0.7]], 1), (2, None, [[1.0]], 0)]
    got = extraction.hands_by_side(
        spark.createDataFrame(rows, "frame long, handedness string, landmarks array<array<double>>, hand_pos int"), "frame",
    ).collect()
    assert {r.frame: (r.left_hand, r.right_hand) for r in got} == {1: ([[0.5]], [[0.7]]), 2: (None, [[1.0]])}


def test_detections_and_sampling(spark):
    boxes = [
        [
            {"label": "a", "confidence": 0.4, "x1": 1.9, "y1": -1.9, "x2": 3.0, "y2": 4.0},
            {"label": "b", "confidence": 0.39999, "x1": 0.0, "y1": 0.0, "x2": 0.0, "y2": 0.0},
        ]
    ]
    kind = "array<struct<label:string,confidence:double,x1:double,y1:double,x2:double,y2:double>>"
    assert column(spark, boxes, lambda c: extraction.boxes_as_lists(extraction.confident_boxes(c)), kind) == [[("a", 0.4, [1, -1, 3, 4])]]
    videos = spark.createDataFrame([(1, None, 31), (2, 0.0, 1), (3, 1.0, 3), (4, 25.0, 0)], "video_id long, fps double, total_frames long")
    got = {}
    for r in extraction.sampling_grid(videos).collect():
        got.setdefault(r.video_id, []).append((r.frame_idx, r.timestamp_sec))
    assert got == {1: [(0, 0.0), (15, 0.5), (30, 1.0)], 2: [(0, 0.0)], 3: [(0, 0.0), (1, 1.0), (2, 2.0)]}
    assert [r.duration_sec for r in extraction.video_stats(videos).orderBy("video_id").collect()] == [1.033, 0.033, 3.0, 0.0]


def test_manual_precedence_and_load(spark):
    videos = spark.createDataFrame([(1, "A"), (2, ""), (3, "Z")], "video_id long, ncs_code string")
    manuals = spark.createDataFrame([("A", "m", "text A")], "ncs_code string, module_name string, standard_manual_text string")
    own = synthesis.with_manual(videos, manuals, text=F.when(F.col("video_id") == 3, "given"), file_text=F.when(F.col("video_id") > 1, "file"))
    assert {r.video_id: r.manual_text for r in own.collect()} == {1: "text A", 2: "file", 3: "given"}
    assert {r.video_id: r.reason for r in synthesis.missing_manuals(videos, manuals).collect()} == {2: "no_code", 3: "unknown_code"}
    some = spark.createDataFrame([(1,), (1,), (2,)], "video_id long")
    assert {(r.video_id, r.reason) for r in load.rejected(videos, some, some, some.limit(0)).collect()} == {
        (1, "no_insights"), (2, "no_insights"), (3, "no_timeline"), (3, "no_frames"), (3, "no_insights"),
    }
    assert load.cascade(some, videos.filter("video_id = 1")).count() == 1 and load.cascaded(some, videos.filter("video_id = 1")).count() == 2


def test_only_one_strict_array_is_an_answer(spark):
    good = [f"[{ITEM}]", "[]", f"```json\n[{ITEM}, {ITEM}]\n```", f"  [{ITEM}]  "]
    bad = [
        f"[{ITEM}] and so on", f"[{ITEM}] and so on []", f"[{ITEM}][{ITEM}]", f"[{ITEM}], [{ITEM}]", f"[{ITEM}]".replace('"', "'"),
        f'[{ITEM}],"y":[]', f"[{ITEM}]]\n,[[{ITEM}]", f'[{ITEM}]}},{{"x":[{ITEM}]', ITEM, "[1, 2]", "", None, "[", f"[{ITEM},]",
    ]
    df = spark.createDataFrame(list(enumerate(good + bad)), "video_id long, raw_response string")
    got = {r.video_id: r["items"] is not None for r in answers.parsed(df).collect()}
    assert got == {i: i < len(good) for i in range(len(good + bad))}


def test_snippets_of_rejected_answers(spark):
    df = spark.createDataFrame([(1, "한" * 700), (2, "no"), (3, None)], "video_id long, raw_response string")
    assert {r.video_id: r.snippet for r in answers.rejected_answers(df).collect()} == {1: "한" * 500, 2: "no", 3: None}


def test_quotes_against_brute_force(spark):
    r = random.Random(3)
    words = ["torque", "to", "10", "mm", "then", "stop", "the"]
    said = [(v, p, " ".join(r.choices(words, k=r.choice([0, 1, 1, 2, 5, 9])))) for v in range(4) for p in range(12)]
    whole = {v: " ".join(["", *(w for x, _, t in said if x == v for w in t.split()), ""]) for v in range(5)}
    quotes = [(v, k, " ".join(r.choices(words, k=r.randint(1, 6)))) for v in range(5) for k in range(60)]
    quotes += [(v, 100 + k, " ".join(whole[v].split()[k : k + n])) for v in range(4) for k, n in ((0, 4), (3, 12), (5, 1), (7, 2), (2, 30))]
    segments = spark.createDataFrame(said, "video_id long, seg_pos long, text string")
    df = spark.createDataFrame(quotes, "video_id long, item_pos long, text string")
    got = {(x.video_id, x.item_pos) for x in answers.unspoken(df, segments).collect()}
    assert got == {(v, k) for v, k, t in quotes if f" {t} " not in whole[v]} and 30 < len(got) < len(quotes)
    said = spark.createDataFrame([(1, 0, "first torque to 10"), (1, 1, None), (1, 2, "mm then stop")], "video_id long, seg_pos long, text string")
    df = spark.createDataFrame([(1, 0, "torque to 10 mm"), (1, 1, "torque to 1"), (2, 2, "stop")], "video_id long, item_pos long, text string")
    assert {x.item_pos for x in answers.unspoken(df, said).collect()} == {1, 2}


def test_evidence_audit_parses_answers_once(spark, monkeypatch):
    """What items claim is written once; the rest reads it, and no text of an answer is parsed behind it."""
    kept, keep = [], answers.storage.materialise
    monkeypatch.setattr(answers.storage, "materialise", lambda df, name: kept.append((name, df._jdf.queryExecution().toString())) or keep(df, name))
    evidence = '{"detected_tools": ["car", null, "saw"], "verified_quotes": [" a  b c d ", "b", "c d", "d e f", "  ", null, "x y"]}'
    texts = [f"[{ITEM.replace('SUCCESS', 'MISMATCH')[:-1]}, \"fact_evidence\": {evidence}}}]".replace('"fact_evidence": {"detected_tools": ["car"], "verified_quotes": ["q"]}, ', "")]
    df = spark.createDataFrame([(v, t) for v in (1, 2) for t in texts], "video_id long, raw_response string")
    labels = spark.createDataFrame([(1, "car"), (1, "car"), (2, "saw")], "video_id long, label string")
    said = spark.createDataFrame([(1, 0, "z a b"), (1, 1, " "), (1, 2, "c  d e"), (3, 0, "x y")], "video_id long, seg_pos long, text string")
    rows = answers.evidence_audit(answers.insights(df), labels, said)
    got = sorted((r.video_id, r.rule, str(r.detail)) for r in rows.collect())
    assert [r for r in got if r[0] == 1] == [(1, "description", "d"), (1, "quote", "d e f"), (1, "quote", "x y"), (1, "tool", "None"), (1, "tool", "saw")]
    assert [r[1:] for r in got if r[0] == 2] == [("description", "d"), *[("quote", q) for q in ("a  b c d", "b", "c d", "d e f", "x y")], ("tool", "None"), ("tool", "car")]
    assert [name for name, _ in kept] == ["claims", "quotes"]
    assert "from_json" not in rows._jdf.queryExecution().toString() and "from_json" not in kept[1][1]
