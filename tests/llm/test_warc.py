import gzip
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from worktrace.llm import warc
from worktrace.llm.common import BITMAP_BITS, bitmap_parts, new_path, with_bit

SCHEMA = "page_id long, url string, html string, digest string, salt int, first string, me string"


def brute(rows):
    first = {}
    for i, _, t, *_ in rows:
        t = t or ""
        if i is not None and (t not in first or i < first[t]):
            first[t] = i
    out = []
    for i, _, t, *_ in rows:
        data = (t or "").encode()
        again = len(data) >= 100 and (t or "") in first and i != first[t or ""]
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[t or ""] if again else None))
    return Counter(out)


def edge_pages():
    big, nasty = "<p>é漢 WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n</p>" * 5, "x" * 99
    rows = [
        (5, "http://a/1", big), (3, "http://a/2", big), (3, "http://a/2", big), (9, None, big), (None, "http://b/", big),
        (1, "http://c/\r\nEvil: 1 x", None), (2, "", ""), (4, "http://d", nasty), (6, "http://e", nasty),
    ]
    rows += [
        (7, "http://f", nasty + "é"), (8, "http://g", nasty + "é"), (None, None, None), (None, "u", "only without an id " * 9),
        (10, "http://h", "long " * 400_000),
    ]
    return [(*r, "d", 1, "f", "m") for r in rows]


@pytest.fixture(scope="module")
def archive(spark):
    path = new_path(spark, "test-warc")
    warc.write(spark.createDataFrame(edge_pages(), SCHEMA), path)
    return path


def test_round_trip_equals_brute_force(spark, archive):
    got = warc.page_captures(warc.assemble(warc.read(spark, archive)))
    assert Counter(map(tuple, got.collect())) == brute(edge_pages())


def test_one_nested_row_per_capture(spark, archive):
    rows = warc.assemble(warc.read(spark, archive)).collect()
    assert len(rows) == len(edge_pages()) == len({r.capture_id for r in rows})
    assert all(len(r.requests) == 1 and len(r.metadata) == 1 for r in rows)
    payloads = Counter(bytes(r.response.payload).decode() for r in rows if r.response.type == "response")
    assert payloads["long " * 400_000] == 1 and payloads[edge_pages()[0][2]] == 2


def test_empty_and_null_tables(spark):
    for rows, n in (([], 0), ([(None,) * 7] * 3, 3)):
        path = new_path(spark, "test-warc")
        warc.write(spark.createDataFrame(rows, SCHEMA), path)
        assert warc.page_captures(warc.assemble(warc.read(spark, path))).count() == n


def record(kind, i, block, **more):
    head = [
        b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: <" + i + b">",
        *[b"WARC-" + k.replace("_", "-").encode() + b": <" + v + b">" for k, v in more.items()]
    ]
    kinds = {b"metadata": b"application/warc-fields"}
    return b"\r\n".join([*head, b"Content-Type: " + kinds.get(kind, b"application/http"), b"Content-Length: %d" % len(block), b"", block, b"", b""])


def test_links_in_either_direction_and_through_the_request(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\nbody\xff"
    one = record(b"response", b"r1", http, Concurrent_To=b"q1") + record(b"request", b"q1", b"GET / HTTP/1.1\r\n\r\n") + record(
        b"metadata", b"m1", b"a: 1\r\n", Concurrent_To=b"q1",
    )
    two = record(b"metadata", b"m2", b"b: 2", Concurrent_To=b"r2") + record(b"response", b"r2", http) + record(
        b"metadata", b"lost", b"", Concurrent_To=b"nobody",
    )
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two[: two.index(b"WARC/1.1", 5)]))
    (tmp_path / "two.warc").write_bytes(two[two.index(b"WARC/1.1", 5) :])
    rows = {r.capture_id: r for r in warc.assemble(warc.read(spark, f"file://{tmp_path}")).collect()}
    assert set(rows) == {"r1", "r2"}
    assert [r.record_id for r in rows["r1"].requests] == ["q1"] and [r.record_id for r in rows["r1"].metadata] == ["m1"]
    assert rows["r2"].requests == [] and [r.record_id for r in rows["r2"].metadata] == ["m2"]
    assert bytes(rows["r1"].response.payload) == b"body\xff"
    df = spark.createDataFrame(
        [(rows["r1"].metadata,)],
        "m array<struct<record_id:string,target_uri:string,fields:array<struct<key:string,value:string>>>>",
    )
    assert df.select(warc.field(F.col("m"), "a"), warc.field(F.col("m"), "z")).first() == ("1", None)


def test_blocks_with_line_ends_are_put_together():
    blocks = [b"", b"\r\n", b"\r", b"a\r\n", b"\r\n\r\nWARC/1.1\r\n", b"x\r\r\n\ny", b"\n", b"end\r\n\r\n"]
    data = b"".join(record(b"response", b"%d" % k, b) for k, b in enumerate(blocks))
    found = list(warc.parse(data.split(b"\r\n")))
    assert [b for _, _, _, b in found] == blocks and not any(e for _, e, _, _ in found)
    assert [data[o : o + 8] for o, _, _, _ in found] == [b"WARC/1.1"] * len(blocks)


def test_damaged_archives_give_reject_rows(spark, tmp_path):
    good, http = record(b"response", b"ok", b"HTTP/1.1 200 OK\r\n\r\nbody"), b"HTTP/1.1 200 OK\r\n\r\nbody"
    headless = b"WARC/1.1\r\nWARC-Type: response\r\n\r\n"
    cut = record(b"response", b"cut", http * 50)[:-100]
    files = {
        "a.warc.gz": gzip.compress(headless + good), "b.warc.gz": gzip.compress(good + cut),
        "c.warc.gz": gzip.compress(good) + gzip.compress(cut * 400)[:-30],
        "d.warc.gz": b"no archive", "e.warc": good + b"WARC/1.1\r\nWARC-Type: resp", "f.warc": b"", "g.warc.gz": gzip.compress(good),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    with pytest.raises(Exception):  # noqa: B017,PT011  by default nothing is left out in silence
        warc.read(spark, f"file://{tmp_path}").collect()
    rows = warc.read(spark, f"file://{tmp_path}", damaged="reject").collect()
    assert len([r for r in rows if r.record_id == "ok"]) == 5 and all(r.payload == b"body" for r in rows if r.record_id == "ok")
    bad = {(r.file.rpartition("/")[2], r.error): r.offset for r in warc.rejected(spark, f"file://{tmp_path}").collect()}
    assert bad.pop(("c.warc.gz", "damaged")) > len(good)
    bad.pop(("c.warc.gz", "truncated"), None)  # if the reader got that far
    assert bad == {
        ("a.warc.gz", "no_content_length"): 0, ("b.warc.gz", "truncated"): len(good), ("d.warc.gz", "no_record"): 0,
        ("d.warc.gz", "damaged"): 0, ("e.warc", "truncated"): len(good),
    }


def test_archives_are_bounded(spark):
    pages = spark.createDataFrame([(k, f"http://x/{k}", "y" * 5000 + str(k)) for k in range(60)], "page_id long, url string, html string").coalesce(1)
    path = new_path(spark, "test-warc")
    warc.write(pages, path, archive_bytes=60_000)
    assert len(spark.read.format("binaryFile").load(path).select("path").collect()) >= 5
    assert warc.page_captures(warc.assemble(warc.read(spark, path))).count() == 60


def test_a_read_error_in_mid_file_fails(spark, tmp_path):
    """A block that fails its checksum is no end of file."""
    data = "".join(record(b"response", b"%d" % k, b"HTTP/1.1 200 OK\r\n\r\n%d" % k).decode() for k in range(2000))
    spark.createDataFrame([(data,)], "value string").coalesce(1).write.text(f"file://{tmp_path}/a")
    (file,) = (tmp_path / "a").glob("part-*.txt")
    assert warc.read(spark, f"file://{file}").count() == 2000
    raw = bytearray(file.read_bytes())
    raw[len(raw) // 2] ^= 1
    file.write_bytes(raw)
    for how in ("fail", "reject"):
        with pytest.raises(Exception, match="(?i)checksum"):
            warc.read(spark, f"file://{file}", damaged=how).count()


def test_plain_archives_are_split_and_put_together(spark, tmp_path):
    blocks = [b"HTTP/1.1 200 OK\r\n\r\n" + b"line\r\n" * (k % 50) + b"%d" % k for k in range(3000)]
    (tmp_path / "a.warc").write_bytes(b"".join(record(b"response", b"%d" % k, b) for k, b in enumerate(blocks)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        rows = warc.read(spark, f"file://{tmp_path}")
        got = {r.record_id: bytes(r.payload) for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {str(k): b.partition(b"\r\n\r\n")[2] for k, b in enumerate(blocks)}


def shuffled_bytes(spark, path, pages):
    """Bytes that write() shuffles of `pages`, by Spark's own stages."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}

    seen = set(written())
    warc.write(pages, path)
    return sum(v for k, v in written().items() if k not in seen)


def test_only_responses_with_shared_payloads_are_shuffled_whole(spark):
    """Payloads of their own are written where they are read, revisits go without; before, each was shuffled."""
    text = [hashlib.sha512(b"%d" % k).hexdigest() * 200 for k in range(3)]
    rows = [(k, f"http://x/{k}", "".join(hashlib.sha512(b"%d %d" % (k, j)).hexdigest() for j in range(200))) for k in range(200)]
    rows += [(1000 + k, f"http://y/{k}", text[k % 3]) for k in range(300)] + [(2000, "u", "tiny"), (2000, "u", "tiny"), (2001, "u", "tiny")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = new_path(spark, "test-warc")
    assert shuffled_bytes(spark, path, pages) < 500_000 < sum(len(r[2]) for r in rows) / 20
    captures = warc.assemble(warc.read(spark, path))
    assert Counter(map(tuple, warc.page_captures(captures).collect())) == brute(rows)
    assert captures.select("capture_id").distinct().count() == len(rows)


def test_bits_pass_all_keys(spark):
    """Also negative keys and those on the edges of bytes and parts; keys that share a place with none are told apart."""
    edges = [(1 << 15) - 1, 1 << 15, (1 << BITMAP_BITS) - 1, -(1 << 63), (1 << 63) - 1]
    keys = [0, 7, 8, -1, *edges, *range(12345, 10**12, 10**10)]
    others = [k + 3 for k in keys if k + 3 < 1 << 63]
    parts = bitmap_parts(spark.createDataFrame([(k,) for k in keys], "key long"), "key")
    rows = spark.createDataFrame([(k,) for k in keys + others], "key long")
    got = {r.key: r.hit for r in with_bit(rows, parts, F.col("key"), "hit").collect()}
    places = {k % (1 << BITMAP_BITS) for k in keys}
    assert all(hit == (k % (1 << BITMAP_BITS) in places) for k, hit in got.items()) and not all(got.values())
    none = with_bit(spark.range(5), parts.limit(0), F.col("id"), "hit")
    assert [r.hit for r in none.collect()] == [False] * 5


def test_rows_that_a_bitmap_takes_for_shared_are_responses(spark, monkeypatch):
    """A payload of its own whose place is taken goes the other way with the same result, whether or not the second bitmap is right."""
    exact = warc.with_bit
    for names in (("shared",), ("shared", "whole")):
        def every(rows, parts, key, name, names=names):
            return rows.withColumn(name, F.lit(True)) if name in names else exact(rows, parts, key, name)

        monkeypatch.setattr(warc, "with_bit", every)
        path = new_path(spark, "test-warc")
        warc.write(spark.createDataFrame(edge_pages(), SCHEMA), path)
        captures = warc.assemble(warc.read(spark, path))
        assert Counter(map(tuple, warc.page_captures(captures).collect())) == brute(edge_pages())
        whole = captures.filter("response.type = 'response'").select("response.payload_bytes", F.octet_length("response.payload").alias("n")).collect()
        assert all(r.payload_bytes == r.n for r in whole)
