"""WARC archives: writing page captures, and assembling transactions from archives.

Archives are written by Spark's text writer, one record per row with the record
separator as line end, so they can go to any store that Spark writes to. Spark's text
reader also streams them back, by the lines of their headers; records are put
together by Content-Length one at a time, and request, response and metadata records
are joined through their WARC-Concurrent-To identifiers.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worktrace.llm.common import bitmap_parts, materialise, quoted, salt_count, with_bit

MIN_REVISIT_BYTES = 100
_END = "\r\n"
_BATCH_BYTES = 8 << 20
ARCHIVE_BYTES = 1 << 30  # of payload in an archive, about
_SCHEMA = (
    "file string, offset long, error string, type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, date string, "
    "content_type string, block_fields map<string,string>, payload binary, payload_bytes long, payload_digest string"
)


def _uuid(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def _record_id(page_id: Column, url: Column, digest: Column, copy: Column) -> Column:
    return _uuid(F.coalesce(page_id.cast("string"), F.lit("null")), F.coalesce(url, F.lit("")), digest, copy.cast("string"))


def _record(kind: str, record_id: Column, date: str, content_type: str, block: Column, **more: Column) -> Column:
    """A record as text; headers whose value is null are left out."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_END)), F.lit(""))
    head = [
        F.lit(f"WARC/1.1{_END}WARC-Type: {kind}{_END}"), line("WARC-Record-ID", F.concat(F.lit("<"), record_id, F.lit(">"))),
        F.lit(f"WARC-Date: {date}{_END}"),
    ]
    head += [line("WARC-" + name.replace("_", "-"), value) for name, value in more.items()]
    return F.concat(
        *head, F.lit(f"Content-Type: {content_type}{_END}"), line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_END), block,
    )


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z",
          archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a response (or revisit), a request and a metadata record per row of `pages`.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of at least
    MIN_REVISIT_BYTES that with the smallest id is a response (all rows with that
    id), others revisit it; smaller ones are responses. Rows without id never are
    the one revisited, unless none has an id: then all are responses. Rows equal
    in id, url and html are captures of their own. Control characters and spaces
    in a URL are percent-encoded, since it stands in headers. An empty table
    writes an archive without records. An archive holds about `archive_bytes` of
    payload at most, by the mean size of payloads. Rows whose payload no other
    row has are written where they are read; the others, and those few that a
    bitmap of digests doesn't tell from them, meet in a shuffle. There a second
    bitmap, which passes every response and few revisits, leaves payloads out.
    """
    salts = salt_count(pages.sparkSession)
    url = F.regexp_replace(quoted(url_col), r"[\x00-\x20\x7F]", "%20")
    html = F.coalesce(quoted(html_col), F.lit(""))
    rows = pages.select(
        quoted(id_col).cast("long").alias("id"), url.alias("url"), html.alias("payload"), F.sha2(html, 256).alias("digest"),
        F.octet_length(html).alias("size"),
    )
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int"))
    large = F.col("size") >= MIN_REVISIT_BYTES
    known = F.when(F.col("id").isNotNull(), F.struct("id", "url"))
    sums = [F.sum("n").alias("n"), F.sum("bytes").alias("bytes")]
    salted = rows.groupBy("digest", "salt").agg(F.min(F.when(large, known)).alias("first"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    groups = salted.groupBy("digest").agg(F.min("first").alias("first"), F.collect_set("salt").alias("salts"), *sums)
    groups = materialise(groups, "warc-firsts")
    key, answer = F.xxhash64("digest"), lambda i: F.xxhash64("digest", F.coalesce(F.col(i), F.lit(0)))
    shared = materialise(bitmap_parts(groups.filter("n > 1").select(key.alias("key")), "key"), "warc-shared")
    firsts = with_bit(groups, shared, key, "shared").filter("shared")
    answers = materialise(bitmap_parts(firsts.select(answer("first.id").alias("key")), "key"), "warc-answers")
    marked = with_bit(rows, shared, key, "shared")
    both = with_bit(marked.filter("shared"), answers, answer("id"), "whole")
    both = both.withColumn("payload", F.when(F.col("whole") | ~large, F.col("payload"))).drop("whole")
    both = both.join(firsts.select("digest", "first", F.explode("salts").alias("salt")), ["digest", "salt"], "left")
    copy = F.row_number().over(Window.partitionBy("digest", "salt", "id", "url").orderBy("size"))
    both = both.withColumn("copy", copy).unionByName(
        marked.filter(~F.col("shared")).withColumns({"first": F.lit(None).cast(firsts.schema["first"].dataType), "copy": F.lit(1)})
    )
    both = both.withColumn("me", _record_id(F.col("id"), F.col("url"), F.col("digest"), F.col("copy")))
    revisit = large & F.col("first").isNotNull() & ~F.coalesce(F.col("id") == F.col("first.id"), F.lit(False))
    target = _record_id(F.col("first.id"), F.col("first.url"), F.col("digest"), F.lit(1))
    me, uri, named = F.col("me"), F.col("url"), F.concat(F.lit("sha256:"), F.col("digest"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("size").cast("string"),
        F.lit(_END + _END),
    )
    response = _record(
        "response", me, date, "application/http; msgtype=response", F.concat(http, F.col("payload")), Target_URI=uri,
        Payload_Digest=named,
    )
    again = _record(
        "revisit", me, date, "application/http; msgtype=response", http, Target_URI=uri, Payload_Digest=named,
        Profile=F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        Refers_To=F.concat(F.lit("<"), target, F.lit(">")), Refers_To_Target_URI=F.col("first.url"),
    )
    get = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{_END}{_END}"))
    concurrent = F.concat(F.lit("<"), me, F.lit(">"))
    request = _record(
        "request", _uuid(me, F.lit("request")), date, "application/http; msgtype=request", get, Target_URI=uri,
        Concurrent_To=concurrent,
    )
    fields = F.concat(F.coalesce(F.concat(F.lit("pageId: "), F.col("id").cast("string"), F.lit(_END)), F.lit("")), F.lit("charset: utf-8" + _END))
    metadata = _record("metadata", _uuid(me, F.lit("metadata")), date, "application/warc-fields", fields, Target_URI=uri, Concurrent_To=concurrent)
    records = both.select(F.explode(F.array(F.when(revisit, again).otherwise(response), request, metadata)).alias("value"))
    total = groups.agg(*sums).first()
    most = max(3, int(3 * archive_bytes / ((total["bytes"] or 0) / (total["n"] or 1) + 1000)))
    records.write.option("lineSep", _END + _END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def parse(lines: Iterable[bytes]) -> Iterator[tuple[int, str | None, dict[str, list[str]], bytes]]:
    """(offset, error, headers, block) of each record of an archive, from its pieces between line ends (CR LF).

    Header names are in lower case. error is null, or says why a record can't be
    used: no_content_length (none, or no number), truncated (the archive ends
    before it does). After such a record the next line that begins like a record
    is taken up again.
    """
    at, begin, lines = 0, 0, iter(lines)
    headers: dict[str, list[str]] | None = None
    for line in lines:
        here, at = at, at + len(line) + 2
        if headers is None:
            if line.startswith(b"WARC/"):
                begin, headers = here, {}
        elif line:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        else:
            size = headers.get("content-length", [""])[0]
            if not (size.isascii() and size.isdigit()):
                yield begin, "no_content_length", headers, b""
                headers = None
                continue
            parts, left = [], int(size)
            while left > 0 or not parts and int(size):
                piece = next(lines, None)
                if piece is None:
                    break
                at += len(piece) + 2
                left -= len(piece) + 2 * bool(parts)
                parts.append(piece)
            if left > 0:
                break
            block = _END.encode().join(parts)[: int(size)]
            yield begin, None, headers, block
            headers = None
    if headers is not None:
        yield begin, "truncated", headers, b""


def _row(headers: dict[str, list[str]], block: bytes) -> tuple:
    one = lambda name: headers.get(name, [None])[0]
    bare = lambda v: v.strip("<>") if v else None
    kind, content, fields, payload = one("warc-type"), one("content-type") or "", {}, None
    if content.startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        text = head.decode("utf-8", "replace").split(_END)[1:]
    else:
        text = block.decode("utf-8", "replace").split(_END) if content == "application/warc-fields" else []
    for line in text:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip()] = value.strip()
    whole = payload if kind == "response" else None
    return (
        kind, bare(one("warc-record-id")), [bare(v) for v in headers.get("warc-concurrent-to", [])], bare(one("warc-refers-to")),
        one("warc-target-uri"), one("warc-date"),
        content, fields, whole, None if whole is None else len(whole), None if whole is None else hashlib.sha256(whole).hexdigest(),
    )


_KINDS = [
    pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(),
    pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.int64(), pa.string(),
]
_NAMES = [f.split()[0] for f in _SCHEMA.replace("map<string,string>", "map").split(", ")]


def _batches(records: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Records (file, offset, error, headers, block) as batches of _SCHEMA of some megabytes."""

    def out() -> pa.RecordBatch:
        columns = [[list(v.items()) if isinstance(v, dict) else v for v in c] for c in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)

    rows, size = [], 0
    for file, offset, error, headers, block in records:
        rows.append((file, offset, error, *_row(headers, block)))
        size += len(block)
        if size > _BATCH_BYTES or len(rows) >= 1000:
            yield out()
            rows, size = [], 0
    if rows:
        yield out()


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, hash of the file's name, name in lines that may begin a record) in order -> records."""
    lines = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))

    def records() -> Iterator[tuple]:
        for _, own in groupby(lines, key=itemgetter(1)):
            name: list[str] = []

            def bare(rows: Iterator[tuple], name: list[str] = name) -> Iterator[bytes]:
                for line, _, file in rows:
                    if file is not None and not name:
                        name.append(file)
                    yield line

            for record in parse(bare(own)):
                yield (name[0] if name else None, *record)

    return _batches(records())


def _lines(content: memoryview) -> Iterator[bytes]:
    """The lines of a gzip file as far as it unpacks; only damage to its data ends it early."""
    at, rest, end = 0, b"", _END.encode()
    while at < len(content):
        member = zlib.decompressobj(wbits=31)
        try:
            while at < len(content) and not member.eof:
                some = content[at : at + (1 << 20)]
                *lines, rest = (rest + member.decompress(some)).split(end)
                at += len(some) - len(member.unused_data)
                yield from lines
        except zlib.error:
            break
    if rest:
        yield rest


def _salvaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(content, name) of damaged gzip files -> records."""
    return _batches(
        (f.as_py(), *record) for batch in batches for content,
        f in zip(batch.column(0), batch.column(1), strict=True) for record in parse(_lines(memoryview(content.as_buffer())))
    )


def _text(spark: SparkSession, pattern: str, path: str | list[str]) -> DataFrame:
    """Lines as bytes with a hash of their file's name, and the name where a record may begin; in order in their partition. A read that fails fails the job."""
    file = F.col("_metadata.file_path")
    rows = spark.read.option("pathGlobFilter", pattern).option("lineSep", _END).option("ignoreCorruptFiles", False).text(path)
    return rows.select(
        F.col("value").cast("binary").alias("value"), F.xxhash64(file).alias("f"), F.when(F.col("value").startswith("WARC/"), file).alias("file"),
        F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"),
    )


def _gzipped(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).filter("length > 0").select("content", "path")


def parsed(spark: SparkSession, path: str, damaged: str = "fail") -> DataFrame:
    """All records of the archives at `path`, those that can't be used with an error, by file and offset (of the text that was compressed).

    Archives whose names end in .gz are read as they come; others, whose names must not
    end in z, may be split between tasks, so their lines are sorted by file and place.
    Either way a record is the most that a task holds. Reads that fail, of damaged gzip
    files too, fail the job. With damaged="reject" gzip files are unpacked once before,
    and those that don't unpack give the records before the damage; see rejected().
    """
    columns, path_gz = ["value", "f", "file"], path
    out = _text(spark, "*[^z]", path).repartition("f").sortWithinPartitions("f", "b", "n").select(*columns).mapInArrow(_streamed, _SCHEMA)
    if damaged == "reject":
        bad = {r["file"] for r in _gzipped(spark, path).mapInArrow(_damage, _DAMAGE).select("file").collect()}  # names of files
        every = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).filter("length > 0").select("path")
        path_gz = [r["path"] for r in every.collect() if r["path"] not in bad]
        if bad:
            some = spark.read.format("binaryFile").load(sorted(bad)).select("content", "path")
            out = out.unionByName(some.mapInArrow(_salvaged, _SCHEMA))
    return out.unionByName(_text(spark, "*.gz", path_gz).select(*columns).mapInArrow(_streamed, _SCHEMA)) if path_gz else out


def read(spark: SparkSession, path: str, damaged: str = "fail") -> DataFrame:
    """The records of all archives at `path` that can be used; see parsed()."""
    return parsed(spark, path, damaged).filter("error is null").drop("file", "offset", "error")


_DAMAGE = "file string, offset long, error string"


def _damage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(content, name) of gzip files -> (file, offset, error) of those that don't unpack to their end."""
    for batch in batches:
        for content, file in zip(batch.column(0), batch.column(1), strict=True):
            data, at, whole, offset = memoryview(content.as_buffer()), 0, True, 0
            while at < len(data):
                member = zlib.decompressobj(wbits=31)
                try:
                    while at < len(data) and not member.eof:
                        some = data[at : at + (1 << 20)]
                        offset += len(member.decompress(some))
                        at += len(some) - len(member.unused_data)
                except zlib.error:
                    break
                whole = member.eof
            if at < len(data) or not whole:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file.as_py()]), pa.array([offset]), pa.array(["damaged"])], names=["file", "offset", "error"],
                )


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, error of what read() leaves out.

    Errors: no_content_length (none, or no number), truncated (the archive ends
    before the record does), damaged (a gzip file that unpacks up to the offset
    only; read(damaged="reject") has its records up to there), no_record (an archive
    that is not empty, but without any).
    """
    rows = materialise(parsed(spark, path, "reject").select("file", "offset", "error"), "warc-rejected")
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select(F.col("path").alias("file"))
    none = files.join(rows.select("file").distinct(), "file", "left_anti").select(
        "file", F.lit(0).cast("long").alias("offset"), F.lit("no_record").alias("error"),
    )
    return rows.filter("error is not null").unionByName(none).unionByName(_gzipped(spark, path).mapInArrow(_damage, _DAMAGE))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, target_uri, date, response, requests, metadata.

    A capture is a response or revisit record. Requests and metadata belong to the
    capture that they name in WARC-Concurrent-To or that names them; metadata may
    name the request instead. Records with no capture in reach are left out; a
    capture without requests or metadata has empty lists. Records that repeat an
    id each count; null ids join nothing. No records: no rows. The records are
    written to the shared folder first, so that archives are parsed once; a query
    that takes no payloads from the rows doesn't read them there.
    """
    records = materialise(records, "warc-records", "zstd")
    captures, slim = records.filter("type in ('response', 'revisit')"), records.drop("payload")
    side = slim.filter("type in ('request', 'metadata')").select("type", "record_id", "target_uri", "block_fields", "concurrent_to")
    named = side.select("record_id", F.explode("concurrent_to").alias("other"))
    naming = slim.filter("type in ('response', 'revisit')").select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("other"))
    links = named.unionByName(naming).distinct()
    via = links.select(F.col("record_id").alias("other"), F.col("other").alias("further"))
    reach = links.unionByName(links.join(via, "other").select("record_id", F.col("further").alias("other"))).distinct()
    parts = side.drop("concurrent_to").join(reach, "record_id").groupBy("other").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("record_id", "target_uri", F.map_entries("block_fields").alias("fields"))))).alias(name) for kind, name in (("request", "requests"), ("metadata", "metadata"))]
    )
    names = ["type", "refers_to", "content_type", "block_fields", "payload", "payload_bytes", "payload_digest"]
    response = F.struct(*names)
    rows = captures.select(F.col("record_id").alias("capture_id"), "target_uri", "date", response.alias("response"))
    none = F.array().cast("array<struct<record_id:string,target_uri:string,fields:array<struct<key:string,value:string>>>>")
    joined = rows.join(parts, rows["capture_id"] == parts["other"], "left").drop("other")
    return joined.withColumns({c: F.coalesce(c, none) for c in ("requests", "metadata")})


def field(records: Column, name: str) -> Column:
    """The first value of a field in a capture's requests or metadata; null if there is none."""
    entries = F.flatten(F.transform(records, lambda r: r["fields"]))
    return F.get(F.filter(entries, lambda e: e["key"] == F.lit(name)), F.lit(0))["value"]


def page_captures(captures: DataFrame) -> DataFrame:
    """Per capture of write()'s archives: page_id, payload_bytes, payload_digest, record_type, refers_to (page_id).

    A revisit has the payload of the response that it refers to; one that refers
    to no response here has null there. Revisits of one response meet it in as many
    places as they have salts.
    """
    slim = captures.select(
        "capture_id", field(F.col("metadata"), "pageId").cast("long").alias("page_id"), F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("refers"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
    )
    salt = F.pmod(F.xxhash64("capture_id"), F.lit(salt_count(captures.sparkSession))).cast("int")
    slim = materialise(slim.withColumn("salt", salt), "warc-captures")
    revisits = slim.filter("record_type = 'revisit'")
    origin = slim.filter("record_type = 'response'").select(
        F.col("capture_id").alias("refers"), F.col("page_id").alias("of"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d")
    )
    needed = materialise(revisits.select("refers", "salt").distinct().join(origin, "refers"), "warc-origins")
    joined = revisits.join(needed, ["refers", "salt"], "left")
    again = joined.select(
        "page_id", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type",
        F.col("of").alias("refers_to"),
    )
    own = slim.filter("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"),
    )
    return own.unionByName(again)
