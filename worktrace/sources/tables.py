"""The relational load: four tables, parent first, all of a batch or nothing.

On files each run of a batch writes its rows under an attempt of its own and publishes
it by one small row when its last table is written; readers take the last published
attempt of each batch, so a run that fails midway shows nothing, removes what it wrote,
and a batch that runs again replaces itself. What a killed run or a replaced attempt
leaves goes with vacuum(). Over JDBC rows go to staging tables, and one transaction of
the database moves those of all four.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Order of the load: rows refer to those of tables before.
ORDER = ["video_metadata", "frame_features", "tacit_knowledge_insights", "behavioral_highlights"]
#: Columns by which a table's files are sorted within a video.
TIMES = ["frame_timestamp", "timestamp_sec", "step_number"]
PUBLISHED = "published_batches"
BATCH_ROWS = 500
FILE_ROWS = 2_000_000  # rows of a file at most
_KEYS = ["batch_id", "attempt"]
_KEY_TYPES = "batch_id VARCHAR(255), attempt VARCHAR(64)"  # text of no length can't be compared in some databases
_MARK = "batch_id string, attempt string, published_at timestamp"


def _mark(spark: SparkSession, batch_id: str, attempt: str) -> DataFrame:
    return spark.createDataFrame([(batch_id, attempt)], "batch_id string, attempt string").withColumn("published_at", F.current_timestamp())


def _last(marks: DataFrame) -> DataFrame:
    return marks.groupBy("batch_id").agg(F.max_by("attempt", F.struct("published_at", "attempt")).alias("attempt"))


def _files(spark: SparkSession, path: str):
    """Hadoop's path and file system of a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    where, fs = _files(spark, path)
    fs.delete(where, True)


def _order(rows: DataFrame) -> list[str]:
    return ["video_id", *[c for c in TIMES if c in rows.columns]]


def write_parquet(tables: Mapping[str, DataFrame], root: str, batch_id: str) -> str:
    """Write the tables of a batch below `root`, then publish them. Gives the attempt.

    Files hold ranges of video and time, so a long video spreads over many and short
    ones share. If a table fails, what the attempt wrote is removed.
    """
    attempt, spark = uuid.uuid4().hex, next(iter(tables.values())).sparkSession
    path = lambda name: f"{root}/{name}/batch_id={batch_id}/attempt={attempt}"
    try:
        for name in ORDER:
            if name in tables:
                order = _order(tables[name])
                rows = tables[name].repartitionByRange(*order).sortWithinPartitions(*order)
                rows.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path(name))
    except Exception:
        for name in ORDER:
            _remove(spark, path(name))
        raise
    _mark(spark, batch_id, attempt).coalesce(1).write.mode("append").parquet(f"{root}/{PUBLISHED}")
    return attempt


def read_parquet(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table's published rows, with batch_id and attempt as they were given: text, whatever it looks like."""
    marks = spark.read.schema(_MARK).parquet(f"{root}/{PUBLISHED}")
    found = spark.read.parquet(f"{root}/{name}").schema
    fields = [T.StructField(f.name, T.StringType() if f.name in _KEYS else f.dataType) for f in found.fields]
    rows = spark.read.schema(T.StructType(fields)).parquet(f"{root}/{name}")
    return rows.join(F.broadcast(_last(marks)) if marks.count() <= 100_000 else _last(marks), _KEYS, "left_semi")


def vacuum(spark: SparkSession, root: str, older_than_s: float = 24 * 3600) -> list[str]:
    """Remove attempts that no reader sees: unpublished ones, and published ones that a later one has replaced; but none younger than `older_than_s`.

    Gives their folders. A load that still runs is younger, or has to be.
    """
    marks = spark.read.schema(_MARK).parquet(f"{root}/{PUBLISHED}")
    live, gone = {(r["batch_id"], r["attempt"]) for r in _last(marks).collect()}, []  # one small row a batch
    for name in ORDER:
        where, fs = _files(spark, f"{root}/{name}/batch_id=*/attempt=*")
        for status in fs.globStatus(where) or []:
            path = status.getPath()
            key = tuple(p.getName().split("=", 1)[1] for p in (path.getParent(), path))
            if key not in live and status.getModificationTime() / 1000 <= time.time() - older_than_s:
                fs.delete(path, True)
                gone.append(path.toString())
    return gone


def _connection(spark: SparkSession, url: str, options: Mapping[str, str]):
    properties = spark._jvm.java.util.Properties()
    for k, v in options.items():
        properties.setProperty(k, v)
    return spark._jvm.java.sql.DriverManager.getConnection(url, properties)


def write_jdbc(tables: Mapping[str, DataFrame], url: str, batch_id: str, properties: Mapping[str, str] | None = None, partitions: int = 8) -> str:
    """The same over JDBC, in batches of BATCH_ROWS rows on at most `partitions` connections. Gives the attempt.

    Rows are written to staging tables of the attempt; one transaction then takes the
    batch's earlier rows out of all tables and puts the new ones in. Tables that are
    missing are created. If anything fails, the tables are as they were.
    """
    attempt, spark, options = uuid.uuid4().hex, next(iter(tables.values())).sparkSession, dict(properties or {})
    quote = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier
    stages: dict[str, list[str]] = {}
    connection = None
    try:
        for name in (n for n in ORDER if n in tables):
            rows = tables[name] if "created_at" in tables[name].columns else tables[name].withColumn("created_at", F.current_timestamp())
            rows = rows.withColumn("batch_id", F.lit(batch_id)).withColumn("attempt", F.lit(attempt))
            rows.limit(0).write.mode("append").option("createTableColumnTypes", _KEY_TYPES).jdbc(url, name, properties=options)
            stages[name] = rows.columns
            into = rows.coalesce(partitions).write.option("createTableColumnTypes", _KEY_TYPES).option("batchsize", BATCH_ROWS)
            into.jdbc(url, f"{name}_{attempt[:8]}", properties=options)
        connection = _connection(spark, url, options)
        connection.setAutoCommit(False)
        for name in reversed(stages):
            old = connection.prepareStatement(f"DELETE FROM {name} WHERE {quote('batch_id')} = ?")
            old.setString(1, batch_id)
            old.executeUpdate()
        for name, columns in stages.items():
            listed = ", ".join(map(quote, columns))
            connection.createStatement().executeUpdate(f"INSERT INTO {name} ({listed}) SELECT {listed} FROM {name}_{attempt[:8]}")
        connection.commit()
    except Exception:
        if connection is not None:
            connection.rollback()
        raise
    finally:
        connection = connection or _connection(spark, url, options)
        connection.setAutoCommit(True)
        found = connection.getMetaData().getTables(None, None, "%", None)
        there = set()
        while found.next():
            there.add(found.getString("TABLE_NAME"))
        for name in stages:
            for stage in there & {f"{name}_{attempt[:8]}", f"{name}_{attempt[:8]}".upper()}:
                connection.createStatement().executeUpdate(f"DROP TABLE {stage}")
        connection.close()
    return attempt


def read_jdbc(spark: SparkSession, url: str, name: str, properties: Mapping[str, str] | None = None) -> DataFrame:
    """A table's rows; only whole batches are ever there."""
    rows = spark.read.jdbc(url, name, properties=dict(properties or {}))
    return rows.toDF(*[c.lower() for c in rows.columns])
