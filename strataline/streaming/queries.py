"""Streams run to their end over the ``events`` table, as queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import streams


def _shared(spark: SparkSession, name: str) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="strataline-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A stream reads folders; the glob gives it one file or all the parts of a table.
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a time zone


def _run(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    out, state = _shared(spark, name), _shared(spark, f"{name}-state")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def dedupe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once, by identity."""
    return _run(streams.first_events(_events(spark, sf_dir), ["event_id"]).select("event_id", "user_id"), spark, "dedupe")


def tail_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of an incremental review: rows and last event of each kind, committed batch by batch."""
    positions, state = _shared(spark, "positions"), _shared(spark, "positions-state")
    review = lambda b: b.groupBy(F.col("event_type").alias("path")).agg(F.max("event_id").alias("position"), F.count("*").alias("n"))
    streams.commit_batches(_events(spark, sf_dir), positions, state, review)
    return streams.latest_positions(spark, positions)


QUERIES = {"dedupe_stream": dedupe_stream, "tail_stream": tail_stream}
ORACLE_SQL = {
    "dedupe_stream": "SELECT DISTINCT event_id, user_id FROM events",
    "tail_stream": "SELECT event_type AS path, max(event_id) AS position, count(*) AS n FROM events GROUP BY 1",
}
