"""Streams over session logs: de-duplication, idle sessions, leased jobs, exactly-once review positions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle


def first_events(stream: DataFrame, key: list[str], time: str | None = None, delay: str | None = None) -> DataFrame:
    """The first event of each identity, however late it comes: the state holds every identity.

    With a time and a delay identities older than the delay are forgotten, and rows that are later than that are dropped.
    """
    if time is None or delay is None:
        return stream.dropDuplicates(key)
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def closed_sessions(stream: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """key, first_ts, last_ts, n of sessions that have been idle for ``gap``."""
    got = stream.withWatermark(time, delay).groupBy(key, F.session_window(time, gap)).agg(F.min(time).alias("first_ts"), F.max(time).alias("last_ts"), F.count("*").alias("n"))
    return got.select(key, "first_ts", "last_ts", "n")


class ConflictDetector(StatefulProcessor):
    """Per identity: the first digest is accepted, an equal one is a replay, another one a conflict."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "digest string")

    def handleInputRows(self, key, rows, timer):
        out = []
        for b in rows:
            for d in b["digest"]:
                if not self.first.exists():
                    self.first.update((d,))
                    out.append("accepted")
                else:
                    out.append("replay" if self.first.get()[0] == d else "conflict")
        yield pd.DataFrame({"key": [str(key[0])] * len(out), "outcome": out})

    def close(self) -> None:
        pass


def outcomes(stream: DataFrame, key: str) -> DataFrame:
    """key, outcome for each row of stream(key, digest): accepted, replay or conflict."""
    rows = stream.select(F.col(key).cast("string").alias("key"), "digest")
    return rows.groupBy("key").transformWithStateInPandas(ConflictDetector(), "key string, outcome string", "append", "none")


class LeaseKeeper(StatefulProcessor):
    """Per job: claim, extend, finish or fail, by owner and generation; a lease that ran out may be claimed anew.

    Input rows: path, op (claim, done, fail), owner, at (epoch seconds). A failure waits 3600 * 2**(n - 1)
    seconds, a day at most. Whoever doesn't hold the lease changes nothing.
    """

    lease, base, most = 3600, 3600, 86400

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", "state string, owner string, until bigint, attempts bigint, generation bigint")

    def handleInputRows(self, key, rows, timer):
        out = []
        for b in rows:
            for op, owner, at in b.sort_values(["at", "owner"])[["op", "owner", "at"]].itertuples(index=False):
                state, holder, until, attempts, generation = self.job.get() if self.job.exists() else ("eligible", None, 0, 0, 0)
                held, at = state == "leased" and at < until, int(at)
                if op == "claim" and not held and not (state in ("failed", "done") and (state == "done" or at < until)):
                    new = ("leased", owner, at + self.lease, attempts, generation + 1)
                elif op == "done" and held and holder == owner:
                    new = ("done", owner, at, attempts, generation)
                elif op == "fail" and held and holder == owner:
                    new = ("failed", owner, at + min(self.most, self.base * 2**attempts), attempts + 1, generation)
                else:
                    new = None
                if new:
                    self.job.update(new)
                out.append((str(key[0]), op, owner, new is not None, int((new or (0, 0, 0, 0, generation))[4])))
        yield pd.DataFrame(out, columns=["path", "op", "owner", "applied", "generation"])

    def close(self) -> None:
        pass


def leases(stream: DataFrame) -> DataFrame:
    return stream.groupBy("path").transformWithStateInPandas(LeaseKeeper(), "path string, op string, owner string, applied boolean, generation bigint", "append", "none")


def commit_batches(stream: DataFrame, positions_path: str, checkpoint: str, review) -> None:
    """Runs what is there to its end: each micro-batch is reviewed and its positions are added once.

    Rows of a batch are written under its number, so a batch that is run again after a crash replaces itself.
    """

    def each(batch: DataFrame, number: int) -> None:
        review(batch).write.mode("overwrite").parquet(f"{positions_path}/batch={number}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_positions(spark: SparkSession, positions_path: str) -> DataFrame:
    rows = spark.read.option("basePath", positions_path).parquet(positions_path)
    return rows.groupBy("path").agg(F.max_by("position", "batch").alias("position"), F.sum("n").alias("n"))
