"""Lifecycle of records: what a record's status is, from everything that was ever written about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# From the most to the least trusted.
ASSURANCE_ORDER = ("dreaming-reviewed", "cross-session-reviewed", "self-reviewed", "candidate", "model-extracted")
STALE_DAYS, TASK_DAYS = 7, 14


def fold_journal(events: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """One row a key: the last non-null value of each field, the number of events, and the time of the last."""
    at = F.struct(*order)
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields]
    return events.groupBy(key).agg(*last, F.count("*").alias("n_events"), F.max(order[0]).alias("touched_at"))


def overlay(records: DataFrame, folded: DataFrame, key: str = "id") -> DataFrame:
    """Records with their folded journal; without one, nothing is retired."""
    out = records.join(folded, key, "left")
    return out.withColumn("retired", F.coalesce("retired", F.lit(False))) if "retired" in out.columns else out


def link_flags(records: DataFrame) -> DataFrame:
    """Adds is_superseded and is_withdrawn: whether any record supersedes or withdraws this one."""
    old = records.select(F.explode("supersedes").alias("id")).distinct().withColumn("is_superseded", F.lit(True))
    gone = records.where("withdraws IS NOT NULL").select(F.col("withdraws").alias("id")).distinct().withColumn("is_withdrawn", F.lit(True))
    out = records.join(old, "id", "left").join(gone, "id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_superseded", "is_withdrawn")})


def effective_status(as_of: Column) -> Column:
    """First match wins; needs withdraws, is_withdrawn, is_superseded, expires_at and status."""
    return (
        F.when(F.col("withdraws").isNotNull(), "withdrawal").when(F.col("is_withdrawn"), "withdrawn").when(F.col("is_superseded"), "superseded")
        .when(F.col("expires_at") <= as_of, "expired").otherwise(F.col("status"))
    )


def displayed_status(status: Column, as_of: Column, retired: Column | None = None, replaced: Column | None = None, touched: Column | None = None) -> Column:
    """The overlay on top: retired, then replaced by a narrative, then stale."""
    out = status
    if retired is not None:
        out = F.when((out == "active") & retired, "retired").otherwise(out)
    if replaced is not None:
        out = F.when((out == "active") & replaced, "superseded").otherwise(out)
    if touched is not None:
        out = F.when((out == "candidate") & (touched <= as_of - F.expr(f"INTERVAL {STALE_DAYS} DAYS")), "stale").otherwise(out)
    return out


def assurance(review_session: Column, own_session: Column, promotion_key: Column, extracted: Column) -> Column:
    reviewed = F.when(promotion_key.startswith("dream:"), "dreaming-reviewed").when(review_session == own_session, "self-reviewed").otherwise("cross-session-reviewed")
    return F.when(review_session.isNotNull(), reviewed).when(extracted, "model-extracted").otherwise("candidate")


def assurance_rank(value: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(a) for a in ASSURANCE_ORDER]), value)
    return F.when(place > 0, place - 1).otherwise(len(ASSURANCE_ORDER)).cast("int")


def chain_breaks(events: DataFrame, key: str, order: str, digest: Column, previous: str = "previous", start: str = "start") -> DataFrame:
    """Events whose ``previous`` isn't the digest of the event before them."""
    before = F.coalesce(F.lag(digest).over(Window.partitionBy(key).orderBy(order)), F.lit(start))
    return events.withColumn("expected", before).where(~F.col(previous).eqNullSafe(F.col("expected")))


def edge_violations(records: DataFrame, qualifier: list[str]) -> DataFrame:
    """(id, old, reason): supersession edges that don't lead to an active record of the same qualifier."""
    edges = records.select("id", F.struct(*qualifier).alias("q"), F.explode("supersedes").alias("old"))
    old = records.select(F.col("id").alias("old"), F.struct(*qualifier).alias("old_q"), F.col("status").alias("old_status"), F.lit(True).alias("there"))
    reason = F.when(F.col("there").isNull(), "missing").when(F.col("old_status") != "active", "not-active").when(~F.col("q").eqNullSafe(F.col("old_q")), "qualifier")
    return edges.join(old, "old", "left").select("id", "old", reason.alias("reason")).where("reason IS NOT NULL")


def many_successors(records: DataFrame) -> DataFrame:
    """(old, n): records that more than one other supersedes."""
    return records.select(F.explode("supersedes").alias("old")).groupBy("old").agg(F.count("*").alias("n")).where("n > 1")
