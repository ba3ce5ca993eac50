"""Preferences: claims with a journal of their own, and what of them applies to a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Which state may follow which.
LEGAL = (("start", "candidate"), ("candidate", "active"), ("active", "withdrawn"))


def fold(events: DataFrame, key: str = "record_id", order: str = "seq") -> DataFrame:
    """key, state, retired: the last state and the last retired flag of events(key, order, state, retired)."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    return events.groupBy(key).agg(last("state").alias("state"), F.coalesce(last("retired"), F.lit(False)).alias("retired"))


def illegal_transitions(events: DataFrame, key: str = "record_id", order: str = "seq") -> DataFrame:
    """key, order, before, state: events that set a state which may not follow the one before."""
    rows = events.where("state IS NOT NULL")
    before = F.coalesce(F.lag("state").over(Window.partitionBy(key).orderBy(order)), F.lit("start"))
    legal = F.concat_ws(">", "before", "state").isin(*[">".join(x) for x in LEGAL])
    return rows.withColumn("before", before).where(~legal).select(key, order, "before", "state")


def displayed(state: Column, retired: Column, superseded: Column) -> Column:
    return F.when(superseded, "superseded").when((state == "active") & retired, "retired").otherwise(state)


def applicable(preferences: DataFrame, mode: str | None, project: str | None = None, scenario: str | None = None) -> DataFrame:
    """Those of the task's mode, project and scenario; what names none of a kind applies to all of it."""
    fits = lambda c, v: (F.size(c) == 0) | F.array_contains(c, v)
    out = preferences.where("state = 'active'")
    for column, value in (("task_modes", mode), ("projects", project), ("scenarios", scenario)):
        if value is not None:
            out = out.where(fits(column, value))
    return out


def rendered() -> Column:
    """One claim as text; needs topic, text, conditions, exceptions and counterevidence."""
    more = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n{label}: "), F.array_join(c, "; "))).otherwise("")
    when = F.when(F.coalesce(F.col("conditions"), F.lit("")) != "", F.concat(F.lit("\nWhen: "), "conditions")).otherwise("")
    return F.concat(F.col("topic"), F.lit(": "), F.col("text"), when, more("Except", "exceptions"), more("Against", "counterevidence"))
