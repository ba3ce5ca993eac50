"""Running sums and maxima within a key, byte ranges, and marks in them: no key has to fit one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key's rows are scanned by ranges of so many values of the order column.
CHUNK = 1 << 16


def running(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]], chunk: int = CHUNK, inclusive: bool = True) -> DataFrame:
    """rows and, for each name of ``values`` (how, column), the 'sum' or 'max' over the key's rows up to each one (or before it).

    order[0] is a whole number without nulls; rows that agree in all of ``order`` come in any order. A key is cut into ranges of ``chunk`` values
    of it: each range is scanned by itself, and what came before it is a scan over the ranges' totals, one row for each.
    A sum of nothing is 0, a maximum of nothing is null.
    """
    parts, how = {n: F.floor(F.col(order[0]) / chunk) for n in ("__part",)}, {"sum": F.sum, "max": F.max}
    names = list(values)
    cut = rows.withColumns(parts | {f"__{n}": c for n, (_, c) in values.items()})
    until = Window.currentRow if inclusive else -1
    inside = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, until)
    total = cut.groupBy(*keys, "__part").agg(*[how[values[n][0]](f"__{n}").alias(f"__{n}_all") for n in names])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = total.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), *[how[values[n][0]](f"__{n}_all").over(before).alias(f"__{n}_before") for n in names])
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("__part") == F.col("__p")]
    out = cut.select("*", *[how[values[n][0]](f"__{n}").over(inside).alias(f"__{n}_here") for n in names]).join(carry, on)
    put = {n: (F.coalesce(f"__{n}_before", F.lit(0)) + F.coalesce(f"__{n}_here", F.lit(0))) if values[n][0] == "sum" else F.greatest(f"__{n}_before", f"__{n}_here") for n in names}
    return out.select(*[c for c in rows.columns if c not in names], *[c.alias(n) for n, c in put.items()])


def covered_ranges(reads: DataFrame, keys: list[str], chunk: int = 1 << 24) -> DataFrame:
    """keys, start, end: the union of reads(keys, start, end) as disjoint ranges that don't touch each other. Empty reads cover nothing.

    A read begins a range of its own where all reads before it have ended before its start. Of reads with the same start only the longest
    counts, so no two rows of a key tie and both scans see them in one order.
    """
    once = reads.where("end > start").groupBy(*keys, "start").agg(F.max("end").alias("end"))
    rows = running(once, keys, ["start"], {"reach": ("max", F.col("end"))}, chunk, inclusive=False)
    rows = running(rows, keys, ["start"], {"island": ("sum", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0))}, chunk)
    return rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def uncovered_marks(marks: DataFrame, ranges: DataFrame, keys: list[str], chunk: int = 1 << 24) -> DataFrame:
    """The rows of marks(keys, start, end, ...) that lie in none of the disjoint ranges(keys, start, end); an empty mark needs none.

    Marks and ranges are scanned together by start: the range that a mark can lie in is the last one that starts before it ends.
    """
    names = [c for c in marks.columns if c not in (*keys, "start", "end")]
    both = marks.select(*keys, "start", "end", F.struct(*names).alias("__mark") if names else F.lit(1).alias("__mark"), F.lit(1).alias("__kind"))
    lines = ranges.select(*keys, "start", "end", F.lit(None).cast(both.schema["__mark"].dataType).alias("__mark"), F.lit(0).alias("__kind"))
    seen = running(lines.unionByName(both), keys, ["start", "__kind"], {"reach": ("max", F.when(F.col("__kind") == 0, F.col("end")))}, chunk)
    bad = seen.where((F.col("__kind") == 1) & (F.col("end") > F.col("start")) & (F.col("reach").isNull() | (F.col("end") > F.col("reach"))))
    return bad.select(*keys, "start", "end", *[F.col(f"__mark.{n}") for n in names])


def read_progress(reads: DataFrame, keys: list[str], totals: DataFrame) -> DataFrame:
    """keys, reached, complete: how far each text was read without a hole from its beginning, given totals(keys, total).

    A read counts only with the digest of the text that is frozen now, so ``keys`` should hold that digest.
    """
    first = covered_ranges(reads, keys).where("start = 0").select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "end")
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    reached = F.least(F.coalesce("end", F.lit(0)), F.col("total"))
    return totals.join(first, on, "left").select(*keys, reached.cast("bigint").alias("reached"), (reached >= F.col("total")).alias("complete"))


# What may become of an event in a review.
MARKS = ("processed", "excluded", "no-signal", "pending-review")


def mark_errors(marks: DataFrame, frozen: DataFrame, served: DataFrame, revisions: DataFrame) -> DataFrame:
    """key, status, reason of marks(key, status) that a review can't accept.

    frozen(key, revision): the events of a review, and the records it depends on with the revision they were frozen at (null for events);
    served(key): what was shown whole in this attempt; revisions(key, revision): what the records' revisions are now.
    """
    have = frozen.select("key", F.col("revision").alias("was"), F.lit(True).alias("known"))
    now = revisions.select("key", F.col("revision").alias("is"))
    rows = marks.join(have, "key", "left").join(now, "key", "left").join(served.select("key", F.lit(True).alias("shown")).distinct(), "key", "left")
    reason = (
        F.when(F.col("known").isNull(), "unknown_key").when(~F.coalesce(F.col("status").isin(*MARKS), F.lit(False)), "unknown_status")
        .when(F.col("was").isNotNull() & ~F.col("was").eqNullSafe(F.col("is")), "stale_dependency").when((F.col("status") != "pending-review") & F.col("shown").isNull(), "unserved_event")
    )
    return rows.select("key", "status", reason.alias("reason")).where("reason IS NOT NULL")


def admitted(items: DataFrame, group: list[str], order: list[str], budgets: dict[str, tuple[Column, int]], source: Column, sources: int) -> DataFrame:
    """items and ``reason``: null for those that a group's budgets admit, else the first of the budgets (or 'sources') that was used up.

    Items are taken in order (a whole number first) while each running total stays within its budget and no more than so many sources have come up; what comes
    after the first that misses isn't admitted. All totals are counted at once, in ranges, so no group has to fit one task.
    """
    names = list(budgets)
    rows = items.withColumn("__source", source)
    first = rows.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__source").alias("__s")).agg(F.min(F.struct(*order)).alias("__first"))
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    rows = rows.join(first, [*same, F.col("__source").eqNullSafe(F.col("__s"))]).withColumn("__new", F.struct(*order).eqNullSafe(F.col("__first")).cast("int"))
    totals = {f"__{n}_sum": ("sum", c) for n, (c, _) in budgets.items()} | {"__sources_sum": ("sum", F.col("__new"))}
    got = running(rows.select(*items.columns, "__new"), group, order, totals)
    limits = {n: most for n, (_, most) in budgets.items()} | {"sources": sources}
    over = F.coalesce(*[F.when(F.col(f"__{n}_sum") > most, F.lit(n)) for n, most in limits.items()])
    return got.select(*items.columns, over.alias("reason"))
