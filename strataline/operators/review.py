"""Incremental review: positions over growing sources, changes between two looks, and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States in which a source needs no more review, and gaps that no retry can close.
DONE = ("reviewed", "no-change", "accepted-gap")
PERMANENT_GAPS = ("oversized_event", "malformed_event", "unknown_event_schema", "compaction_originals_not_proven", "sensitive_content_excluded")


def carry_positions(inventory: DataFrame, positions: DataFrame) -> DataFrame:
    """A new inventory (source_id, path, cutoff) with what was reviewed of it before; 0 for new sources."""
    old = positions.select("source_id", F.col("reviewed_offset").alias("old_offset"), F.col("status").alias("old_status"))
    out = inventory.join(old, "source_id", "left")
    offset = F.least(F.coalesce("old_offset", F.lit(0)).cast("bigint"), F.col("cutoff"))
    status = F.when(F.col("old_offset") > F.col("cutoff"), "source_changed").when(offset >= F.col("cutoff"), "reviewed").when(offset > 0, "incomplete").otherwise("new")
    return out.select(*inventory.columns, offset.alias("reviewed_offset"), status.alias("status"))


def commit_positions(positions: DataFrame, closed: DataFrame) -> DataFrame:
    """Advances a source only if all its events of the batch were reviewed and no gap is open.

    closed: source_id, end_offset, n_events, n_reviewed, n_open_gaps. Committing a batch twice changes nothing.
    """
    ok = (F.col("n_events") == F.col("n_reviewed")) & (F.col("n_open_gaps") == 0)
    moved = positions.join(closed, "source_id", "left")
    offset = F.when(ok, F.greatest("reviewed_offset", "end_offset")).otherwise(F.col("reviewed_offset"))
    status = F.when(offset >= F.col("cutoff"), "reviewed").when(F.col("n_open_gaps") > 0, "stalled").otherwise(F.col("status"))
    return moved.select(*[c for c in positions.columns if c not in ("reviewed_offset", "status")], offset.alias("reviewed_offset"), status.alias("status"))


def merge_positions(entries: DataFrame) -> DataFrame:
    """entries(source_id, ord, reviewed_offset, status) of several checkpoints to one, in their order.

    A later entry replaces what stands if its offset is smaller, or if what stands is done and it is not.
    This depends on the order, so it is a fold over the sorted entries of a source and not a minimum.
    """
    sorted_ = F.array_sort(F.collect_list(F.struct("ord", "reviewed_offset", "status")))
    done = ", ".join(f"'{d}'" for d in DONE)
    fold = F.expr(f"""aggregate(slice(e, 2, size(e)), e[0], (mine, x) ->
        CASE WHEN x.reviewed_offset < mine.reviewed_offset OR (mine.status IN ({done}) AND x.status NOT IN ({done})) THEN x ELSE mine END)""")
    return entries.groupBy("source_id").agg(sorted_.alias("e")).select("source_id", fold.alias("m")).select("source_id", "m.reviewed_offset", "m.status")


def changes(before: DataFrame, now: DataFrame, key: str = "source_id") -> DataFrame:
    """key, change: what became of each source between two looks (size, prefix_digest, digest)."""
    a = before.select(key, F.col("size").alias("size0"), F.col("digest").alias("digest0"))
    b = now.select(key, "size", "digest", "prefix_digest")
    change = (
        F.when(F.col("digest0").isNull(), "added").when(F.col("digest").isNull(), "unavailable").when(F.col("digest") == F.col("digest0"), "unchanged")
        .when((F.col("size") > F.col("size0")) & (F.col("prefix_digest") == F.col("digest0")), "appended").otherwise("modified")
    )
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def rollup(positions: DataFrame) -> DataFrame:
    """One row: sources by state, and bytes reviewed of all."""
    return positions.agg(
        F.count("*").alias("n_sources"), F.count_if(F.col("status").isin(*DONE)).alias("n_done"), F.count_if(F.col("status") == "stalled").alias("n_stalled"),
        F.coalesce(F.sum("reviewed_offset"), F.lit(0)).alias("bytes_reviewed"), F.coalesce(F.sum("cutoff"), F.lit(0)).alias("bytes_total"),
        F.coalesce(F.bool_and(F.col("status").isin(*DONE)), F.lit(True)).alias("complete"),
    )


def gap_class(reason: Column) -> Column:
    return F.when(reason.isin(*PERMANENT_GAPS), "permanent").otherwise("transient")


def duplicate_titles(records: DataFrame) -> DataFrame:
    """norm_title, n, ids: titles that several records share, but for case and spaces."""
    norm = F.trim(F.regexp_replace(F.replace(F.lower(F.col("title")), F.lit("ß"), F.lit("ss")), r"\s+", " "))
    return records.groupBy(norm.alias("norm_title")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids")).where("n > 1")


def inventory(sections: list[DataFrame], limit: int) -> tuple[DataFrame, DataFrame]:
    """Sections (ref, reason, sort_key) one after the other: the first ``limit`` rows, and a count of the rest."""
    from functools import reduce

    rows = reduce(DataFrame.unionByName, [s.select("ref", "reason", "sort_key").withColumn("section", F.lit(i)) for i, s in enumerate(sections)])
    top = rows.orderBy("section", "sort_key", "ref").limit(limit)
    return top, rows.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("omitted"))


def missing_sources(records: DataFrame, files: DataFrame) -> DataFrame:
    """(id, uri): file sources of records that files(uri) doesn't list."""
    uris = records.select("id", F.explode("sources").alias("s")).select("id", "s.uri").where(F.col("uri").startswith("file:"))
    return uris.join(files.select("uri").distinct(), "uri", "left_anti").select("id", "uri")
