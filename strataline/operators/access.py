"""Who sees what: scopes, roots, sharing between projects, routing of queries, prohibited sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized, source_key, tokens


def visible(project: str, worktree: str | None, task: str | None) -> Column:
    """Same project, and: project scope, or the same worktree and worktree scope, or the same task too."""
    tree = F.col("worktree_id").eqNullSafe(F.lit(worktree))
    own = F.col("task_id").eqNullSafe(F.lit(task))
    return (F.col("project_id") == project) & ((F.col("scope") == "project") | (tree & ((F.col("scope") == "worktree") | own)))


def resolve_roots(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path, project_id, root, ambiguous: the longest registered root that contains each path.

    A path meets its own ancestors by an equi-join, one row a directory level, so no pair of paths and roots
    is tried in vain. Roots of equal depth in several projects are ambiguous; without a root, project is null.
    """
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    up = paths.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))).alias("root"))
    known = roots.select(F.when(F.length("root") > 1, F.rtrim(F.col("root"), F.lit("/"))).otherwise(F.col("root")).alias("root"), F.col("id").alias("project_id")).distinct()
    best = up.join(known, "root").groupBy("path", F.length("root").alias("depth")).agg(F.min("project_id").alias("project_id"), F.countDistinct("project_id").alias("n"), F.min("root").alias("root"))
    best = best.groupBy("path").agg(F.max_by(F.struct("project_id", "root", (F.col("n") > 1).alias("ambiguous")), "depth").alias("b"))
    out = paths.select("path").distinct().join(best, "path", "left").select("path", "b.project_id", "b.root", F.coalesce("b.ambiguous", F.lit(False)).alias("ambiguous"))
    return out.withColumn("project_id", F.when(~F.col("ambiguous"), F.col("project_id")))


def with_imports(records: DataFrame, share_edges: DataFrame, project: str) -> DataFrame:
    """The project's own records and those that others share with it: both sides must have opted in."""
    own = records.where(F.col("project_id") == project).withColumn("imported", F.lit(False))
    domain = F.col("domain")
    into = share_edges.where(F.col("to") == project).groupBy(F.col("from").alias("project_id")).agg(F.bool_or(domain.isNull()).alias("__all"), F.collect_set("domain").alias("__domains"))
    other = records.where((F.col("project_id") != project) & F.array_contains("share_with", project)).join(into, "project_id")  # a row a project: no record comes twice
    other = other.where(F.col("__all") | F.array_contains("__domains", domain))
    return own.unionByName(other.select(*records.columns).withColumn("imported", F.lit(True)))


def route_matches(queries: DataFrame, topics: DataFrame) -> DataFrame:
    """query_id, topic_id, expansion: the topics that a query names, and the search terms they add.

    An alias matches if it equals the query, if it holds CJK and lies within the query, or if all its terms
    are in the query. Topics are configuration (64 at most), hence the broadcast.
    """
    q = queries.select("query_id", normalized(F.col("query")).alias("q"), F.array_distinct(tokens(F.col("query"))).alias("terms")).where("q <> ''")
    names = topics.select("topic_id", "search_terms", F.explode(F.concat(F.array("topic_id", "title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    names = names.select("topic_id", "search_terms", normalized(F.col("alias")).alias("a"), F.array_distinct(tokens(F.col("alias"))).alias("aterms"))
    hit = (F.col("a") == F.col("q")) | (F.col("a").rlike(r"[\x{3400}-\x{9fff}]") & (F.instr(F.col("q"), F.col("a")) > 0)) | ((F.size("aterms") > 0) & (F.size(F.array_except("aterms", "terms")) == 0))
    got = q.join(F.broadcast(names), hit).select("query_id", "topic_id", "terms", "search_terms").distinct()
    more = F.flatten(F.transform(F.coalesce("search_terms", F.array().cast("array<string>")), lambda s: tokens(s)))
    return got.select("query_id", "topic_id", F.array_sort(F.array_except(more, "terms")).alias("expansion"))


def usable(records: DataFrame, dispositions: DataFrame) -> DataFrame:
    """records none of whose sources a disposition prohibits, for all titles or for theirs."""
    bad = dispositions.select(F.explode("source_keys").alias("key"), "topic").distinct()
    held = records.select("id", "title", F.explode("sources").alias("s")).select("id", "title", source_key(F.col("s.uri")).alias("key"))
    out = held.join(bad, "key").where((F.col("topic") == "*") | (F.col("topic") == F.col("title"))).select("id").distinct()
    return records.join(out, "id", "left_anti")


def read_by_ids(records: DataFrame, ids: DataFrame) -> DataFrame:
    """ids(ordinal, id) in the order of the request, with their records; found is false for missing ones."""
    return ids.join(records.withColumn("found", F.lit(True)), "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def ambiguous_ids(records: DataFrame) -> DataFrame:
    return records.groupBy("id").agg(F.countDistinct("project_id").alias("n")).where("n > 1")
