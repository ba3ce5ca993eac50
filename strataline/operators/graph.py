"""Chains and closures by pointer doubling: a step halves what is left of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chain_roots(parents: DataFrame) -> DataFrame:
    """id, root, depth, status of parents(id, parent): where following parents ends.

    status: 'complete' (the last one has a null parent), 'broken' (a parent is missing) or 'cycle' (no end
    within as many steps as there are rows). A broken or cyclic chain selects nothing: its root is null. Each round joins
    only what is still open, and doubles how far it has looked.
    """
    now = parents.select("id", F.col("parent").alias("next"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), F.col("id").alias("last"))
    now = now.withColumn("last", F.coalesce("next", "id"))
    now = now.withColumns({"broken": F.lit(False), "open": F.col("next").isNotNull()})
    folder, k, n = parents.sparkSession.conf.get("spark.checkpoint.dir", None), 0, parents.count()
    while 1 << k <= 2 * n:  # no chain is longer than its table
        ahead = now.select(F.col("id").alias("a"), F.col("next").alias("b"), F.col("depth").alias("d"), F.col("last").alias("l"), F.lit(True).alias("there"))
        moved = now.where("open").join(ahead, F.col("next") == F.col("a"), "left").select(
            "id", F.when(F.col("there"), F.col("b")).otherwise(F.col("next")).alias("next"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"),
            F.coalesce("l", "last").alias("last"), (F.col("next").isNotNull() & F.col("there").isNull()).alias("broken"), (F.coalesce("there", F.lit(False)) & F.col("b").isNotNull()).alias("open"),
        )
        nxt = now.where("NOT open").unionByName(moved)
        nxt = nxt.checkpoint() if folder else nxt.cache()
        now, k = nxt, k + 1
        if not now.where("open").limit(1).count():
            break
    status = F.when(F.coalesce("open", F.lit(False)), "cycle").when(F.col("next").isNotNull(), "broken").otherwise("complete")
    return now.select("id", F.when(status == "complete", F.col("last")).alias("root"), "depth", status.alias("status"))


def related(records: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, id, direction: records one relation away from each seed, both ways, by two equi-joins."""
    edges = records.select(F.col("id").alias("src"), F.explode("relations").alias("r")).where(F.col("r.uri").startswith("record:"))
    edges = edges.select("src", F.substring("r.uri", 8, 1 << 20).alias("dst")).distinct()
    there = records.select("id")
    out = edges.join(seeds.select(F.col("id").alias("src")), "src").select(F.col("src").alias("seed"), F.col("dst").alias("id"), F.lit("out").alias("direction"))
    back = edges.join(seeds.select(F.col("id").alias("dst")), "dst").select(F.col("dst").alias("seed"), F.col("src").alias("id"), F.lit("in").alias("direction"))
    return out.join(there, "id").select("seed", "id", "direction").unionByName(back.select("seed", "id", "direction"))


def missing_related(records: DataFrame) -> DataFrame:
    """(id, missing): relations to records that aren't there."""
    edges = records.select("id", F.explode("relations").alias("r")).where(F.col("r.uri").startswith("record:")).select("id", F.substring("r.uri", 8, 1 << 20).alias("missing"))
    return edges.join(records.select(F.col("id").alias("missing")), "missing", "left_anti").select("id", "missing")


def kept(df: DataFrame) -> DataFrame:
    """Cuts the lineage where a shared folder is set, else keeps the rows in memory."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.cache()


def reachable(spark, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that edges(src, dst) lead to from roots(id), themselves included: breadth first until nothing is new."""
    seen = front = kept(roots.select("id").distinct())
    while True:
        new = kept(edges.join(front, edges.src == front.id).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"))
        if new.isEmpty():
            return seen
        seen, front = kept(seen.unionByName(new)), new


FOLDS = {"and": lambda x, y: x & y, "or": lambda x, y: x | y, "min": F.least, "max": F.greatest, "sum": lambda x, y: x + y}


def path_folds(nodes: DataFrame, folds: dict[str, tuple[str, str]] | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(paths, jumps) of nodes(id, parent, ...): what lies on the way from each node to its root.

    paths: id, root, depth, status ('complete', 'broken' or 'cycle', as in ``chain_roots``), and for each name of folds (how, column) the 'and',
    'or', 'min', 'max' or 'sum' of the column over the node and all its ancestors; null unless complete. jumps[k]: id and the ancestor 2**k steps up,
    where there is one. Each round doubles how far a node has looked and folds what the node it stands at has folded, so a path of any
    shape takes as many rounds as its length has bits.
    """
    folds = {"depth": ("sum", "__one"), **(folds or {})}
    n, k, jumps = nodes.count(), 0, []
    now = nodes.withColumn("__one", F.lit(1).cast("bigint")).select("id", F.col("parent").alias("next"), F.col("id").alias("last"), F.lit(False).alias("broken"), F.col("parent").isNotNull().alias("open"), *[F.col(c).alias(f) for f, (_, c) in folds.items()])
    now = kept(now)
    while now.where("open").limit(1).count():
        if 1 << k > 2 * n:
            break
        jumps.append(now.where("open").select("id", "next"))
        ahead = now.select(F.col("id").alias("a"), F.col("next").alias("b"), F.col("last").alias("l"), F.lit(True).alias("there"), *[F.col(f).alias(f"a_{f}") for f in folds])
        moved = now.where("open").join(ahead, F.col("next") == F.col("a"), "left").select(
            "id", F.when(F.col("there"), F.col("b")).otherwise(F.col("next")).alias("next"), F.coalesce("l", "last").alias("last"), F.col("there").isNull().alias("broken"),
            (F.coalesce("there", F.lit(False)) & F.col("b").isNotNull()).alias("open"), *[F.when(F.col("there"), FOLDS[how](F.col(f), F.col(f"a_{f}"))).otherwise(F.col(f)).alias(f) for f, (how, _) in folds.items()],
        )
        now, k = kept(now.where("NOT open").unionByName(moved)), k + 1
    status = F.when(F.col("open"), "cycle").when(F.col("broken") | F.col("next").isNotNull(), "broken").otherwise("complete")
    good = status == "complete"
    return now.select("id", F.when(good, F.col("last")).alias("root"), status.alias("status"), *[F.when(good, F.col(f) - 1 if f == "depth" else F.col(f)).alias(f) for f in folds]), jumps


def on_paths(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(leaf, id): the nodes on the way from each of leaves(id) to its root, both included.

    Jumps are taken from the longest to the shortest by all that is marked so far: every distance is a sum of different powers of two.
    """
    marked = kept(leaves.select(F.col("id").alias("leaf"), "id"))
    for jump in reversed(jumps):
        far = marked.join(jump.withColumnRenamed("id", "from"), F.col("id") == F.col("from")).select("leaf", F.col("next").alias("id"))
        marked = kept(marked.unionByName(far))
    return marked


def forks(nodes: DataFrame) -> DataFrame:
    """parent, n: nodes that several others of nodes(id, parent) follow."""
    return nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n")).where("n > 1")


def branches(events: DataFrame, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(selected, gaps): the branch that ends at each session's leaf.

    events(session, event_id, parent, recognized, ...); leaves(session, leaf, how) with how 'explicit', 'saved-resume' or 'default-leaf', and a null leaf where none is
    known. An id whose rows disagree in parent or in ``recognized`` is in conflict. A branch is whole or nothing: where an ancestor is missing, not recognized,
    in conflict, or met again, nothing of it is selected, since the part that isn't known could change it.
    selected: session, event_id, branch, branch_selection, assurance ('default-leaf' or null), at (steps below the root). gaps: session, reason.
    """
    name = lambda c: F.when(F.col(c).isNotNull(), F.struct("session", F.col(c).alias("event")))
    one = events.groupBy("session", "event_id").agg(F.first("parent").alias("parent"), (F.count_distinct(F.struct("parent", "recognized")) == 1).alias("alone"), F.bool_and(F.coalesce("recognized", F.lit(False))).alias("known"))
    nodes = kept(one.select(name("event_id").alias("id"), name("parent").alias("parent"), (F.col("alone") & F.col("known")).alias("ok")))
    paths, jumps = path_folds(nodes, {"ok": ("and", "ok")})
    want = leaves.select("session", F.col("leaf"), F.col("how"), name("leaf").alias("id"))
    found = want.join(paths.select("id", "status", "ok", "depth"), "id", "left")
    good = F.coalesce((F.col("status") == "complete") & F.col("ok"), F.lit(False))
    reason = F.when(F.col("leaf").isNull(), "saved_branch_unverified").when(F.col("how") == "default-leaf", "active_branch_unverified").otherwise("branch_ancestry_not_in_window")
    gaps = found.where(~good).select("session", reason.alias("reason"))
    whole = kept(found.where(good))
    marked = on_paths(whole.select("id"), jumps).join(whole.select(F.col("id").alias("leaf"), "how"), "leaf").join(paths.select("id", "depth"), "id")
    default = F.when(F.col("how") == "default-leaf", F.lit("default-leaf"))
    return marked.select("id.session", F.col("id.event").alias("event_id"), F.col("leaf.event").alias("branch"), F.col("how").alias("branch_selection"), default.alias("assurance"), F.col("depth").alias("at")), gaps
