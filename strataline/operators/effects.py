"""Effects in two phases: intents with the digests before and after, then writes, then receipts; and what a retry has to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import kept

#: A path that isn't there has this digest.
ABSENT = "absent"


def effect_states(intents: DataFrame, current: DataFrame, receipts: DataFrame) -> DataFrame:
    """effect, state, to_write, blocked_by of intents(effect, path, before, after), given current(path, digest) and receipts(effect).

    A path that has its ``after`` is written; one that still has its ``before`` is open; any other is a change from outside. state: 'received' (nothing to do),
    'blocked' (a change from outside: nothing of the effect is written over it; blocked_by is the least such path), 'written' (only the receipt is missing),
    'partial' or 'intended' (to_write paths are open). A run that breaks off anywhere leaves one of these states, and a retry that writes the open paths
    and then the receipt ends in one effect.
    """
    now = intents.join(current.select(F.col("path").alias("p"), "digest"), F.col("path") == F.col("p"), "left").withColumn("digest", F.coalesce("digest", F.lit(ABSENT)))
    write = F.when(F.col("digest") == F.col("after"), "written").when(F.col("digest") == F.coalesce("before", F.lit(ABSENT)), "open").otherwise("blocked")
    n = lambda s: F.count_if(F.col("w") == s)
    each = now.withColumn("w", write).groupBy("effect").agg(n("open").alias("to_write"), n("written").alias("done"), F.min(F.when(F.col("w") == "blocked", F.col("path"))).alias("blocked_by"))
    got = each.join(receipts.select(F.col("effect").alias("e"), F.lit(True).alias("received")).distinct(), F.col("effect") == F.col("e"), "left")
    state = (
        F.when(F.col("received"), "received").when(F.col("blocked_by").isNotNull(), "blocked").when(F.col("to_write") == 0, "written")
        .when(F.col("done") > 0, "partial").otherwise("intended")
    )
    settled = F.col("received").isNotNull()
    return got.select("effect", state.alias("state"), F.when(settled, 0).otherwise(F.col("to_write")).cast("bigint").alias("to_write"), F.when(~settled, F.col("blocked_by")).alias("blocked_by"))


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, layer of nodes(id), given edges(src, dst): src needs dst first. A node's layer is 0 if it needs none, else one above the highest that it needs.

    It is null for nodes on a cycle, nodes that need an id that isn't there, and all that rest on such ones. Each round takes off what needs nothing that is left.
    """
    left = kept(nodes.select("id").distinct())
    needs = kept(edges.select("src", "dst").distinct())
    out, layer = None, 0
    while True:
        ready = kept(left.join(needs.select(F.col("src").alias("id")).distinct(), "id", "left_anti"))
        if ready.isEmpty():
            rest = left.select("id", F.lit(None).cast("int").alias("layer"))
            return rest if out is None else out.unionByName(rest)
        here = ready.select("id", F.lit(layer).alias("layer"))
        out = here if out is None else out.unionByName(here)
        left = kept(left.join(ready, "id", "left_anti"))
        needs = kept(needs.join(ready.withColumnRenamed("id", "dst"), "dst", "left_anti"))
        layer += 1
