"""Evidence references: what each leads to, what stands against it, and what a claim's references add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import effects, graph


def resolve_references(refs: DataFrame, events: DataFrame, records: DataFrame, claims: DataFrame, rests: DataFrame) -> DataFrame:
    """owner, ref, kind, level, reason of refs(owner, ref); reason is null for a reference that may support a claim.

    A reference is the key of an event, 'record:<id>' or 'collaboration:<id>'. events(key, evidence, branch_verified, forbidden), records(id, effective_status, usable,
    level) and claims (the same) are what a review may read; rests(src, dst) are the references that the records and claims were themselves made from.
    Reasons, the first that holds: 'unverifiable_source' (no such event, kind or id), 'source_forbidden', 'derivative_only' (the event, or one that the record rests on over any
    number of steps, is derived material), 'unverified_branch', 'dependency_inactive', 'cyclic_reference' (the record rests on itself, or on one that does).
    All three kinds are resolved by one equi-join of names; what rests on derived material is one closure, and cycles are what no layering reaches.
    """
    name = lambda kind: F.concat(F.lit(f"{kind}:"), "id")
    known = events.select(F.col("key").alias("name"), F.lit("event").alias("kind"), F.lit(None).cast("string").alias("level"), F.lit(True).alias("active"), F.col("forbidden"), F.coalesce("branch_verified", F.lit(False)).alias("verified"), (F.col("evidence") == "derivative").alias("derived"))
    for kind, table in (("record", records), ("collaboration", claims)):
        known = known.unionByName(table.select(name(kind).alias("name"), F.lit(kind).alias("kind"), "level", (F.col("effective_status") == "active").alias("active"), (~F.col("usable")).alias("forbidden"), F.lit(True).alias("verified"), F.lit(False).alias("derived")))
    known = graph.kept(known)
    edges = graph.kept(rests.select("src", "dst").distinct())
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    tainted = graph.reachable(refs.sparkSession, back, known.where("derived").select(F.col("name").alias("id")))
    inner = edges.join(known.where("kind <> 'event'").select(F.col("name").alias("dst")), "dst", "left_semi").select("src", "dst")
    round_ = effects.layers(known.where("kind <> 'event'").select(F.col("name").alias("id")), inner).where("layer IS NULL")
    got = refs.join(known.withColumnRenamed("name", "ref"), "ref", "left")
    got = got.join(tainted.select(F.col("id").alias("ref"), F.lit(True).alias("tainted")), "ref", "left").join(round_.select(F.col("id").alias("ref"), F.lit(True).alias("cyclic")), "ref", "left")
    reason = (
        F.when(F.col("kind").isNull(), "unverifiable_source").when(F.coalesce("forbidden", F.lit(False)), "source_forbidden").when(F.col("tainted"), "derivative_only")
        .when(~F.col("verified"), "unverified_branch").when(~F.coalesce("active", F.lit(False)), "dependency_inactive").when(F.col("cyclic"), "cyclic_reference")
    )
    return got.select("owner", "ref", "kind", "level", reason.alias("reason"))


def evidence_counts(resolved: DataFrame) -> DataFrame:
    """owner, n_refs, n_missing_refs, n_prohibited and evidence_type: what ``views.admission_error`` asks of a claim's references.

    evidence_type is the weakest level among them: 'hypothesis', else 'report', else null.
    """
    weak = F.when(F.bool_or(F.col("level") == "hypothesis"), "hypothesis").when(F.bool_or(F.col("level") == "report"), "report")
    bad = F.col("reason").isNotNull() & (F.col("reason") != "source_forbidden")
    return resolved.groupBy("owner").agg(F.count("*").alias("n_refs"), F.count_if(bad).alias("n_missing_refs"), F.count_if(F.col("reason") == "source_forbidden").alias("n_prohibited"), weak.alias("evidence_type"))
