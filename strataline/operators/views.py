"""Published views: replaced narratives, masked units, freshness, owners, excerpts, and what evidence may support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalized, tokens

# Roles of a narrative in the order in which they are shown.
NARRATIVE_ROLES = ("preference", "goal", "background", "milestone", "branch", "outcome", "current", "question")

# Groups of a context packet in the order in which they are packed.
CONTEXT_GROUPS = ("owner", "preference", "task", "background")


def _place(value: Column, known: tuple[str, ...]) -> Column:
    place = F.array_position(F.array(*[F.lit(k) for k in known]), value)
    return F.when(place > 0, place).otherwise(len(known) + 1)


def role_order(role: Column) -> Column:
    return _place(role, NARRATIVE_ROLES)


def group_order(group: Column) -> Column:
    """From 0; what is none of the groups comes after them."""
    return (_place(group, CONTEXT_GROUPS) - 1).cast("int")


def replaced(records: DataFrame, qualifier: list[str]) -> DataFrame:
    """Adds is_replaced: whether a record of the same qualifier says in ``replaces`` that it stands for this one.

    A link is a tombstone: it counts whatever became of the record that made it.
    """
    links = records.select(*[F.col(q).alias(f"q_{q}") for q in qualifier], F.explode("replaces").alias("ref")).where(F.col("ref").startswith("record:")).distinct()
    same = F.concat(F.lit("record:"), F.col("id")) == F.col("ref")
    for q in qualifier:
        same = same & F.col(q).eqNullSafe(F.col(f"q_{q}"))
    return records.join(links, same, "left").withColumn("is_replaced", F.col("ref").isNotNull()).drop("ref", *[f"q_{q}" for q in qualifier])


def shown_units(units: DataFrame, corrections: DataFrame, qualifier: list[str]) -> DataFrame:
    """units(view, unit, narrative_id, cites) that no correction(ref, id) of the same qualifier masks.

    A correction names a unit (view:<view>#<unit>) or a narrative; a unit that cites the correction already
    has taken it in and stays.
    """
    keys = [F.col(q).alias(f"q_{q}") for q in qualifier]
    by_unit = units.withColumn("ref", F.concat(F.lit("view:"), "view", F.lit("#"), "unit"))
    same = lambda left: [left[q].eqNullSafe(F.col(f"q_{q}")) for q in qualifier]
    c = corrections.select(*keys, F.col("ref").alias("c_ref"), F.col("id").alias("c_id"))
    first = by_unit.join(c, [by_unit.ref == c.c_ref, *same(by_unit)])
    second = by_unit.join(c, [F.concat(F.lit("narrative:"), by_unit.narrative_id) == c.c_ref, *same(by_unit)])
    masked = first.unionByName(second).where(~F.array_contains("cites", F.concat(F.lit("record:"), F.col("c_id")))).select("view", "unit").distinct()
    return units.join(masked, ["view", "unit"], "left_anti")


def freshness(units: DataFrame, sources: DataFrame) -> DataFrame:
    """view, unit, label of units(view, unit, bindings array<struct<source_id,digest>>) against sources(source_id, digest).

    'unavailable' if a source is gone, else 'needs-check' if one has changed, else 'as-of'; a unit that is bound
    to nothing is 'not-rechecked'.
    """
    bound = units.select("view", "unit", F.explode_outer("bindings").alias("b")).select("view", "unit", "b.source_id", F.col("b.digest").alias("then"))
    now = sources.select("source_id", F.col("digest").alias("now"))
    has = F.col("source_id").isNotNull()
    got = bound.join(now, "source_id", "left").groupBy("view", "unit").agg(
        F.bool_or(has & F.col("now").isNull()).alias("gone"), F.bool_or(has & (F.col("now") != F.col("then"))).alias("changed"), F.bool_or(has).alias("bound")
    )
    return got.select("view", "unit", F.when(F.col("gone"), "unavailable").when(F.col("changed"), "needs-check").when(F.col("bound"), "as-of").otherwise("not-rechecked").alias("label"))


def owners(topics: DataFrame, owner_files: DataFrame) -> DataFrame:
    """Owner files of the matched topics, and those of role index, which always count."""
    ids = topics.agg(F.collect_set("topic_id").alias("matched"))  # 64 topics at most
    return owner_files.crossJoin(F.broadcast(ids)).where((F.col("role") == "index") | F.arrays_overlap("topic_ids", "matched")).drop("matched")


def excerpt(files: DataFrame, terms: list[str], most: int = 10, around: int = 1) -> DataFrame:
    """path, line, text: the lines with the most of the terms, ``most`` a file, and their neighbours."""
    wanted = F.array(*[F.lit(t) for t in terms])
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    score = F.size(F.array_intersect(tokens(F.col("text")), wanted))
    top = lines.withColumn("score", score).where("score > 0")
    top = top.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "line"))).where(F.col("n") <= most)
    near = top.select("path", F.explode(F.sequence(F.greatest(F.col("line") - around, F.lit(0)), F.col("line") + around)).alias("line")).distinct()
    return lines.join(near, ["path", "line"]).select("path", (F.col("line") + 1).alias("line"), "text")


def uncovered_sources(originals: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, uri, locator) of originals that no event matches by both: an approval needs none of these."""
    return originals.join(evidence.select("id", "uri", "locator").distinct(), ["id", "uri", "locator"], "left_anti")


def admission_error(target: str) -> Column:
    """Why a claim may not be admitted (null if it may); needs projects, scenarios, known_scenarios, statement_type,
    evidence_type, level, evidence_level, attested, n_missing_refs and n_prohibited."""
    upgrade = ((F.col("evidence_type") == "hypothesis") & (F.col("statement_type") == "conclusion")) | ((F.col("evidence_type") == "report") & (F.col("statement_type") == "recorded"))
    return (
        F.when(F.col("n_missing_refs") > 0, "unresolved_reference").when(F.col("n_prohibited") > 0, "source_prohibited").when((F.size("projects") > 0) & ~F.array_contains("projects", target), "project_mismatch")
        .when(F.size(F.array_except("scenarios", "known_scenarios")) > 0, "unknown_scenario").when(upgrade, "level_upgrade")
        .when((F.col("evidence_level") == "inferred") & (F.col("level") == "explicit"), "level_upgrade").when((F.col("level") == "explicit") & ~F.col("attested"), "not_attested")
    )


def authorized(selections: DataFrame, grants: DataFrame) -> DataFrame:
    """selections whose grant is there with the digest that they were made under."""
    return selections.join(grants.select("grant_id", "grant_digest"), ["grant_id", "grant_digest"], "left_semi")


def bound_profiles(projects: DataFrame, profiles: DataFrame) -> DataFrame:
    """project_id, profile: the profile named for a project, else the only eligible one; null if there are several."""
    named = profiles.where("project_id IS NOT NULL").select("project_id", F.col("profile").alias("named"))
    free = profiles.where("project_id IS NULL AND eligible").agg(F.count("*").alias("n"), F.min("profile").alias("only"))
    out = projects.join(named, "project_id", "left").crossJoin(F.broadcast(free))
    return out.select("project_id", F.coalesce("named", F.when(F.col("n") == 1, F.col("only"))).alias("profile"))


def matches_title(records: DataFrame, text: str) -> DataFrame:
    """Audit filter: records whose JSON holds a text, whatever the case."""
    return records.where(F.contains(F.lower(F.to_json(F.struct("*"))), normalized(F.lit(text))))
