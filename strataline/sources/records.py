"""Record files (a fenced JSON header and a body) and append-only tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import stripped

# What a record may be and where it may hold.
KINDS = ("observation", "evidence", "hypothesis", "decision", "experiment", "result", "invariant", "bug/root-cause", "handoff")
SCOPES = ("project", "worktree", "task")
MAX_BYTES = 1024 * 1024

HEADER = """version INT, id STRING, project_id STRING, scope STRING, worktree_id STRING, task_id STRING, kind STRING, title STRING, status STRING,
 created_at TIMESTAMP, expires_at TIMESTAMP, sources ARRAY<STRUCT<uri:STRING,locator:STRING,note:STRING>>,
 provenance STRUCT<cwd:STRING,harness:STRING,session_id:STRING,actor:STRING,role:STRING,model:STRING>, proposal STRUCT<key:STRING,digest:STRING>,
 promotion STRUCT<key:STRING,digest:STRING>, review STRUCT<reason:STRING,reviewer:STRUCT<session_id:STRING,actor:STRING>,reviewed_at:TIMESTAMP>,
 supersedes ARRAY<STRING>, withdraws STRING, content_digest STRING"""


def errors() -> Column:
    """What is wrong with a record, by name; an empty array if nothing is."""
    present = lambda c: F.coalesce(stripped(F.col(c)) != "", F.lit(False))
    checks = {
        "header": F.col("id").isNull(), "id": ~F.coalesce(F.col("id").rlike("^[0-9a-f]{32}$"), F.lit(False)), "kind": ~F.coalesce(F.col("kind").isin(*KINDS, "episode"), F.lit(False)),
        "scope": ~F.coalesce(F.col("scope").isin(*SCOPES), F.lit(False)), "status": ~F.coalesce(F.col("status").isin("candidate", "active"), F.lit(False)), "title": ~present("title"),
        "worktree": (F.col("scope") != "project") & ~F.coalesce(F.col("worktree_id").rlike("^[0-9a-f]{24}$"), F.lit(False)), "task": (F.col("scope") == "task") & ~present("task_id"),
        "active": (F.col("status") == "active") & (F.col("review").isNull() | F.col("promotion").isNull()), "supersedes": (F.size("supersedes") > 0) & (F.col("status") != "active"),
        "size": F.col("n_bytes") > MAX_BYTES,
    }
    return F.filter(F.array(*[F.when(bad, F.lit(n)) for n, bad in checks.items()]), lambda x: x.isNotNull())


def read_records(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Records of a folder of Markdown files: the header's fields, body, path and errors.

    ``strict`` fails the query at the first bad file; else bad files come with their errors.
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), "value", F.octet_length("value").alias("n_bytes"))
    return parse_records(raw, strict)


def parse_records(raw: DataFrame, strict: bool = True) -> DataFrame:
    """raw(path, value, n_bytes) to records. A header with repeated keys or NaN is no header."""
    fenced = r"(?s)^---(?:json)?\n(.*?)\n---\n?(.*)$"
    head = F.regexp_extract("value", fenced, 1)
    rows = raw.select("path", "n_bytes", F.when(F.try_parse_json(head).isNotNull(), F.from_json(head, HEADER)).alias("h"), F.regexp_extract("value", fenced, 2).alias("body"))
    rows = rows.select("path", "n_bytes", "h.*", "body")
    rows = rows.withColumn("errors", errors())
    return rows.where(F.when(F.size("errors") > 0, F.raise_error(F.concat(F.lit("invalid record "), "path", F.lit(": "), F.array_join("errors", ",")))).otherwise(F.lit(True)).cast("boolean")) if strict else rows


def corpus_errors(records: DataFrame) -> DataFrame:
    """(id, reason): repeated ids or operation keys, and supersession edges that lead nowhere."""
    from ..operators.lifecycle import edge_violations, many_successors

    ids = records.groupBy("id").count().where("count > 1").select("id", F.lit("repeated-id").alias("reason"))
    keys = records.where("proposal.key IS NOT NULL").groupBy(F.col("proposal.key").alias("id")).count().where("count > 1").select("id", F.lit("repeated-key").alias("reason"))
    edges = edge_violations(records.withColumn("supersedes", F.coalesce("supersedes", F.array().cast("array<string>"))), ["project_id", "scope", "worktree_id", "task_id"])
    twice = many_successors(records).select(F.col("old").alias("id"), F.lit("many-successors").alias("reason"))
    return ids.unionByName(keys).unionByName(edges.select("id", F.concat(F.lit("supersedes-"), "reason").alias("reason"))).unionByName(twice)


class Journal:
    """An append-only table: rows are only ever added; the state of a key is its last row.

    Plain Parquet has no transactions, so there is one writer (the driver). A key that is appended again with
    the same digest changes nothing, with another digest it is a conflict, and an append that names the
    revision it was made from fails if the key has moved on.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, f"op_key string, digest string, seq bigint, previous string, {schema}"

    def all(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:  # nothing was ever written
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame, key: str) -> int:
        """rows: op_key, key and payload columns, and optionally ``expected`` (a digest or 'start'). How many were new."""
        names = [c for c in rows.columns if c not in ("op_key", "expected")]
        new = rows.withColumn("digest", F.sha2(F.to_json(F.struct(*names)), 256))
        old = self.all()
        seen = old.select("op_key", F.col("digest").alias("old_digest"))
        both = new.join(seen, "op_key", "left")
        if both.where("old_digest <> digest").limit(1).count():
            raise ValueError("idempotency_conflict")
        fresh = both.where("old_digest IS NULL").drop("old_digest")
        last = old.groupBy(key).agg(F.max_by("digest", "seq").alias("previous"), F.max("seq").alias("last"))
        fresh = fresh.join(last, key, "left").withColumn("previous", F.coalesce("previous", F.lit("start")))
        if "expected" in rows.columns:
            if fresh.where("expected IS NOT NULL AND expected <> previous").limit(1).count():
                raise ValueError("stale_revision")
            fresh = fresh.drop("expected")
        place = F.row_number().over(Window.partitionBy(key).orderBy("op_key"))
        out = fresh.withColumn("seq", F.coalesce("last", F.lit(0)) + place).drop("last").select(*[c.split()[0] for c in self.schema.split(", ")])
        n = out.count()
        if n:
            out.write.mode("append").parquet(self.path)
        return n

    def latest(self, key: str) -> DataFrame:
        rows = self.all()
        return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "seq").alias("r")).select(key, "r.*")


def publish_version(df: DataFrame, root: str) -> str:
    """Write a new immutable version beside the old ones; the returned path is what a pointer may be set to."""
    path = f"{root}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def prunable(objects: DataFrame, reachable: DataFrame) -> DataFrame:
    """Objects that nothing leads to: what a prune would delete. Deleting is left to the caller."""
    return objects.join(reachable.select("id"), "id", "left_anti")
