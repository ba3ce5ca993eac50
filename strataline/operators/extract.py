"""Extraction from idle sessions: which are due, who holds them, their windows, and what passes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import backoff_seconds, redact, stripped
from . import graph
from .scan import CHUNK, running

# What a worker's lesson may be about, and openings that only restate a task.
WORKER_CATEGORIES = ("mistake", "correction", "capability-gap")
TASK_ONLY = (
    r"(?i)^\W*(?:the\s+)?(?:worker|subagent|agent)\s+(?:was\s+|is\s+)?(?:assigned|asked|tasked|given|instructed|requested)\b"
    r"|^\W*(?:successfully\s+)?(?:completed|finished|performed|conducted|delivered)\b"
)
# How long a lease holds, when a session is idle or too old, and states that end a job.
LEASE_SECONDS, IDLE_HOURS, MAX_AGE_DAYS = 3600, 1, 10
FINISHED = ("extracted", "no-output", "skipped")


def due(listing: DataFrame, jobs: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """path, mtime, size: sessions idle for an hour and not too old, without a live lease or a pending retry.

    A session that has grown since it was finished is due again. The newest come first.
    """
    idle = listing.where((F.col("mtime") <= as_of - F.expr(f"INTERVAL {IDLE_HOURS} HOURS")) & (F.col("mtime") >= as_of - F.expr(f"INTERVAL {MAX_AGE_DAYS} DAYS")))
    held = jobs.select("path", "state", F.col("size").alias("job_size"), "lease_until", "next_attempt")
    now = F.unix_timestamp(as_of)
    ready = (
        F.col("state").isNull() | (F.col("state").isin(*FINISHED) & (F.col("size") > F.col("job_size")))
        | ((F.col("state") == "leased") & (F.col("lease_until") <= now)) | ((F.col("state") == "failed") & (F.col("next_attempt") <= now))
    )
    out = idle.join(held, "path", "left").where(ready).select("path", "mtime", "size")
    return out.orderBy(F.desc("mtime"), "path").limit(limit) if limit is not None else out


def job_status(listing: DataFrame, jobs: DataFrame, as_of: Column) -> DataFrame:
    """state, n: jobs by state; idle sessions without a job are 'eligible'."""
    idle = listing.where(F.col("mtime") <= as_of - F.expr(f"INTERVAL {IDLE_HOURS} HOURS")).select("path")
    return jobs.select("path", "state").join(idle, "path", "full_outer").groupBy(F.coalesce("state", F.lit("eligible")).alias("state")).agg(F.count("*").alias("n"))


def next_attempts(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("next_attempt", F.col("failed_at") + backoff_seconds(F.col("attempts")))


def greedy_windows(events: DataFrame, key: str, order: str, window_bytes: int, label: Column | None = None) -> DataFrame:
    """key, window, first, last, n, bytes: events packed in order; a window closes before the line that overflows it.

    ``order`` is a whole number, no two lines of a session share it.
    Text is redacted first and empty texts drop out. A line longer than a window is cut to fit. Equal
    prefixes give equal windows, so a grown session resumes where it was. Where the window that would begin at a line ends follows from
    running sums of bytes; the windows there are begin at the lines that these pointers lead to from the first line, found by doubling. So a
    session of any length is spread over all tasks.
    """
    text = redact(F.col("text"))
    line = F.concat(F.lit("["), label if label is not None else F.concat(F.lit("L"), F.col(order)), F.lit("] "), F.col("role"), F.lit(": "), F.col("__text"), F.lit("\n"))
    size = F.least(F.octet_length(line), F.lit(window_bytes)).cast("bigint")
    lines = events.withColumn("__text", text).where("__text <> ''").select(F.col(key).alias("key"), F.col(order).cast("bigint").alias("o"), size.alias("s"))
    lines = graph.kept(running(lines, ["key"], ["o"], {"i": ("sum", F.lit(1).cast("bigint")), "c": ("sum", F.col("s"))}))
    # A window from line i ends before the first line whose sum exceeds all before i and a window: as many sums as don't are counted.
    limits = lines.select("key", (F.col("c") - F.col("s") + window_bytes).alias("v"), F.col("i").alias("of"))
    both = lines.select("key", F.col("c").alias("v"), F.lit(0).cast("bigint").alias("of")).unionByName(limits)
    ends = running(both, ["key"], ["v", "of"], {"fit": ("sum", F.when(F.col("of") == 0, 1).otherwise(0))}, chunk=max(CHUNK, 64 * window_bytes)).where("of > 0")
    jump = graph.kept(ends.join(lines.select(F.col("key").alias("k"), F.col("i").alias("j")), (F.col("key") == F.col("k")) & (F.col("fit") + 1 == F.col("j"))).select("key", F.col("of").alias("i"), F.col("j").alias("next")))
    begin = leaps(jump, lines.select("key", F.lit(1).cast("bigint").alias("i")).distinct())
    marked = lines.join(begin.select(F.col("key").alias("k"), F.col("i").alias("at")), (F.col("key") == F.col("k")) & (F.col("i") == F.col("at")), "left")
    numbered = running(marked.select("key", "o", "s", "i", F.col("at").isNotNull().cast("bigint").alias("new")), ["key"], ["i"], {"window": ("sum", F.col("new"))})
    return numbered.groupBy(F.col("key").alias(key), "window").agg(F.min("o").alias("first"), F.max("o").alias("last"), F.count("*").alias("n"), F.sum("s").alias("bytes"))


def leaps(jump: DataFrame, begin: DataFrame) -> DataFrame:
    """(key, i): where jump(key, i, next) leads to from begin(key, i), over any number of steps, and where it begins.

    Jumps are doubled until none is left; places with fewer jumps after them drop out of each further round. Then the longest ones are taken first.
    """
    jumps, begin = [], graph.kept(begin)
    while jump.limit(1).count():
        jumps.append(jump)
        ahead = jump.select(F.col("key").alias("k"), F.col("i").alias("at"), F.col("next").alias("then"))
        jump = graph.kept(jump.join(ahead, F.col("key").eqNullSafe(F.col("k")) & (F.col("next") == F.col("at"))).select("key", "i", F.col("then").alias("next")))
    for jump in reversed(jumps):
        far = begin.withColumnsRenamed({"key": "k", "i": "at"}).join(jump, F.col("key").eqNullSafe(F.col("k")) & (F.col("i") == F.col("at"))).select("key", F.col("next").alias("i"))
        begin = graph.kept(begin.unionByName(far))
    return begin


def cooled(triggers: DataFrame, key: str, at: str, name: str, interval: int) -> DataFrame:
    """triggers and spawned, next_after: those that start something, if for ``interval`` seconds after a start nothing else does.

    ``at`` is in whole seconds; triggers of one second come by ``name``. next_after: seconds that a trigger which is too early would have had to wait, else null. Each
    trigger points to the first one that could start after it; the starts are where these pointers lead to from the first, so no store has to fit one task.
    """
    rows = triggers.select(F.col(key).alias("key"), F.col(at).cast("bigint").alias("t"), F.col(name).alias("name"))
    rows = graph.kept(running(rows, ["key"], ["t", "name"], {"i": ("sum", F.lit(1).cast("bigint"))}))
    limits = rows.select("key", (F.col("t") + interval).alias("v"), F.lit(0).alias("kind"), "i")
    both = limits.unionByName(rows.select("key", F.col("t").alias("v"), F.lit(1).alias("kind"), "i"))
    fit = running(both, ["key"], ["v", "kind"], {"before": ("sum", F.col("kind"))}).where("kind = 0")
    last = rows.groupBy(F.col("key").alias("k")).agg(F.max("i").alias("n"))
    jump = fit.join(last, F.col("key").eqNullSafe(F.col("k"))).where("before < n").select("key", "i", (F.col("before") + 1).alias("next"))
    starts = leaps(graph.kept(jump), rows.where("i = 1").select("key", "i"))
    marked = rows.join(starts.select(F.col("key").alias("k"), F.col("i").alias("j")), F.col("key").eqNullSafe(F.col("k")) & (F.col("i") == F.col("j")), "left").withColumn("spawned", F.col("j").isNotNull()).drop("k", "j")
    got = running(marked, ["key"], ["i"], {"since": ("max", F.when(F.col("spawned"), F.col("t")))})
    return got.select(F.col("key").alias(key), F.col("t").alias(at), "name", "spawned", F.when(~F.col("spawned"), F.col("since") + interval - F.col("t")).alias("next_after")).withColumnRenamed("name", name)


def exact_json(text: Column) -> Column:
    """A text that is one JSON document as a variant, else null. (The built-in takes a document with anything behind it.)"""
    many = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_variant_get(many, "$[1]", "variant").isNull(), F.try_variant_get(many, "$[0]", "variant"))


def json_object(text: Column) -> Column:
    """What lies between the first opening and the last closing brace, as a variant; null if that is not one JSON document."""
    return exact_json(F.regexp_extract(text, r"(?s)\{.*\}", 0))


def model_answers(outputs: DataFrame) -> DataFrame:
    """outputs(session, window, output) and answer (JSON text), input_tokens, output_tokens, cost, failed: what a model's output says.

    The output is one JSON document, or one on each line; lines that aren't JSON are passed over. An answer is a document with ``candidates``, or the JSON object in the text of a
    result or of an agent's message; of several the last counts, and none is null. Numbers are those of the last document that has them.
    """
    whole = exact_json(F.col("output"))
    lines = F.when(whole.isNotNull(), F.array("output")).otherwise(F.split("output", "\r\n|\r|\n"))
    at = lambda path, kind="string": F.try_variant_get("v", path, kind)
    docs = outputs.select("session", "window", F.posexplode_outer(lines).alias("line", "raw")).withColumn("v", exact_json(F.col("raw")))
    kind = F.coalesce(at("$.item.type"), F.lit(""))
    said = F.array(F.when(at("$.candidates", "variant").isNotNull(), F.to_json("v")), F.to_json(json_object(at("$.result"))), F.to_json(json_object(F.when(kind.isin("agent_message", "assistant_message"), at("$.item.text")))))
    docs = docs.withColumn("said", F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(said, lambda x: x.isNotNull())), -1))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("line")))
    failed = F.coalesce((at("$.is_error", "boolean")) | at("$.type").isin("error", "turn.failed"), F.lit(False)) | F.coalesce(at("$.type").isin("error", "turn.failed"), F.lit(False))
    return docs.groupBy("session", "window").agg(
        last(F.col("said")).alias("answer"), last(at("$.usage.input_tokens", "bigint")).alias("input_tokens"), last(at("$.usage.output_tokens", "bigint")).alias("output_tokens"),
        last(at("$.total_cost_usd", "double")).alias("cost"), F.bool_or(failed).alias("failed"),
    )


def worker_filter(candidates: DataFrame) -> DataFrame:
    """Lessons about a mistake, a correction or a gap, with a cause and a condition, that don't restate the task."""
    said = lambda c: stripped(F.coalesce(F.col(c), F.lit(""))) != ""
    ok = F.col("category").isin(*WORKER_CATEGORIES) & said("cause") & said("conditions") & ~F.col("title").rlike(TASK_ONLY) & ~F.col("body").rlike(TASK_ONLY)
    return candidates.where(ok).withColumn("body", F.concat(stripped(F.col("body")), F.lit("\nLikely cause: "), stripped(F.col("cause"))))


def candidate_errors(kinds: tuple[str, ...]) -> Column:
    """What is wrong with a candidate row (kind, title, body, source_events, labels), by name."""
    checks = {
        "kind": ~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), "title": F.coalesce(stripped(F.col("title")), F.lit("")) == "", "body": F.coalesce(stripped(F.col("body")), F.lit("")) == "",
        "source_events": F.size(F.array_except(F.coalesce("source_events", F.array().cast("array<string>")), "labels")) > 0,
    }
    return F.filter(F.array(*[F.when(bad, F.lit(n)) for n, bad in checks.items()]), lambda x: x.isNotNull())


def run_model(windows: DataFrame, model: Callable[[str], str], schema: str = "session string, window bigint, output string") -> DataFrame:
    """The caller's model on each window's text, on the executors; there is no default model and no network."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"session": b["session"], "window": b["window"], "output": b["text"].map(model)})

    return windows.select("session", "window", "text").mapInPandas(run, schema)
