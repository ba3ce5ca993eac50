"""Session logs: wire formats to one table of events, with gaps for whatever could not be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import READER_SECRET

# Types of lines that are known and carry no public text, by format.
SILENT = {
    "codex": ("event_msg", "turn_context", "inter_agent_communication_metadata"),
    "codex-items": ("reasoning", "function_call", "function_call_output", "custom_tool_call", "custom_tool_call_output", "agent_message", "tool_search_call", "tool_search_output"),
    "pi": ("model_change", "thinking_level_change", "label", "custom", "session_info", "custom_message", "usage", "context_edit"),
    "claude": ("file-history-snapshot", "file-history-delta", "queue-operation", "ai-title", "atis-latch", "agent-name", "bridge-session", "cost-state", "custom-title", "last-prompt", "mode", "permission-mode", "attachment", "relocated", "continued-in"),
}
COMPACTED = ("compacted", "compaction", "branch_summary", "summary", "compact_boundary")
TEXT_TYPES = ("text", "input_text", "output_text")


def _at(path: str) -> Column:
    return F.try_variant_get(F.col("v"), path, "string")


def _content(path: str) -> Column:
    """A string, or the text parts of an array of parts, one a line."""
    parts = F.try_variant_get(F.col("v"), path, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"].isin(*TEXT_TYPES)), lambda p: p["text"]), "\n")
    return F.when(F.schema_of_variant(F.try_variant_get(F.col("v"), path, "variant")) == "STRING", _at(path)).otherwise(joined)


def decode(lines: DataFrame, fmt: str, versions: tuple[str, ...] = ()) -> DataFrame:
    """lines(path, line, raw) of one format to path, line, session, event_id, parent, role, text, timestamp,
    delegated, raw_digest and gap: a row is an event (gap null, text set), a gap, or neither (text null).

    Identity comes from header lines and is carried forward over the lines of a file.
    """
    rows = lines.select("path", "line", "raw", F.try_parse_json("raw").alias("v")).withColumn("kind", _at("$.type"))
    over = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if fmt == "codex":
        header = F.col("kind") == "session_meta"
        nth = F.count_if(header).over(over)
        known = (F.length(_at("$.payload.cli_version")).between(1, 128)) & _at("$.payload.id").isNotNull()
        first = header & (nth == 1)
        rows = rows.withColumns({
            "nth": nth, "session": F.last(F.when(first & known, _at("$.payload.id")), True).over(over),
            "delegated": F.coalesce(F.last(F.when(first, (_at("$.payload.source") == "subagent") | F.schema_of_variant(F.try_variant_get("v", "$.payload.source", "variant")).startswith("OBJECT")), True).over(over), F.lit(False)) | (nth > 1),
        })
        item, known_item = _at("$.payload.type"), F.col("kind") == "response_item"
        gap = (
            F.when(header & (nth > 1), "inherited_session_metadata").when(first & ~F.coalesce(F.length(_at("$.payload.cli_version")).between(1, 128), F.lit(False)), "unknown_native_version")
            .when(first & _at("$.payload.id").isNull(), "missing_session_identity").when(header, None).when(F.col("session").isNull(), "missing_or_unknown_header")
            .when(F.col("kind").isin(*COMPACTED[:2]), "compaction_originals_not_proven").when(F.col("kind").isin(*SILENT["codex"], "world_state", "token_usage_record"), None)
            .when(~known_item, "unknown_event_schema").when(known_item & (item != "message") & ~item.isin(*SILENT["codex-items"]), "unknown_event_schema")
        )
        public, prefix = known_item & (item == "message"), "$.payload"
        event, parent = F.coalesce(_at("$.id"), F.concat(F.lit("line:"), F.col("line"))), F.lit(None).cast("string")
    elif fmt == "pi":
        header = F.col("kind") == "session"
        good = header & (F.try_variant_get("v", "$.version", "int") == 3) & _at("$.id").isNotNull()
        rows = rows.withColumn("session", F.first(F.when(good, _at("$.id")), True).over(over))
        source = F.coalesce(_at("$.source"), _at("$.message.source"))
        rows = rows.withColumn("delegated", F.coalesce(_at("$.delegated") == "true", F.lit(False)) | F.coalesce(source.isin("rpc", "agent", "subagent"), F.lit(False)))
        gap = (
            F.when(header & ~F.coalesce(good, F.lit(False)), "unknown_native_version").when(header & (_at("$.id") != F.col("session")), "mixed_session_identity").when(header, None)
            .when(F.col("session").isNull(), "missing_or_unknown_header").when(F.col("kind").isin(*COMPACTED[1:3]), "compaction_originals_not_proven")
            .when(F.col("kind").isin(*SILENT["pi"]), None).when(F.coalesce(F.col("kind") != "message", F.lit(True)), "unknown_event_schema").when(_at("$.id").isNull(), "missing_event_identity")
        )
        public, prefix, event, parent = F.col("kind") == "message", "$.message", _at("$.id"), _at("$.parentId")
    else:
        rows = rows.withColumn("session", F.first(F.when(F.col("kind").isin("user", "assistant"), _at("$.sessionId")), True).over(over))
        rows = rows.withColumn("delegated", F.coalesce(_at("$.isSidechain") == "true", F.lit(False)) | F.coalesce(_at("$.isMeta") == "true", F.lit(False)) | F.coalesce(F.col("raw").contains('"tool_result"'), F.lit(False)))
        boundary = F.col("kind").isin(*COMPACTED[3:]) | (_at("$.isCompactSummary") == "true") | ((F.col("kind") == "system") & (_at("$.subtype") == "compact_boundary"))
        gap = (
            F.when(F.coalesce(boundary, F.lit(False)), "compaction_originals_not_proven").when(F.col("kind").isin(*SILENT["claude"]), None)
            .when(~F.coalesce(_at("$.version").isin(*versions), F.lit(False)), "unknown_native_version").when(F.col("kind").isin("system", "progress"), None)
            .when(~F.coalesce(F.col("kind").isin("user", "assistant"), F.lit(False)), "unknown_event_schema").when(_at("$.sessionId").isNull() | _at("$.uuid").isNull(), "missing_event_identity")
            .when(~F.col("raw").contains('"parentUuid"'), "missing_parent_identity").when(_at("$.sessionId") != F.col("session"), "mixed_session_identity")
        )
        public, prefix, event, parent = F.col("kind").isin("user", "assistant"), "$.message", _at("$.uuid"), _at("$.parentUuid")
    role, text = _at(f"{prefix}.role"), _content(f"{prefix}.content")
    hidden = F.coalesce(_at(f"{prefix}.channel").isin("analysis", "summary"), F.lit(False)) | F.coalesce(_at("$.channel").isin("analysis", "summary"), F.lit(False))
    said = public & role.isin("user", "assistant") & ~hidden & (text != "")
    halted = (role == "assistant") & F.coalesce(_at(f"{prefix}.stop_reason"), _at(f"{prefix}.stopReason")).isin("aborted", "error")
    gap = F.when(F.col("v").isNull(), "malformed_event").otherwise(gap)
    gap = F.coalesce(gap, F.when(said & text.rlike(READER_SECRET), "sensitive_content_excluded").when(said & halted, "unfinished_output"))
    rows = rows.withColumns({"gap": gap, "role": role, "said": F.when(gap.isNull() & said, text), "event_id": event, "parent": parent, "timestamp": F.coalesce(_at("$.timestamp"), _at(f"{prefix}.timestamp"))})
    return rows.select("path", "line", "session", "event_id", "parent", "role", F.col("said").alias("text"), "timestamp", "delegated", F.sha2("raw", 256).alias("raw_digest"), "gap")


def dedupe(events: DataFrame, key: list[str], order: list[str], digest: str) -> tuple[DataFrame, DataFrame]:
    """The first event of each identity, and the identities whose events differ (a gap, not a choice)."""
    first = events.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
    conflicts = events.groupBy(*key).agg(F.count_distinct(digest).alias("n_digests"), F.count("*").alias("n_rows")).where("n_digests > 1")
    return first, conflicts


def forward_fill(rows: DataFrame, key: str, order: list[str], column: str, name: str) -> DataFrame:
    over = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(column, ignorenulls=True).over(over))


def newest_leaf(events: DataFrame, key: str, event: str, order: list[str]) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(event, F.struct(*order)).alias("leaf"))


def attribution(attested: Column) -> Column:
    """A user's own words, if not delegated and if the host vouches for them."""
    return F.when((F.col("role") == "user") & ~F.col("delegated") & attested, "attested-human").otherwise("unknown")


def event_key(fmt: str) -> Column:
    return F.sha2(F.to_json(F.array(F.lit(fmt), F.coalesce("session", "path"), F.col("event_id"), F.col("raw_digest"))), 256)
