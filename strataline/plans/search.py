"""Search and read over records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized, semantic_body, tokens
from ..operators import access, lifecycle, rank
from . import packing

SEARCH_BYTES, PAGE_MOST = 12_000, 100


def query_terms(spark, query: str, expansion: list[str] | None = None) -> list[str]:
    return sorted(set(spark.range(1).select(tokens(F.lit(query))).first()[0]) | set(expansion or ()))


def candidates(records: DataFrame, scope: dict, share_edges: DataFrame | None = None, dispositions: DataFrame | None = None, statuses=("active",), include_inactive=False) -> DataFrame:
    """What the caller may see, before any ranking: statistics and limits come after."""
    seen = records.where(access.visible(scope["project_id"], scope.get("worktree_id"), scope.get("task_id")))
    out = seen.withColumn("imported", F.lit(False))
    if share_edges is not None:
        shared = access.with_imports(records.where("scope = 'project'"), share_edges, scope["project_id"]).where("imported")
        out = out.unionByName(shared)
    if dispositions is not None:
        out = access.usable(out, dispositions)
    return out if include_inactive else out.where(F.col("effective_status").isin(*statuses))


def ranked(rows: DataFrame, query: str, expansion=None, domain: str | None = None, mode: str | None = None) -> tuple[DataFrame, list]:
    """The hits of a query (or all rows, for an empty one) and the total order that they stand in."""
    title = F.col("title")
    if not query.strip():
        return rows.withColumns({"score": F.lit(0.0), "hit_terms": F.array().cast("array<string>"), "hit_fields": F.array().cast("array<string>")}), [normalized(title).asc(), F.asc("project_id"), F.asc("id")]
    kinds = dict(rows.dtypes)
    said = {"array<string": lambda c: F.concat_ws(" ", c), "array<struct": lambda c: F.concat_ws(" ", F.col(f"{c}.uri"))}  # of sources their URIs
    fields = {c: said.get(kinds[c][:12], F.col)(c) for c in rank.FIELD_WEIGHTS if c in rows.columns}
    got = rank.bm25(rows, query_terms(rows.sparkSession, query, expansion), fields)
    got = rank.boosted(got, query, title, F.col("domain") if "domain" in rows.columns else None, domain)
    trust = [lifecycle.assurance_rank(F.col("assurance")).asc()] if "assurance" in rows.columns else []
    if mode is not None and "task_modes" in rows.columns:
        return rank.mode_boosted(got, F.col("task_modes"), mode), [F.desc("score"), *trust, F.asc("id")]
    return got, [F.desc("score"), *trust, *rank.relevance_order(title)[1:]]


def card(body_bytes: int = 1024, preview: int = 360) -> list:
    """Columns of a card: the body if short, else the summary or a preview; what a full read would add."""
    short = F.octet_length("body") <= body_bytes
    return [
        F.when(short, semantic_body(F.col("body"))).alias("shown_body"), F.when(~short, F.substring(semantic_body(F.col("body")), 1, preview)).alias("preview"),
        F.octet_length("body").alias("body_bytes"), (~short).alias("read_required"),
    ]


def search(records: DataFrame, scope: dict, query: str = "", limit: int = 20, cursor: str | None = None, budget: int = SEARCH_BYTES, **how) -> dict:
    """One page: at most ``limit`` rows reach the driver, which packs them into the budget.

    A cursor of another revision of the corpus or of another query is stale.
    """
    if not 1 <= limit <= PAGE_MOST:
        raise ValueError("limit")
    pool = candidates(records, scope, **{k: how[k] for k in ("share_edges", "dispositions", "statuses", "include_inactive") if k in how})
    print_ = pool.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*[c for c, t in pool.dtypes if not t.startswith("map")])).alias("x")).first()
    now = packing.revision(query, scope, [print_["n"], print_["x"]], {k: str(v) for k, v in how.items() if k in ("domain", "mode", "restrict_mode", "expansion")})
    offset = 0
    if cursor:
        then, offset = packing.decode_cursor(cursor, "search")
        if then != now:
            raise ValueError("stale_search")
    if how.get("restrict_mode") and how.get("mode") is not None and "task_modes" in pool.columns:
        pool = pool.where(F.array_contains("task_modes", how["mode"]))  # after the revision: statistics are those of what is left
    hits, order = ranked(pool, query, how.get("expansion"), how.get("domain"), how.get("mode"))
    rows = rank.page(hits, order, limit + 1, offset).select("rank", "id", "project_id", "kind", "effective_status", "title", "score", "hit_terms", *card()).orderBy("rank").collect()
    shown, _ = packing.pack_stop([r.asDict() for r in rows[:limit]], budget, lambda r: {k: (r[k][:160] if k == "title" else r[k]) for k in ("rank", "id", "project_id", "kind", "effective_status", "title")} | {"card_omitted": True})
    more = len(rows) > len(shown)
    return {"items": shown, "revision": now, "omitted": len(rows) - len(shown), "cursor": packing.encode_cursor("search", now, offset + len(shown)) if more and shown else None}


def read(records: DataFrame, ids: list[str], budget: int = SEARCH_BYTES) -> dict:
    spark = records.sparkSession
    asked = spark.createDataFrame(list(enumerate(dict.fromkeys(ids))), "ordinal int, id string")
    rows = access.read_by_ids(records.where(F.col("id").isin(ids)), asked).orderBy("ordinal").collect()
    items, omitted = packing.pack_stop([r.asDict(recursive=True) for r in rows if r["found"]], budget)
    return {"items": items, "missing": [r["id"] for r in rows if not r["found"]], "omitted": omitted}
