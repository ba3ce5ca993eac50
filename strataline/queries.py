"""The record engine's operators applied to the carrier tables, each with the same result in DuckDB SQL.

The engine's entities stand in the carriers like this: records are ``documents`` (project = source, domain =
lang, title = first line) or ``orders`` (status, dates, chains per customer); journals and idle sessions are
``events``; session logs are ``conversations``; the registry is ``region``, ``nation`` and ``customer``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as T
from .operators import access, effects, evidence, extract, graph, lifecycle, preferences, rank, report, review, scan, snapshots, transcripts, views
from .sources import records
from .streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

AS_OF = "1998-08-02"
QUERY = "license released"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- carriers, once for Spark and once for DuckDB


def doc_records(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("project_id"), F.col("lang").alias("domain"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"))


DOCS = "r AS (SELECT doc_id AS id, source AS project_id, lang AS domain, split_part(text, chr(10), 1) AS title, text AS body FROM documents)"


def order_records(spark, d) -> DataFrame:
    """Each order supersedes the one before it of the same customer if it is open, and withdraws it if its key ends a block of 50."""
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    prev = F.lag("o_orderkey").over(w)
    o = o.withColumn("prev", prev)
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), F.col("o_orderpriority").alias("kind"), F.when(F.col("o_orderstatus") == "F", "candidate").otherwise("active").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 14 DAYS")).alias("expires_at"),
        F.when((F.col("o_orderstatus") == "O") & F.col("prev").isNotNull(), F.array("prev")).otherwise(F.array().cast("array<bigint>")).alias("supersedes"),
        F.when(F.col("o_orderkey") % 50 == 1, F.col("prev")).alias("withdraws"), (F.col("o_orderpriority") == "5-LOW").alias("retired"), F.col("prev").alias("parent"),
    )


ORDERS = """p AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders),
r AS (SELECT o_orderkey AS id, o_custkey AS project_id, o_orderpriority AS kind, CASE WHEN o_orderstatus = 'F' THEN 'candidate' ELSE 'active' END AS status,
  CAST(o_orderdate AS TIMESTAMP) AS created_at, CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 14 DAY END AS expires_at,
  CASE WHEN o_orderstatus = 'O' THEN prev END AS supersedes, CASE WHEN o_orderkey % 50 = 1 THEN prev END AS withdraws, o_orderpriority = '5-LOW' AS retired, prev AS parent FROM p),
e AS (SELECT r.*, CASE WHEN withdraws IS NOT NULL THEN 'withdrawal' WHEN id IN (SELECT withdraws FROM r WHERE withdraws IS NOT NULL) THEN 'withdrawn'
    WHEN id IN (SELECT supersedes FROM r WHERE supersedes IS NOT NULL) THEN 'superseded' WHEN expires_at <= TIMESTAMP '1998-08-02' THEN 'expired' ELSE status END AS effective FROM r)"""

_STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def sql_tokens(x: str) -> str:
    return rf"""flatten(list_transform(regexp_extract_all(trim(replace(lower(coalesce({x}, '')), 'ß', 'ss')), '[\p{{L}}\p{{N}}]+(?:[_./:-][\p{{L}}\p{{N}}]+)*'),
      lambda w: list_filter(CASE WHEN regexp_matches(w, '[_./:-]') THEN list_concat([w], regexp_split_to_array(w, '[_./:-]+')) ELSE [w] END, lambda q: q <> '' AND NOT list_contains({_STOPS}, q))))"""


_NORM = "trim(replace(lower(title), 'ß', 'ss'))"
_SCORE = f"""{DOCS},
f AS (SELECT id, 'title' AS f, 4.0 AS wt, {sql_tokens('title')} AS t FROM r UNION ALL SELECT id, 'body', 1.0, {sql_tokens('body')} FROM r),
a AS (SELECT f, greatest(1.0, avg(len(t))) AS av FROM f GROUP BY f),
q AS (SELECT unnest(['license', 'released']) AS term),
tf AS (SELECT id, f, wt, len(t) AS n, term, len(list_filter(t, lambda x: x = term)) AS tf FROM f, q),
df AS (SELECT term, count(DISTINCT id) AS df FROM tf WHERE tf > 0 GROUP BY term),
s AS (SELECT id, sum(wt * ln(1 + ((SELECT count(*) FROM r) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / av))) AS score, count(DISTINCT term) AS n_terms
  FROM tf JOIN df USING (term) JOIN a USING (f) WHERE tf > 0 GROUP BY id)"""


# ---- scans and predicates


@query(f"""WITH {DOCS} SELECT md5(CAST(id AS VARCHAR)) AS id, project_id, title, CAST(strlen(body) AS BIGINT) AS body_bytes, sha256(body) AS content_digest,
  array_to_string(list_filter([CASE WHEN id % 5 = 1 THEN 'kind' END, CASE WHEN id % 7 = 1 THEN 'worktree' END, CASE WHEN strlen(body) > {records.MAX_BYTES} THEN 'size' END], lambda x: x IS NOT NULL), ',') AS errors FROM r WHERE trim(title) <> ''""")
def scan_records(spark, d):
    """Each document as a record file: some of an unknown kind, some of a worktree that isn't named."""
    r = doc_records(spark, d).where("trim(title) <> ''")
    scope, kind = F.when(F.col("id") % 7 == 1, "worktree").otherwise("project"), F.when(F.col("id") % 5 == 1, "rumour").otherwise("result")
    head = F.to_json(F.struct(F.md5(F.col("id").cast("string")).alias("id"), "project_id", scope.alias("scope"), kind.alias("kind"), "title", F.lit("candidate").alias("status")))
    raw = r.select(F.col("id").cast("string").alias("path"), F.concat(F.lit("---json\n"), head, F.lit("\n---\n"), "body").alias("value"), F.octet_length("body").alias("n_bytes"))
    got = records.parse_records(raw, strict=False)
    return got.select("id", "project_id", "title", F.octet_length("body").cast("bigint").alias("body_bytes"), F.sha2("body", 256).alias("content_digest"), F.array_join("errors", ",").alias("errors"))


def scoped(spark, d):
    scope = F.when(F.col("id") % 3 == 0, "project").when(F.col("id") % 3 == 1, "worktree").otherwise("task")
    return doc_records(spark, d).withColumns({"scope": scope, "worktree_id": F.col("domain"), "task_id": (F.col("id") % 5).cast("string")})


@query(f"""WITH {DOCS} SELECT id, CASE id % 3 WHEN 0 THEN 'project' WHEN 1 THEN 'worktree' ELSE 'task' END AS scope FROM r
  WHERE project_id = 'src1' AND (id % 3 = 0 OR (domain = 'en' AND (id % 3 = 1 OR id % 5 = 2)))""")
def scope_visibility(spark, d):
    return scoped(spark, d).where(access.visible("src1", "en", "2")).select("id", "scope")


def labelled(spark, d):
    j = table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 0).alias("retired"), F.max(F.col("toxic") == 1).alias("withdrawn"))
    return lifecycle.overlay(doc_records(spark, d), j).withColumn("withdrawn", F.coalesce("withdrawn", F.lit(False)))


_LABELLED = f"{DOCS}, x AS (SELECT r.*, coalesce(quality = 0, false) AS retired, coalesce(toxic = 1, false) AS withdrawn FROM r LEFT JOIN labels ON doc_id = id)"


@query(f"WITH {_LABELLED} SELECT id, retired, withdrawn FROM x")
def overlay_join(spark, d):
    return labelled(spark, d).select("id", "retired", "withdrawn")


@query(f"WITH {_LABELLED} SELECT id, CASE WHEN withdrawn THEN 'withdrawn' WHEN retired THEN 'retired' ELSE 'active' END AS effective_status FROM x WHERE NOT withdrawn")
def status_filter(spark, d):
    status = F.when(F.col("withdrawn"), "withdrawn").otherwise(lifecycle.displayed_status(F.lit("active"), F.lit(AS_OF).cast("timestamp"), F.col("retired")))
    return labelled(spark, d).select("id", status.alias("effective_status")).where(F.col("effective_status").isin("active", "retired"))


# ---- lifecycle


def with_status(spark, d):
    return lifecycle.link_flags(order_records(spark, d)).withColumn("effective", lifecycle.effective_status(F.lit(AS_OF).cast("timestamp")))


@query(f"WITH {ORDERS} SELECT id, status, effective FROM e")
def effective_status_precedence(spark, d):
    return with_status(spark, d).select("id", "status", "effective")


@query(f"WITH {ORDERS} SELECT DISTINCT supersedes AS id FROM r WHERE supersedes IS NOT NULL")
def supersede_flag(spark, d):
    return with_status(spark, d).where("is_superseded").select("id")


@query(f"WITH {ORDERS} SELECT DISTINCT withdraws AS id FROM r WHERE withdraws IS NOT NULL")
def withdraw_flag(spark, d):
    return with_status(spark, d).where("is_withdrawn").select("id")


@query(f"WITH {ORDERS} SELECT id FROM e WHERE effective = 'expired'")
def expired_filter(spark, d):
    return with_status(spark, d).where("effective = 'expired'").select("id")


@query(f"""WITH {ORDERS} SELECT id, CASE WHEN effective = 'active' AND retired THEN 'retired' WHEN effective = 'candidate' AND created_at <= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN 'stale' ELSE effective END AS shown FROM e""")
def stale_candidates(spark, d):
    as_of = F.lit(AS_OF).cast("timestamp")
    return with_status(spark, d).select("id", lifecycle.displayed_status(F.col("effective"), as_of, F.col("retired"), touched=F.col("created_at")).alias("shown"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'F' THEN CASE WHEN o_orderpriority = '2-HIGH' THEN 'dreaming-reviewed' WHEN o_custkey % 3 = o_orderkey % 3 THEN 'self-reviewed' ELSE 'cross-session-reviewed' END
  WHEN o_orderkey % 7 = 0 THEN 'model-extracted' ELSE 'candidate' END AS assurance FROM orders""")
def assurance_label(spark, d):
    a = lifecycle.assurance(F.when(F.col("o_orderstatus") != "F", F.col("o_custkey") % 3), F.col("o_orderkey") % 3, F.when(F.col("o_orderpriority") == "2-HIGH", "dream:1").otherwise("k"), F.col("o_orderkey") % 7 == 0)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), a.alias("assurance"))


def journal(spark, d):
    return table(spark, d, "events").withColumns({"k": F.when(F.col("event_type") == "click", F.get_json_object("props", "$.k").cast("bigint")), "spent": F.when(F.col("event_type") == "purchase", F.col("value"))})


@query("""SELECT user_id, arg_max(CAST(json_extract(props, '$.k') AS BIGINT), (ts, event_id)) FILTER (event_type = 'click') AS k, arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase') AS spent,
  count(*) AS n_events, max(ts) AS touched_at FROM events GROUP BY user_id""")
def journal_fold_last_nonnull(spark, d):
    return lifecycle.fold_journal(journal(spark, d), "user_id", ["ts", "event_id"], ["k", "spent"])


@query("""WITH x AS (SELECT user_id, event_id, lag(md5(CAST(event_id AS VARCHAR)), 1, 'start') OVER (PARTITION BY user_id ORDER BY event_id) AS expected FROM events)
  SELECT user_id, event_id, expected FROM x WHERE event_id % 97 = 0 AND expected <> 'broken'""")
def journal_chain_gaps(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.md5(F.col("event_id").cast("string")).alias("digest"))
    before = F.coalesce(F.lag("digest").over(Window.partitionBy("user_id").orderBy("event_id")), F.lit("start"))
    e = e.withColumn("previous", F.when(F.col("event_id") % 97 == 0, "broken").otherwise(before))
    return lifecycle.chain_breaks(e, "user_id", "event_id", F.col("digest")).select("user_id", "event_id", "expected")


@query(f"""WITH {ORDERS} SELECT a.id, a.supersedes AS old, CASE WHEN b.status <> 'active' THEN 'not-active' ELSE 'qualifier' END AS reason
  FROM r a JOIN r b ON a.supersedes = b.id WHERE b.status <> 'active' OR a.kind <> b.kind""")
def edge_validation(spark, d):
    return lifecycle.edge_violations(order_records(spark, d), ["kind"])


@query("SELECT o_custkey AS old, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def successor_uniqueness(spark, d):
    return lifecycle.many_successors(table(spark, d, "orders").select(F.array("o_custkey").alias("supersedes")))


@query("""SELECT o_orderkey AS id, first_value(o_orderkey) OVER w AS root, row_number() OVER w - 1 AS depth, 'complete' AS status FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def supersede_chain(spark, d):
    return graph.chain_roots(order_records(spark, d).select("id", "parent"))


# ---- access


@query(f"""WITH {DOCS}, s AS (SELECT *, 'src' || CAST(id % 3 AS VARCHAR) AS w FROM r)
  SELECT id, project_id, false AS imported FROM s WHERE project_id = 'src1'
  UNION ALL SELECT id, project_id, true FROM s WHERE w = 'src1' AND ((project_id = 'src2' AND domain = 'en') OR project_id = 'src3')""")
def share_import_union(spark, d):
    edges = spark.createDataFrame([("src2", "src1", "en"), ("src3", "src1", None), ("src4", "src2", None)], "from string, to string, domain string")
    r = doc_records(spark, d).withColumn("share_with", F.array(F.concat(F.lit("src"), F.col("id") % 3)))
    return access.with_imports(r, edges, "src1").select("id", "project_id", "imported")


TOPICS = [("licensing", "Licences", ["released under", "licensed under the"], ["MIT", "Apache License"]), ("sales", "Sale", ["anble", "zu und"], ["price list"]), ("none", "Nothing here", [], ["x"])]


@query(f"""WITH {DOCS}, q AS (SELECT id, {_NORM} AS q, list_distinct({sql_tokens('title')}) AS terms FROM r),
t AS (SELECT * FROM (VALUES ('licensing', ['mit', 'apache', 'license'], ['licensing', 'Licences', 'released under', 'licensed under the']), ('sales', ['price', 'list'], ['sales', 'Sale', 'anble', 'zu und']), ('none', ['x'], ['none', 'Nothing here'])) v(topic_id, more, names)),
n AS (SELECT topic_id, more, alias, list_distinct({sql_tokens('alias')}) AS aterms FROM (SELECT topic_id, more, unnest(names) AS alias FROM t))
SELECT DISTINCT id AS query_id, topic_id, array_to_string(list_sort(list_filter(more, lambda m: NOT list_contains(terms, m))), ',') AS expansion
FROM q, n WHERE q <> '' AND (trim(lower(alias)) = q OR (len(aterms) > 0 AND len(list_filter(aterms, lambda x: NOT list_contains(terms, x))) = 0))""")
def route_expansion_theta_join(spark, d):
    topics = spark.createDataFrame(TOPICS, "topic_id string, title string, aliases array<string>, search_terms array<string>")
    got = access.route_matches(doc_records(spark, d).select(F.col("id").alias("query_id"), F.col("title").alias("query")), topics)
    return got.withColumn("expansion", F.array_join("expansion", ","))


@query(f"""WITH {DOCS}, s AS (SELECT *, 'file:///data/' || project_id || '/a b' || CAST(id % 7 AS VARCHAR) AS key FROM r), b AS (SELECT 'file:///data/src' || CAST(n_nationkey AS VARCHAR) || '/a b3' AS key FROM nation)
  SELECT id FROM s WHERE key NOT IN (SELECT key FROM b)""")
def disposition_anti_join(spark, d):
    r = doc_records(spark, d).withColumn("sources", F.array(F.struct(F.concat(F.lit("file://localhost/data/"), "project_id", F.lit("/a%20b"), F.col("id") % 7).alias("uri"))))
    bad = table(spark, d, "nation").select(F.array(F.concat(F.lit("file:///data/src"), F.col("n_nationkey"), F.lit("/a b3"))).alias("source_keys"), F.lit("*").alias("topic"))
    return access.usable(r, bad).select("id")


@query("""WITH p AS (SELECT c_custkey, '/' || r_name || '/' || n_name || '/' || CAST(c_custkey AS VARCHAR) AS path, r_name, n_name, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  SELECT path, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE r_name END AS project_id, CASE WHEN n_nationkey % 2 = 0 THEN '/' || r_name || '/' || n_name ELSE '/' || r_name END AS root, false AS ambiguous FROM p""")
def scope_longest_prefix(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    roots = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("root"), F.col("n_name").alias("id"))
    roots = roots.unionByName(table(spark, d, "region").select(F.concat(F.lit("/"), "r_name", F.lit("/")).alias("root"), F.col("r_name").alias("id")))
    paths = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name", F.lit("/"), F.col("c_custkey")).alias("path"))
    return access.resolve_roots(paths, roots).select("path", "project_id", "root", "ambiguous")


@query("""SELECT item_id AS ordinal, item_id * 37 AS id, doc_id IS NOT NULL AS found, source FROM benchmark LEFT JOIN documents ON doc_id = item_id * 37""")
def read_by_ids_missing(spark, d):
    ids = table(spark, d, "benchmark").select(F.col("item_id").alias("ordinal"), (F.col("item_id") * 37).alias("id"))
    return access.read_by_ids(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), ids).select("ordinal", "id", "found", "source")


# ---- ranking


def _terms(spark, d):
    return T.explode_tokens(T.spread(doc_records(spark, d)), F.col("body"), ["id"], "term")


_EXPLODED = f"{DOCS}, x AS (SELECT id, unnest({sql_tokens('body')}) AS term FROM r)"


@query(f"WITH {_EXPLODED} SELECT term, count(*) AS n FROM x GROUP BY term")
def tokens_explode(spark, d):
    return _terms(spark, d).groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH {_EXPLODED} SELECT term, count(DISTINCT id) AS df FROM x GROUP BY term")
def term_df(spark, d):
    once = T.explode_tokens(T.spread(doc_records(spark, d)), F.col("body"), ["id"], "term", distinct=True).distinct()
    return once.groupBy("term").agg(F.count("*").alias("df"))


@query(f"WITH {DOCS} SELECT greatest(1.0, avg(len({sql_tokens('title')}))) AS title_len, greatest(1.0, avg(len({sql_tokens('body')}))) AS body_len, count(*) AS n FROM r")
def field_lengths(spark, d):
    r = T.spread(doc_records(spark, d))
    n = r.agg(F.count("*").alias("n"))
    for c in ("title", "body"):
        n = n.crossJoin(T.explode_tokens(r, F.col(c), ["id"]).agg(F.count("*").alias(f"{c}_n")))  # rows of one
    mean = lambda c: F.greatest(F.lit(1.0), F.col(f"{c}_n") / F.col("n")).alias(f"{c}_len")
    return n.select(mean("title"), mean("body"), "n")


def scored(spark, d):
    return rank.bm25(doc_records(spark, d), QUERY.split(), {"title": F.col("title"), "body": F.col("body")})


@query(f"WITH {_SCORE} SELECT id, round(score, 4) AS score, n_terms FROM s")
def search_bm25(spark, d):
    return scored(spark, d).select("id", F.round("score", 4).alias("score"), F.size("hit_terms").cast("bigint").alias("n_terms"))


@query(f"WITH {_SCORE} SELECT id, round((score + CASE WHEN contains({_NORM}, 'released under') THEN 2.0 ELSE 0 END) * CASE WHEN domain = 'en' THEN 1.15 ELSE 1 END, 4) AS score FROM s JOIN r USING (id)")
def search_title_bonus(spark, d):
    return rank.boosted(scored(spark, d), "Released under", F.col("title"), F.col("domain"), "en", 4).select("id", "score")


@query(f"WITH {_SCORE} SELECT id, round(round(score, 6) * CASE WHEN id % 2 = 0 THEN 1.15 ELSE 1 END, 4) AS score FROM s")
def search_mode_boost(spark, d):
    got = scored(spark, d).withColumn("score", F.round("score", 6)).withColumn("task_modes", F.array(F.when(F.col("id") % 2 == 0, "research").otherwise("engineering")))
    return rank.mode_boosted(got, F.col("task_modes"), "research").select("id", F.round("score", 4).alias("score"))


_RANKED = f"""{_SCORE}, k AS (SELECT id, round(score, 4) AS score, row_number() OVER (ORDER BY round(score, 4) DESC, id % 4, {_NORM}, project_id, id) AS rank FROM s JOIN r USING (id))"""


def _page(spark, d, limit, offset):
    got = scored(spark, d).withColumns({"score": F.round("score", 4), "trust": F.col("id") % 4})
    return rank.page(got, [F.desc("score"), F.asc("trust"), *rank.relevance_order(F.col("title"))[1:]], limit, offset).select("id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_RANKED} SELECT id, score, rank FROM k WHERE rank <= 100")
def search_tie_break(spark, d):
    return _page(spark, d, 100, 0)


@query(f"WITH {_RANKED} SELECT id, score, rank FROM k WHERE rank > 20 AND rank <= 40")
def search_page_offset(spark, d):
    return _page(spark, d, 20, 20)


@query(f"WITH {DOCS}, k AS (SELECT id, title, row_number() OVER (ORDER BY {_NORM}, project_id, id) AS rank FROM r) SELECT id, title, rank FROM k WHERE rank <= 100")
def browse_order(spark, d):
    return rank.page(doc_records(spark, d), [T.normalized(F.col("title")).asc(), F.asc("project_id"), F.asc("id")], 100).select("id", "title", F.col("rank").cast("bigint").alias("rank"))


# ---- text


@query(f"""WITH {DOCS} SELECT id, CAST(strlen(body) AS BIGINT) AS body_bytes, strlen(body) > 1024 AS read_required, CASE WHEN strlen(body) <= 1024 THEN md5(body) END AS shown, CASE WHEN strlen(body) > 1024 THEN substr(body, 1, 360) END AS preview FROM r""")
def card_projection(spark, d):
    from .plans.search import card

    return doc_records(spark, d).select("id", *card()).select("id", F.col("body_bytes").cast("bigint").alias("body_bytes"), "read_required", F.md5("shown_body").alias("shown"), "preview")


@query(f"""WITH {DOCS}, b AS (SELECT id, title || chr(10) || 'Sources: ' || sha256(project_id) || ', notes/' || CAST(id AS VARCHAR) || chr(10) || 'Sources: ' || sha256(domain) AS body FROM r)
  SELECT id, array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: CASE WHEN NOT starts_with(x, 'Sources: ') THEN x
    WHEN len(list_filter(string_split(substr(x, 10), ','), lambda q: NOT regexp_matches(trim(q), '^[0-9a-fA-F]{{64}}$'))) = 0 THEN NULL
    ELSE 'Sources: ' || array_to_string(list_filter(list_transform(string_split(substr(x, 10), ','), lambda q: trim(q)), lambda q: NOT regexp_matches(q, '^[0-9a-fA-F]{{64}}$')), ', ') END), lambda x: x IS NOT NULL), chr(10)) AS shown FROM b""")
def semantic_body_strip(spark, d):
    body = F.concat("title", F.lit("\nSources: "), F.sha2("project_id", 256), F.lit(", notes/"), F.col("id"), F.lit("\nSources: "), F.sha2("domain", 256))
    return doc_records(spark, d).select("id", T.semantic_body(body).alias("shown"))


@query("""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)
  SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'file:///data x' || path WHEN 1 THEN 'file:///tmp' || path ELSE url END AS key, page_id % 3 = 1 AS volatile FROM p""")
def source_uri_parse(spark, d):
    """The path of each page as a file of a host, as a temporary file, or the page's own address."""
    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    uri = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("file://localhost/data%20x"), path)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("file:///tmp"), path)).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", T.source_key(uri).alias("key"), T.volatile_path(uri).alias("volatile"))


@query("SELECT doc_id AS id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in T.SECRET_CLASSES) + "], lambda x: x IS NOT NULL), ',') AS classes FROM documents")
def secret_scan(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_join(T.secret_classes(F.col("text")), ",").alias("classes"))


def _sql_redact(x):
    for tag in T.WRAPPER_TAGS:
        x = f"regexp_replace({x}, '(?s)<{tag}>.*?</{tag}>', '', 'g')"
    for p in (T.READER_SECRET, *[p for _, p in T.SECRET_CLASSES]):
        x = f"regexp_replace({x}, '{p}', '{T.REDACTED}', 'g')"
    return f"trim({x})"


@query(f"SELECT doc_id AS id, sha256({_sql_redact('text')}) AS digest FROM documents")
def redact_text(spark, d):
    return T.spread(table(spark, d, "documents")).select(F.col("doc_id").alias("id"), F.sha2(T.redact(F.col("text")), 256).alias("digest"))


# ---- relations, packing


@query(f"""WITH {ORDERS} SELECT id AS seed, parent AS other, 'out' AS direction FROM r WHERE status = 'active' AND parent IS NOT NULL
  UNION ALL SELECT b.id, a.id, 'in' FROM r a JOIN r b ON a.parent = b.id WHERE b.status = 'active'""")
def related_groups_one_hop(spark, d):
    r = order_records(spark, d).withColumn("id", F.col("id").cast("string"))
    r = r.withColumn("relations", F.when(F.col("parent").isNotNull(), F.array(F.struct(F.lit("supports").alias("type"), F.concat(F.lit("record:"), F.col("parent")).alias("uri")))).otherwise(F.expr("CAST(array() AS array<struct<type:string,uri:string>>)")))
    got = graph.related(r, r.where("status = 'active'").select("id"))
    return got.select(F.col("seed").cast("bigint").alias("seed"), F.col("id").cast("bigint").alias("other"), "direction")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'selected' ELSE 'background' END AS origin FROM orders")
def union_distinct_first_wins(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    got = report.first_wins([o.where("o_orderstatus = 'O'").select("id", F.lit("selected").alias("origin")), o.select("id", F.lit("background").alias("origin"))], ["id"])
    return got.select("id", "origin")


_GROUP = {"1-URGENT": "owner", "2-HIGH": "preference", "3-MEDIUM": "task", "4-NOT SPECIFIED": "background", "5-LOW": "background"}


@query("""WITH g AS (SELECT o_orderkey AS id, o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS grp FROM orders)
  SELECT id, grp, row_number() OVER (PARTITION BY o_custkey ORDER BY grp, id) AS place FROM g""")
def context_group_order(spark, d):
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in _GROUP.items() for x in kv])[F.col("o_orderpriority")], F.lit("background"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", views.group_order(kind).alias("grp"))
    return o.select("id", "grp", F.row_number().over(Window.partitionBy("o_custkey").orderBy("grp", "id")).cast("bigint").alias("place"))


@query("SELECT id, used FROM (SELECT doc_id AS id, CAST(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS used FROM documents) WHERE used <= 8000")
def byte_prefix_pack(spark, d):
    return report.prefix_pack(doc_records(spark, d), ["project_id"], [F.asc("id")], F.octet_length("body").cast("bigint"), 8000).select("id", "used")


# ---- transcripts and extraction


@query(rf"SELECT conv_id, turn, role, md5(text) AS digest FROM conversations WHERE role IN ('user', 'assistant') AND text <> '' AND NOT regexp_matches(text, '{T.READER_SECRET}')")
def transcript_role_filter(spark, d):
    """Each conversation as a session log: a header, then a line for each turn."""
    c = table(spark, d, "conversations")
    message = F.struct(F.lit("message").alias("type"), "role", F.array(F.struct(F.lit("input_text").alias("type"), "text")).alias("content"))
    turns = c.select(F.col("conv_id").cast("string").alias("path"), (F.col("turn") + 2).alias("line"), F.to_json(F.struct(F.lit("response_item").alias("type"), message.alias("payload"))).alias("raw"))
    header = F.struct(F.col("conv_id").cast("string").alias("id"), F.lit("1.0").alias("cli_version"), F.lit("cli").alias("source"))
    heads = c.select("conv_id").distinct().select(F.col("conv_id").cast("string").alias("path"), F.lit(1).cast("bigint").alias("line"), F.to_json(F.struct(F.lit("session_meta").alias("type"), header.alias("payload"))).alias("raw"))
    got = transcripts.decode(heads.unionByName(turns), "codex").where("text IS NOT NULL")
    return got.select(F.col("session").cast("bigint").alias("conv_id"), (F.col("line") - 2).alias("turn"), "role", F.md5("text").alias("digest"))


_LINE = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def _lines(spark, d):
    return table(spark, d, "lineitem").withColumn("digest", F.concat_ws("|", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"))


@query("""SELECT l_orderkey, l_linenumber, count(DISTINCT concat_ws('|', l_partkey, l_suppkey, l_returnflag, l_linestatus)) AS n_digests, count(*) AS n_rows FROM lineitem GROUP BY 1, 2
  HAVING count(DISTINCT concat_ws('|', l_partkey, l_suppkey, l_returnflag, l_linestatus)) > 1""")
def event_dedupe_conflicts(spark, d):
    return transcripts.dedupe(_lines(spark, d), ["l_orderkey", "l_linenumber"], _LINE, "digest")[1]


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_LINE)}) AS n FROM lineitem) WHERE n = 1")
def event_dedupe_first(spark, d):
    return transcripts.dedupe(_lines(spark, d), ["l_orderkey", "l_linenumber"], _LINE, "digest")[0].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events")
def forward_fill_session(spark, d):
    e = table(spark, d, "events").withColumn("seen", F.when(F.col("event_type") == "view", F.col("value")))
    return transcripts.forward_fill(e, "user_id", ["ts", "event_id"], "seen", "filled").select("event_id", "filled")


@query("SELECT conv_id, arg_max(turn, turn) AS leaf FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def default_leaf_argmax(spark, d):
    c = table(spark, d, "conversations").where("role <> 'system'")
    return transcripts.newest_leaf(c, "conv_id", "turn", ["turn"]).select("conv_id", "leaf")


@query("""WITH c AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p, min(turn) OVER (PARTITION BY conv_id) AS first, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS depth FROM conversations)
  SELECT conv_id || ':' || turn AS id, conv_id || ':' || first AS root, depth, 'complete' AS status FROM c""")
def ancestry_recursive(spark, d):
    c = table(spark, d, "conversations")
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = c.withColumn("p", before).select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.when(F.col("p").isNotNull(), F.concat_ws(":", "conv_id", "p")).alias("parent"))
    return graph.chain_roots(c)


def order_branches(spark, d) -> tuple[DataFrame, DataFrame]:
    """A customer's orders as a session: each follows the one before it, every fifth the one before that; some ancestors are missing or not
    recognized, some orders stand there twice with other parents. The leaf is the newest order, that of every ninth customer isn't known."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").withColumns({"p1": F.lag("o_orderkey").over(by), "p2": F.lag("o_orderkey", 2).over(by)})
    key, session = F.col("o_orderkey"), F.col("o_custkey").alias("session")
    parent = F.when(key % 97 == 0, -1 - key).when(key % 5 == 0, F.col("p2")).otherwise(F.col("p1"))
    nodes = o.select(session, key.alias("event_id"), parent.alias("parent"), (key % 83 != 0).alias("recognized"))
    twice = nodes.where("event_id % 89 = 0").withColumn("parent", F.col("event_id") + 1)
    leaf = o.groupBy(session).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("leaf"))
    how = F.when(F.col("session") % 2 == 0, "explicit").otherwise("default-leaf")
    return nodes.unionByName(twice), leaf.select("session", F.when(F.col("session") % 9 != 0, F.col("leaf")).alias("leaf"), how.alias("how"))


_BRANCHES = """WITH RECURSIVE p AS (SELECT *, lag(o_orderkey) OVER w AS p1, lag(o_orderkey, 2) OVER w AS p2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
n AS (SELECT o_custkey AS session, o_orderkey AS id, CASE WHEN o_orderkey % 97 = 0 THEN -1 - o_orderkey WHEN o_orderkey % 5 = 0 THEN p2 ELSE p1 END AS parent, o_orderkey % 83 <> 0 AND o_orderkey % 89 <> 0 AS ok FROM p),
f AS (SELECT o_custkey AS session, CASE WHEN o_custkey % 9 <> 0 THEN arg_max(o_orderkey, (o_orderdate, o_orderkey)) END AS leaf, CASE WHEN o_custkey % 2 = 0 THEN 'explicit' ELSE 'default-leaf' END AS how FROM orders GROUP BY o_custkey),
w AS (SELECT f.session, leaf, how, n.id, n.parent, n.ok, 0 AS up FROM f JOIN n ON n.session = f.session AND n.id = f.leaf
  UNION ALL SELECT w.session, leaf, how, n.id, n.parent, n.ok, up + 1 FROM w JOIN n ON n.session = w.session AND n.id = w.parent),
g AS (SELECT session, bool_and(ok) AND count_if(parent IS NULL) = 1 AS good, max(up) AS depth FROM w GROUP BY session)"""


@query(_BRANCHES + """ SELECT w.session, id AS event_id, leaf AS branch, how AS branch_selection, CASE WHEN how = 'default-leaf' THEN how END AS assurance, CAST(depth - up AS BIGINT) AS "at" FROM w JOIN g USING (session) WHERE good""")
def branch_selection(spark, d):
    return graph.branches(*order_branches(spark, d))[0]


@query(_BRANCHES + """ SELECT f.session, CASE WHEN leaf IS NULL THEN 'saved_branch_unverified' WHEN how = 'default-leaf' THEN 'active_branch_unverified' ELSE 'branch_ancestry_not_in_window' END AS reason
  FROM f LEFT JOIN g USING (session) WHERE good IS NOT TRUE""")
def branch_gaps(spark, d):
    return graph.branches(*order_branches(spark, d))[1]


@query("""WITH RECURSIVE p AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders),
w AS (SELECT o_orderkey AS id, prev, o_orderkey AS last, 0 AS depth, o_totalprice AS low, o_orderdate AS newest, o_orderstatus <> 'P' AS ok FROM p
  UNION ALL SELECT w.id, p.prev, p.o_orderkey, depth + 1, least(low, o_totalprice), greatest(newest, o_orderdate), ok AND o_orderstatus <> 'P' FROM w JOIN p ON p.o_orderkey = w.prev)
SELECT id, last AS root, 'complete' AS status, CAST(depth AS BIGINT) AS depth, low AS cheapest, newest, ok FROM w WHERE prev IS NULL""")
def path_aggregates(spark, d):
    """What each order's chain of earlier orders adds up to."""
    o = table(spark, d, "orders").withColumn("parent", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    nodes = o.select(F.col("o_orderkey").alias("id"), "parent", "o_totalprice", "o_orderdate", (F.col("o_orderstatus") != "P").alias("ok"))
    return graph.path_folds(nodes, {"cheapest": ("min", "o_totalprice"), "newest": ("max", "o_orderdate"), "ok": ("and", "ok")})[0]


def line_reads(spark, d) -> DataFrame:
    """Line items as reads of byte ranges: of three sources, most of them of one, in two attempts."""
    at = F.col("l_partkey") * 16 + F.col("l_suppkey") % 16
    source = F.when(F.col("l_linenumber") == 7, 2).when(F.col("l_linenumber") > 5, 1).otherwise(0)
    return table(spark, d, "lineitem").where("l_quantity <= 9").select(source.alias("source"), F.col("l_linestatus").alias("attempt"), at.alias("start"), (at + F.col("l_quantity").cast("bigint")).alias("end"), "l_orderkey", "l_linenumber")


_READS = """WITH r AS (SELECT CASE WHEN l_linenumber = 7 THEN 2 WHEN l_linenumber > 5 THEN 1 ELSE 0 END AS source, l_linestatus AS attempt, l_partkey * 16 + l_suppkey % 16 AS s, l_partkey * 16 + l_suppkey % 16 + CAST(l_quantity AS BIGINT) AS e FROM lineitem WHERE l_quantity <= 9),
b AS (SELECT *, max(e) OVER (PARTITION BY source, attempt ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r WHERE e > s),
i AS (SELECT *, count_if(reach IS NULL OR s > reach) OVER (PARTITION BY source, attempt ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM b),
c AS (SELECT source, attempt, min(s) AS s, max(e) AS e FROM i GROUP BY source, attempt, island)"""


@query(_READS + ' SELECT source, attempt, s AS start, e AS "end" FROM c')
def covered_ranges(spark, d):
    return scan.covered_ranges(line_reads(spark, d), ["source", "attempt"])


@query(_READS + """, m AS (SELECT o_orderkey, CAST(o_custkey % 3 AS INT) AS source, CASE WHEN o_orderkey % 2 = 0 THEN 'O' ELSE 'F' END AS attempt, o_orderkey * 2 AS s, o_orderkey * 2 + 1 + o_orderkey % 6 AS e FROM orders)
  SELECT m.source, m.attempt, m.s AS start, m.e AS "end", m.o_orderkey FROM m LEFT JOIN c ON c.source = m.source AND c.attempt = m.attempt AND c.s <= m.s AND m.e <= c.e WHERE c.source IS NULL""")
def uncovered_marks(spark, d):
    """Orders as marks of ranges that must have been read."""
    key = F.col("o_orderkey")
    marks = table(spark, d, "orders").select(key, (F.col("o_custkey") % 3).cast("int").alias("source"), F.when(key % 2 == 0, "O").otherwise("F").alias("attempt"), (key * 2).alias("start"), (key * 2 + 1 + key % 6).alias("end"))
    return scan.uncovered_marks(marks, covered_ranges(spark, d), ["source", "attempt"])


@query("""WITH m AS (SELECT doc_id AS key, CASE WHEN doc_id % 6 = 0 THEN 'seen' WHEN doc_id % 4 = 0 THEN 'pending-review' ELSE 'processed' END AS status FROM documents),
z AS (SELECT doc_id AS key, min(quality) AS was, max(toxic) AS now FROM labels GROUP BY doc_id), q AS (SELECT DISTINCT doc_id AS key FROM labels WHERE quality = 1),
x AS (SELECT m.key, status, CASE WHEN z.key IS NULL THEN 'unknown_key' WHEN status = 'seen' THEN 'unknown_status' WHEN was IS DISTINCT FROM now AND was = 0 THEN 'stale_dependency'
  WHEN status <> 'pending-review' AND q.key IS NULL THEN 'unserved_event' END AS reason FROM m LEFT JOIN z USING (key) LEFT JOIN q USING (key)) SELECT * FROM x WHERE reason IS NOT NULL""")
def coverage_mark_errors(spark, d):
    """Documents as marks of a review whose frozen events are the labelled ones; served are those of good quality."""
    key = F.col("doc_id").alias("key")
    marks = table(spark, d, "documents").select(key, F.when(F.col("doc_id") % 6 == 0, "seen").when(F.col("doc_id") % 4 == 0, "pending-review").otherwise("processed").alias("status"))
    labels = table(spark, d, "labels").groupBy(key).agg(F.min("quality").alias("was"), F.max("toxic").alias("now"))
    frozen = labels.select("key", F.when(F.col("was") == 0, F.col("was")).alias("revision"))
    return scan.mark_errors(marks, frozen, table(spark, d, "labels").where("quality = 1").select(key), labels.select("key", F.col("now").alias("revision")))


@query("""WITH s AS (SELECT o_orderkey, o_custkey % 40 AS batch, o_orderkey AS place, o_custkey % 60 AS source, o_totalprice, row_number() OVER (PARTITION BY o_custkey % 40, o_custkey % 60 ORDER BY o_orderkey) = 1 AS fresh FROM orders),
t AS (SELECT *, sum(CAST(o_totalprice AS BIGINT)) OVER w AS bytes, count(*) OVER w AS events, count_if(o_orderkey % 3 = 0) OVER w AS operations, count_if(fresh) OVER w AS sources FROM s WINDOW w AS (PARTITION BY batch ORDER BY place ROWS UNBOUNDED PRECEDING))
SELECT o_orderkey, batch, CASE WHEN bytes > 9000000 THEN 'bytes' WHEN events > 128 THEN 'events' WHEN operations > 32 THEN 'operations' WHEN sources > 2 THEN 'sources' END AS reason FROM t""")
def admission(spark, d):
    """Orders as pages waiting for a review: of a batch those that its bytes, events, operations and sources allow."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("batch"), (F.col("o_custkey") % 60).alias("source"), F.expr("bround(o_totalprice)").cast("bigint").alias("size"))
    budgets = {"bytes": (F.col("size"), 9_000_000), "events": (F.lit(1), 128), "operations": ((F.col("o_orderkey") % 3 == 0).cast("int"), 32)}
    return scan.admitted(o, ["batch"], ["o_orderkey"], budgets, F.col("source"), 2).select("o_orderkey", "batch", "reason")


def _line_items(spark, d):
    """Line items as files of folders, and as they were before: some altered, lost, new, or unreadable."""
    at = F.concat_ws("/", (F.col("l_suppkey") % 3).cast("string"), (F.col("l_orderkey") % 50).cast("string"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    rows = table(spark, d, "lineitem").select(at.alias("path"), F.md5(F.concat("l_partkey", F.lit(":"), "l_suppkey")).alias("digest"), "l_orderkey", "l_linenumber", "l_partkey")
    before = rows.where("l_orderkey % 997 <> 0").withColumn("digest", F.when(F.col("l_partkey") % 499 == 0, F.md5("digest")).otherwise(F.col("digest")))
    after = rows.where("l_orderkey % 991 <> 0").withColumn("digest", F.when(F.col("l_orderkey") % 1999 != 0, F.col("digest")))
    return before.select("path", "digest"), after.select("path", "digest")


_FOLDERS = """WITH r AS (SELECT l_suppkey % 3 || '/' || l_orderkey % 50 || '/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS path, l_suppkey % 3 || '/' || l_orderkey % 50 AS f2, CAST(l_suppkey % 3 AS VARCHAR) AS f1, md5(l_partkey || ':' || l_suppkey) AS digest, l_orderkey, l_partkey FROM lineitem),
b AS (SELECT path, f1, f2, CASE WHEN l_partkey % 499 = 0 THEN md5(digest) ELSE digest END AS digest FROM r WHERE l_orderkey % 997 <> 0), a AS (SELECT path, f1, f2, CASE WHEN l_orderkey % 1999 <> 0 THEN digest END AS digest FROM r WHERE l_orderkey % 991 <> 0),
c AS (SELECT coalesce(a.path, b.path) AS path, coalesce(a.f1, b.f1) AS f1, coalesce(a.f2, b.f2) AS f2, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' WHEN a.digest IS NULL THEN 'unverifiable' WHEN a.digest <> b.digest THEN 'stale' END AS state
  FROM a FULL JOIN b ON a.path = b.path),
p AS (SELECT path, 'file' AS kind, state, true AS deepest FROM c WHERE state IS NOT NULL),
u AS (SELECT f, bool_or(state = 'unverifiable') AS lost FROM (SELECT f1 AS f, state FROM c UNION ALL SELECT f2, state FROM c UNION ALL SELECT '', state FROM c) WHERE state IS NOT NULL GROUP BY f)"""


@query(_FOLDERS + " SELECT * FROM p UNION ALL SELECT f, 'folder', CASE WHEN lost THEN 'unverifiable' ELSE 'stale' END, false FROM u")
def snapshot_states(spark, d):
    """Which files, and which folders above them, are no longer what a snapshot holds."""
    before, after = _line_items(spark, d)
    return snapshots.snapshot_state(snapshots.folder_digests(before), snapshots.folder_digests(after))


_SHARDS = """WITH e AS (SELECT event_type, event_id, event_id || ' ' || user_id || ' ' || coalesce(props, '') AS t FROM events),
p AS (SELECT *, sum(strlen(t) + 1) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) - strlen(t) - 1 AS pos FROM e),
m AS (SELECT event_type, CAST(pos // 1024 AS BIGINT) AS place, sha256(string_agg(t, chr(10) ORDER BY event_id)) AS digest, count(*) AS n, CAST(sum(strlen(t) + 1) AS BIGINT) AS bytes FROM p GROUP BY event_type, pos // 1024)"""


def _event_shards(spark, d):
    text = F.concat_ws(" ", "event_id", "user_id", F.coalesce("props", F.lit("")))
    return snapshots.shards(table(spark, d, "events").withColumn("t", text), "event_type", "event_id", "t", 1024)


@query(_SHARDS + " SELECT * FROM m")
def shard_manifest(spark, d):
    return _event_shards(spark, d)[0]


@query(_SHARDS + """ SELECT event_type, place, digest, CASE substr(digest, 1, 1) WHEN '0' THEN 'lost' WHEN '1' THEN 'altered' ELSE 'repeated' END AS reason FROM m WHERE substr(digest, 1, 1) IN ('0', '1', '2')""")
def shard_verification(spark, d):
    """A store that lost, altered and repeated some shards, told by their digests."""
    manifest, stored = _event_shards(spark, d)
    kind = F.substring("digest", 1, 1)
    stored = stored.where(kind != "0").withColumn("body", F.when(kind == "1", F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return snapshots.shard_errors(manifest, stored.unionByName(stored.where(kind == "2")), "event_type")


@query("""WITH i AS (SELECT l_orderkey AS effect, l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS path, l_returnflag AS before, l_linestatus AS "after", CASE WHEN l_partkey % 7 = 0 THEN 'absent' WHEN l_partkey % 7 < 3 THEN l_linestatus WHEN l_partkey % 41 = 0 THEN 'other' ELSE l_returnflag END AS now FROM lineitem),
w AS (SELECT effect, path, CASE WHEN now = "after" THEN 'written' WHEN now = before THEN 'open' ELSE 'blocked' END AS w FROM i),
g AS (SELECT effect, count_if(w = 'open') AS o, count_if(w = 'written') AS d, min(path) FILTER (w = 'blocked') AS b, effect % 11 = 0 AS r FROM w GROUP BY effect)
SELECT effect, CASE WHEN r THEN 'received' WHEN b IS NOT NULL THEN 'blocked' WHEN o = 0 THEN 'written' WHEN d > 0 THEN 'partial' ELSE 'intended' END AS state, CAST(CASE WHEN r THEN 0 ELSE o END AS BIGINT) AS to_write, CASE WHEN NOT r THEN b END AS blocked_by FROM g""")
def effect_recovery(spark, d):
    """Line items as the writes of an order's effect, at whatever point each was broken off."""
    path = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("path")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("effect"), path, F.col("l_returnflag").alias("before"), F.col("l_linestatus").alias("after"), "l_partkey")
    now = F.when(F.col("l_partkey") % 7 < 3, F.col("after")).when(F.col("l_partkey") % 41 == 0, "other").otherwise(F.col("before"))
    current = rows.where("l_partkey % 7 <> 0").select("path", now.alias("digest"))
    receipts = table(spark, d, "orders").where("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("effect"))
    return effects.effect_states(rows.drop("l_partkey"), current, receipts)


@query("""WITH RECURSIVE n AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER w AS p1, lag(o_orderkey, 3) OVER w AS p2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
e AS (SELECT id AS src, CASE WHEN id % 101 = 7 THEN -1 - id ELSE p1 END AS dst FROM n WHERE id % 3 <> 0 UNION SELECT id, p2 FROM n), k AS (SELECT * FROM e WHERE dst IS NOT NULL),
w AS (SELECT id, 0 AS layer FROM n UNION ALL SELECT src, layer + 1 FROM w JOIN k ON dst = w.id), x AS (SELECT id, max(layer) AS layer FROM w GROUP BY id),
lost AS (SELECT src AS id FROM k WHERE dst < 0 UNION SELECT src FROM lost JOIN k ON dst = lost.id)
SELECT x.id, CASE WHEN lost.id IS NULL THEN CAST(layer AS INT) ELSE -1 END AS layer FROM x LEFT JOIN lost USING (id)""")
def operation_layers(spark, d):
    """Orders as operations of a draft that refer to earlier ones of their customer; some refer to one that isn't there."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    n = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(by).alias("p1"), F.lag("o_orderkey", 3).over(by).alias("p2"))
    near = n.where("id % 3 <> 0").select(F.col("id").alias("src"), F.when(F.col("id") % 101 == 7, -1 - F.col("id")).otherwise(F.col("p1")).alias("dst"))
    edges = near.unionByName(n.select(F.col("id").alias("src"), F.col("p2").alias("dst"))).where("dst IS NOT NULL")
    return effects.layers(n, edges).select("id", F.coalesce("layer", F.lit(-1)).alias("layer"))


def _references(spark, d):
    """Line items refer to parts (events, some derived) or to orders (records); an order rests on the one before it of its customer, and on a part."""
    line = table(spark, d, "lineitem")
    refs = line.select(F.col("l_orderkey").alias("owner"), F.when(F.col("l_linenumber") < 4, F.concat(F.lit("p"), "l_partkey")).when(F.col("l_linenumber") < 7, F.concat(F.lit("record:"), F.col("l_orderkey") + 3)).otherwise("page:1").alias("ref")).distinct()
    events = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("key"), F.when(F.col("p_partkey") % 61 == 0, "derivative").otherwise("public-message").alias("evidence"), (F.col("p_partkey") % 13 != 0).alias("branch_verified"), (F.col("p_partkey") % 17 == 0).alias("forbidden"))
    o = table(spark, d, "orders").withColumn("prev", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    level = F.when(F.col("o_orderpriority") == "1-URGENT", "hypothesis").when(F.col("o_orderpriority") == "5-LOW", "report")
    records = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "stale").otherwise("active").alias("effective_status"), (F.col("o_custkey") % 19 != 0).alias("usable"), level.alias("level"))
    name = F.concat(F.lit("record:"), "o_orderkey").alias("src")
    rests = o.where("prev IS NOT NULL AND o_orderkey % 2 = 0").select(name, F.concat(F.lit("record:"), "prev").alias("dst"))
    rests = rests.unionByName(o.where("o_orderkey % 53 = 0").select(name, F.concat(F.lit("p"), F.col("o_custkey") % 150).alias("dst"))).unionByName(o.where("o_orderkey % 71 = 0").select(name, name.alias("dst")))
    return refs, events, records, records.where("false"), rests


_REFERENCES = """WITH RECURSIVE x AS (SELECT DISTINCT l_orderkey AS owner, CASE WHEN l_linenumber < 4 THEN 'p' || l_partkey WHEN l_linenumber < 7 THEN 'record:' || (l_orderkey + 3) ELSE 'page:1' END AS ref FROM lineitem),
o AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders),
k AS (SELECT 'p' || p_partkey AS name, 'event' AS kind, CAST(NULL AS VARCHAR) AS level, true AS active, p_partkey % 17 = 0 AS forbidden, p_partkey % 13 <> 0 AS verified, p_partkey % 61 = 0 AS derived FROM part
  UNION ALL SELECT 'record:' || o_orderkey, 'record', CASE o_orderpriority WHEN '1-URGENT' THEN 'hypothesis' WHEN '5-LOW' THEN 'report' END, o_orderstatus <> 'P', o_custkey % 19 = 0, true, false FROM orders),
e AS (SELECT 'record:' || o_orderkey AS src, 'record:' || prev AS dst FROM o WHERE prev IS NOT NULL AND o_orderkey % 2 = 0 UNION ALL SELECT 'record:' || o_orderkey, 'p' || (o_custkey % 150) FROM o WHERE o_orderkey % 53 = 0),
t AS (SELECT name AS id FROM k WHERE derived UNION SELECT src FROM t JOIN e ON dst = t.id),
c AS (SELECT 'record:' || o_orderkey AS id FROM orders WHERE o_orderkey % 71 = 0 UNION SELECT src FROM c JOIN e ON dst = c.id),
r AS (SELECT owner, ref, kind, level, CASE WHEN kind IS NULL THEN 'unverifiable_source' WHEN forbidden THEN 'source_forbidden' WHEN t.id IS NOT NULL THEN 'derivative_only' WHEN NOT verified THEN 'unverified_branch' WHEN NOT active THEN 'dependency_inactive'
  WHEN c.id IS NOT NULL THEN 'cyclic_reference' END AS reason FROM x LEFT JOIN k ON name = ref LEFT JOIN t ON t.id = ref LEFT JOIN c ON c.id = ref)"""


@query(_REFERENCES + " SELECT * FROM r")
def evidence_references(spark, d):
    return evidence.resolve_references(*_references(spark, d))


@query(_REFERENCES + """ SELECT owner, count(*) AS n_refs, count(*) FILTER (WHERE reason <> 'source_forbidden') AS n_missing_refs, count(*) FILTER (WHERE reason = 'source_forbidden') AS n_prohibited,
  CASE WHEN bool_or(level = 'hypothesis') THEN 'hypothesis' WHEN bool_or(level = 'report') THEN 'report' END AS evidence_type FROM r GROUP BY owner""")
def evidence_totals(spark, d):
    return evidence.evidence_counts(evidence.resolve_references(*_references(spark, d)))


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, turn, role, {_sql_redact('text')} AS x FROM conversations WHERE role <> 'system'),
l AS (SELECT conv_id, turn, CAST(least(600, strlen('[L' || turn || '] ' || role || ': ' || x || chr(10))) AS BIGINT) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM t WHERE x <> ''),
g AS (SELECT conv_id, rn, turn, s, 1 AS w, s AS used FROM l WHERE rn = 1 UNION ALL
  SELECT l.conv_id, l.rn, l.turn, l.s, CASE WHEN used + l.s > 600 THEN w + 1 ELSE w END, CASE WHEN used + l.s > 600 THEN l.s ELSE used + l.s END FROM g JOIN l ON l.conv_id = g.conv_id AND l.rn = g.rn + 1)
SELECT conv_id, CAST(w AS BIGINT) AS "window", CAST(min(turn) AS BIGINT) AS first, CAST(max(turn) AS BIGINT) AS last, count(*) AS n, CAST(sum(s) AS BIGINT) AS bytes FROM g GROUP BY conv_id, w""")
def greedy_windows(spark, d):
    return extract.greedy_windows(table(spark, d, "conversations").where("role <> 'system'"), "conv_id", "turn", 600)


@query("""WITH RECURSIVE e AS (SELECT event_id, event_type, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS sec FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY sec, event_id) AS i FROM e),
g AS (SELECT event_type, event_id, sec, i, true AS spawned, sec AS since FROM n WHERE i = 1 UNION ALL
  SELECT n.event_type, n.event_id, n.sec, n.i, n.sec >= since + 14400, CASE WHEN n.sec >= since + 14400 THEN n.sec ELSE since END FROM g JOIN n ON n.event_type = g.event_type AND n.i = g.i + 1)
SELECT event_type, event_id, sec AS "at", spawned, CASE WHEN NOT spawned THEN since + 14400 - sec ELSE 0 END AS next_after FROM g""")
def spawn_cooldown(spark, d):
    """Events as triggers: which of them start an extraction, if one start of a type holds off others for four hours."""
    e = table(spark, d, "events").select("event_id", "event_type", F.unix_timestamp(F.date_trunc("second", "ts")).alias("at"))
    return extract.cooled(e, "event_type", "at", "event_id", 14_400).withColumn("next_after", F.coalesce("next_after", F.lit(0)))


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM y GROUP BY user_id, s""")
def idle_sessions(spark, d):
    e = table(spark, d, "events")
    return streams.closed_sessions(e, "user_id", "ts", "1 hour", "0 seconds")


def _listing(spark, d):
    listing = table(spark, d, "events").groupBy(F.col("user_id").alias("path")).agg(F.max("ts").alias("mtime"), F.count("*").alias("size"))
    state = F.when(F.col("path") % 5 == 0, "extracted").when(F.col("path") % 5 == 1, "leased").when(F.col("path") % 5 == 2, "failed")
    epoch = F.unix_timestamp(F.lit("2024-01-31").cast("timestamp"))
    jobs = listing.select("path", state.alias("state"), (F.col("size") - F.col("path") % 2).alias("size"), (epoch + (F.col("path") % 3 - 1) * 100).alias("lease_until"), (epoch + (F.col("path") % 4 - 1) * 100).alias("next_attempt")).where("state IS NOT NULL")
    return listing, jobs


_JOBS = """l AS (SELECT user_id AS path, max(ts) AS mtime, count(*) AS size FROM events GROUP BY 1),
j AS (SELECT path, CASE path % 5 WHEN 0 THEN 'extracted' WHEN 1 THEN 'leased' ELSE 'failed' END AS state, size - path % 2 AS jsize, path % 3 - 1 AS lease, path % 4 - 1 AS retry FROM l WHERE path % 5 < 3),
i AS (SELECT * FROM l WHERE mtime <= TIMESTAMP '2024-01-31' - INTERVAL 1 HOUR AND mtime >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY)"""


@query(f"""WITH {_JOBS}, k AS (SELECT path, mtime, size FROM i LEFT JOIN j USING (path) WHERE state IS NULL OR (state = 'extracted' AND size > jsize) OR (state = 'leased' AND lease <= 0) OR (state = 'failed' AND retry <= 0))
  SELECT path, mtime, size FROM k ORDER BY mtime DESC, path LIMIT 10""")
def claim_topn(spark, d):
    listing, jobs = _listing(spark, d)
    return extract.due(listing, jobs, F.lit("2024-01-31").cast("timestamp"), 10)


@query(f"WITH {_JOBS}, m AS (SELECT path FROM l WHERE mtime <= TIMESTAMP '2024-01-31' - INTERVAL 1 HOUR) SELECT coalesce(state, 'eligible') AS state, count(*) AS n FROM m FULL JOIN j USING (path) GROUP BY 1")
def extraction_status(spark, d):
    listing, jobs = _listing(spark, d)
    return extract.job_status(listing, jobs, F.lit("2024-01-31").cast("timestamp"))


@query("SELECT o_orderkey AS id, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) + least(86400, 3600 * CAST(2 ** (o_orderkey % 7) AS BIGINT)) AS next_attempt FROM orders")
def backoff_schedule(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("failed_at"), (F.col("o_orderkey") % 7 + 1).alias("attempts"))
    return extract.next_attempts(o).select("id", "next_attempt")


# ---- review state


def _looks(spark, d):
    o = table(spark, d, "orders")
    old, day = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"), F.col("o_orderdate") >= F.lit("1995-06-01").cast("timestamp")
    digest = lambda c: F.concat_ws(":", F.count_if(c), F.sum(F.when(c, F.col("o_orderkey"))))
    before = o.where(old).groupBy(F.col("o_custkey").alias("source_id")).agg(F.count("*").alias("size"), digest(F.lit(True)).alias("digest"))
    return before, o.where(day).groupBy(F.col("o_custkey").alias("source_id")).agg(F.count("*").alias("size"), digest(F.lit(True)).alias("digest"), digest(old).alias("prefix_digest"))


_LOOKS = """b AS (SELECT o_custkey AS source_id, count(*) AS size, concat_ws(':', count(*), sum(o_orderkey)) AS digest FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1),
n AS (SELECT o_custkey AS source_id, count(*) AS size, concat_ws(':', count(*), sum(o_orderkey)) AS digest, concat_ws(':', count(*) FILTER (o_orderdate < TIMESTAMP '1998-01-01'), sum(o_orderkey) FILTER (o_orderdate < TIMESTAMP '1998-01-01')) AS prefix
  FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01' GROUP BY 1)"""


@query(f"""WITH {_LOOKS} SELECT source_id, CASE WHEN b.digest IS NULL THEN 'added' WHEN n.digest IS NULL THEN 'unavailable' WHEN n.digest = b.digest THEN 'unchanged'
  WHEN n.size > b.size AND n.prefix = b.digest THEN 'appended' ELSE 'modified' END AS change FROM b FULL JOIN n USING (source_id)""")
def change_set_full_outer(spark, d):
    return review.changes(*_looks(spark, d))


def _positions(spark, d):
    before, now = _looks(spark, d)
    inventory = now.select("source_id", F.col("size").alias("cutoff"))
    return review.carry_positions(inventory, before.select("source_id", F.col("size").alias("reviewed_offset"), F.lit("incomplete").alias("status")))


_POSITIONS = f"""{_LOOKS}, c AS (SELECT source_id, n.size AS cutoff, least(coalesce(b.size, 0), n.size) AS reviewed_offset,
  CASE WHEN b.size > n.size THEN 'source_changed' WHEN coalesce(b.size, 0) >= n.size THEN 'reviewed' WHEN b.size > 0 THEN 'incomplete' ELSE 'new' END AS status FROM n LEFT JOIN b USING (source_id))"""


@query(f"WITH {_POSITIONS} SELECT * FROM c")
def positions_carry(spark, d):
    return _positions(spark, d)


def _committed(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") % 12).cast("bigint").alias("end_offset"), F.lit(5).alias("n_events"), (5 - (F.col("c_custkey") % 4 == 0).cast("int")).alias("n_reviewed"), (F.col("c_custkey") % 9 == 0).cast("int").alias("n_open_gaps"))
    return review.commit_positions(_positions(spark, d), c)


_COMMITTED = f"""{_POSITIONS}, m AS (SELECT source_id, cutoff, status, source_id % 9 = 0 AS gap, CASE WHEN source_id % 4 <> 0 AND source_id % 9 <> 0 THEN greatest(reviewed_offset, source_id % 12) ELSE reviewed_offset END AS reviewed_offset FROM c),
z AS (SELECT source_id, cutoff, reviewed_offset, CASE WHEN reviewed_offset >= cutoff THEN 'reviewed' WHEN gap THEN 'stalled' ELSE status END AS status FROM m)"""


@query(f"WITH {_COMMITTED} SELECT * FROM z")
def positions_commit(spark, d):
    return _committed(spark, d)


@query(f"""WITH {_COMMITTED} SELECT count(*) AS n_sources, count(*) FILTER (status = 'reviewed') AS n_done, count(*) FILTER (status = 'stalled') AS n_stalled, CAST(sum(reviewed_offset) AS BIGINT) AS bytes_reviewed,
  CAST(sum(cutoff) AS BIGINT) AS bytes_total, bool_and(status = 'reviewed') AS complete FROM z""")
def objective_rollup(spark, d):
    return review.rollup(_committed(spark, d))


@query("""WITH RECURSIVE x AS (SELECT o_custkey AS source_id, o_orderkey % 50 AS off, CASE WHEN o_orderstatus = 'F' THEN 'reviewed' ELSE 'incomplete' END AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
  g AS (SELECT source_id, n, off, status FROM x WHERE n = 1 UNION ALL SELECT x.source_id, x.n, CASE WHEN x.off < g.off OR (g.status = 'reviewed' AND x.status <> 'reviewed') THEN x.off ELSE g.off END,
    CASE WHEN x.off < g.off OR (g.status = 'reviewed' AND x.status <> 'reviewed') THEN x.status ELSE g.status END FROM g JOIN x ON x.source_id = g.source_id AND x.n = g.n + 1)
  SELECT source_id, off AS reviewed_offset, status FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC) AS k FROM g) WHERE k = 1""")
def positions_merge(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 50).alias("reviewed_offset"), F.when(F.col("o_orderstatus") == "F", "reviewed").otherwise("incomplete").alias("status"))
    return review.merge_positions(o)


# ---- reports


@query("""WITH x AS (SELECT o_orderpriority AS kind, o_orderstatus AS status, o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AS made FROM orders)
  SELECT 'kind' AS dimension, kind AS value, count(*) AS n, count(*) FILTER (made) AS n_created FROM x GROUP BY kind UNION ALL SELECT 'status', status, count(*), count(*) FILTER (made) FROM x GROUP BY status
  UNION ALL SELECT 'all', 'all', count(*), count(*) FILTER (made) FROM x""")
def lifecycle_report_grouping_sets(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return report.lifecycle_report(o, ["kind", "status"], F.col("at"), "1996-01-01", "1997-01-01")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def created_in_window(spark, d):
    o = table(spark, d, "orders")
    return report.created_in(o, F.col("o_orderdate"), "1996-01-01", "1997-01-01").select(F.col("o_orderkey").alias("id"))


_DUPLICATES = rf"""{DOCS}, t AS (SELECT id, trim(regexp_replace(replace(lower(title), 'ß', 'ss'), '\s+', ' ', 'g')) AS norm_title FROM r)"""


@query(f"WITH {_DUPLICATES} SELECT norm_title, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM t GROUP BY norm_title HAVING count(*) > 1")
def duplicate_titles(spark, d):
    return review.duplicate_titles(doc_records(spark, d)).withColumn("ids", F.array_join("ids", ","))


@query(f"""WITH {ORDERS}, x AS (SELECT 0 AS section, 'record:' || id AS ref, 'candidate' AS reason, CAST(epoch(created_at) AS BIGINT) AS sort_key FROM e WHERE effective = 'candidate'
  UNION ALL SELECT 1, 'record:' || id, 'expired-active', CAST(epoch(created_at) AS BIGINT) FROM e WHERE status = 'active' AND effective = 'expired')
  SELECT section, ref, reason, sort_key FROM x ORDER BY section, sort_key, ref LIMIT 64""")
def maintenance_inventory_union(spark, d):
    e = with_status(spark, d).select(F.concat(F.lit("record:"), F.col("id")).alias("ref"), "status", "effective", F.unix_timestamp("created_at").alias("sort_key"))
    parts = [e.where("effective = 'candidate'").withColumn("reason", F.lit("candidate")), e.where("status = 'active' AND effective = 'expired'").withColumn("reason", F.lit("expired-active"))]
    return review.inventory(parts, 64)[0].select("section", "ref", "reason", "sort_key")


@query("SELECT id FROM (SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n > 3")
def keep_newest_n(spark, d):
    return report.keep_newest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select(F.col("o_orderkey").alias("id"))


@query("""SELECT user_id, count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 14) AS HUGEINT)) AS VARCHAR) AS low, CAST(sum(CAST('0x' || substr(h, 15, 14) AS HUGEINT)) AS VARCHAR) AS high
  FROM (SELECT user_id, sha256(event_type || ':' || event_id) AS h FROM events) GROUP BY user_id""")
def fingerprint_multiset(spark, d):
    got = report.multiset_fingerprint(table(spark, d, "events"), ["user_id"], F.concat_ws(":", "event_type", "event_id"))
    return got.select("user_id", "n", F.col("low").cast("string").alias("low"), F.col("high").cast("string").alias("high"))


@query(f"""WITH {DOCS}, s AS (SELECT id, 'file:///data/' || project_id || '/' || CAST(id % 11 AS VARCHAR) AS uri FROM r), f AS (SELECT 'file:///data/src' || CAST(n_nationkey AS VARCHAR) || '/' || CAST(k AS VARCHAR) AS uri FROM nation, range(0, 9) t(k))
  SELECT id, uri FROM s WHERE uri NOT IN (SELECT uri FROM f)""")
def missing_source_files(spark, d):
    r = doc_records(spark, d).withColumn("sources", F.array(F.struct(F.concat(F.lit("file:///data/"), "project_id", F.lit("/"), F.col("id") % 11).alias("uri"))))
    files = table(spark, d, "nation").select(F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"), "n_nationkey").select(F.concat(F.lit("file:///data/src"), F.col("n_nationkey"), F.lit("/"), F.col("k")).alias("uri"))
    return review.missing_sources(r, files)


# ---- preferences and views


def _claims(spark, d):
    state = F.when(F.col("event_type") == "click", "candidate").when(F.col("event_type") == "purchase", "active").when(F.col("event_type") == "error", "withdrawn")
    return table(spark, d, "events").select(F.col("user_id").alias("record_id"), F.col("event_id").alias("seq"), state.alias("state"), F.when(F.col("event_type") == "view", F.col("value") > 10).alias("retired"))


_CLAIMS = """c AS (SELECT user_id AS record_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'candidate' WHEN 'purchase' THEN 'active' WHEN 'error' THEN 'withdrawn' END AS state, CASE WHEN event_type = 'view' THEN value > 10 END AS retired FROM events)"""


@query(f"""WITH {_CLAIMS}, f AS (SELECT record_id, arg_max(state, seq) FILTER (state IS NOT NULL) AS state, coalesce(arg_max(retired, seq) FILTER (retired IS NOT NULL), false) AS retired FROM c GROUP BY 1)
  SELECT record_id, CASE WHEN record_id % 10 = 0 THEN 'superseded' WHEN state = 'active' AND retired THEN 'retired' ELSE state END AS shown FROM f""")
def preference_state(spark, d):
    return preferences.fold(_claims(spark, d)).select("record_id", preferences.displayed(F.col("state"), F.col("retired"), F.col("record_id") % 10 == 0).alias("shown"))


@query(f"""WITH {_CLAIMS}, b AS (SELECT record_id, seq, state, coalesce(lag(state) OVER (PARTITION BY record_id ORDER BY seq), 'start') AS before FROM c WHERE state IS NOT NULL)
  SELECT record_id, seq, before, state FROM b WHERE (before, state) NOT IN (('start', 'candidate'), ('candidate', 'active'), ('active', 'withdrawn'))""")
def preference_transitions(spark, d):
    return preferences.illegal_transitions(_claims(spark, d))


@query(f"""WITH {ORDERS} SELECT a.id, EXISTS (SELECT 1 FROM r b WHERE b.parent = a.id AND b.kind = a.kind) AS is_replaced FROM r a""")
def narrative_replaced(spark, d):
    r = order_records(spark, d).withColumn("replaces", F.when(F.col("parent").isNotNull(), F.array(F.concat(F.lit("record:"), "parent"))).otherwise(F.array().cast("array<string>")))
    return views.replaced(r, ["kind"]).select("id", "is_replaced")


@query("""WITH b AS (SELECT o_orderkey AS unit, o_custkey AS source_id, o_totalprice > 200000 AS moved FROM orders), s AS (SELECT c_custkey AS source_id FROM customer WHERE c_mktsegment <> 'BUILDING')
  SELECT CAST(unit AS VARCHAR) AS unit, CASE WHEN s.source_id IS NULL THEN 'unavailable' WHEN moved THEN 'needs-check' ELSE 'as-of' END AS label FROM b LEFT JOIN s USING (source_id)""")
def unit_freshness(spark, d):
    u = table(spark, d, "orders").select(F.lit("v").alias("view"), F.col("o_orderkey").cast("string").alias("unit"), F.array(F.struct(F.col("o_custkey").cast("string").alias("source_id"), F.when(F.col("o_totalprice") > 200000, "old").otherwise("d").alias("digest"))).alias("bindings"))
    s = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").cast("string").alias("source_id"), F.lit("d").alias("digest"))
    return views.freshness(u, s).select("unit", "label")
