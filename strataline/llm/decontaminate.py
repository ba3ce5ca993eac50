"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, ascii_lower, pick

#: What stands between words once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows of the benchmark that are broadcast at most (about 300 bytes each); more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000


def word_array(text):
    """The words of a text, an empty array for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BETWEEN), ""), F.array().cast("array<string>"))


def benchmark_windows(bench: DataFrame, size: int) -> DataFrame:
    """(item, win, wtxt): runs of ``size`` consecutive item words; an item of fewer words is one window."""
    words = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), word_array(F.col("text")).alias("w")).where(F.size("w") > 0)
    win = words.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))).alias("s"))
    win = win.select("item", F.slice("w", F.col("s"), size).alias("win"))
    return win.select("item", "win", F.array_join("win", " ").alias("wtxt")).distinct()


def window_hits(docs: DataFrame, bench: DataFrame, size: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Where windows of the benchmark occur: hits(doc_id, th, start, len, wtxt) and items(wtxt, item).

    All words of a window must be in a document, so the necessary prefix of a window is its rarest word,
    by counts over all documents (a window with a word that no document has is out). Documents' words
    meet only those prefix words; position and length bounds place the window, and equality with the
    document's words at that place decides.
    """
    windows = scratch.table(benchmark_windows(bench, size), "windows")
    distinct = windows.select("wtxt", "win").distinct()
    tokens = distinct.select("wtxt", "win", F.posexplode("win").alias("off", "word"))
    small = distinct.count() <= BROADCAST_WINDOWS
    near = F.broadcast if small else (lambda t: t)
    tokens = tokens.withColumn("h", F.xxhash64("word"))  # joins on a long; the words themselves are compared in the end
    counts = docs.select(F.explode(word_array(F.col("text"))).alias("word")).select(F.xxhash64("word").alias("h"))
    counts = scratch.table(counts.join(near(tokens.select("h").distinct()), "h").groupBy("h").count(), "counts")
    rare = tokens.join(counts, "h", "left").groupBy("wtxt", "win").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "h", "off")).alias("low"))
    prefix = rare.where("low.n > 0").select("low.h", "low.off", F.size("win").alias("len"), "win", "wtxt")
    prefix = scratch.table(prefix, "prefix")
    # explode(array(x)) keeps the optimizer from splitting each text twice, once for w and once for its positions
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.explode(F.array(word_array(F.col("text")))).alias("w"))
    at = rows.select("doc_id", "th", "w", F.posexplode("w").alias("pos", "word")).withColumn("h", F.xxhash64("word"))
    if small:
        met = at.join(F.broadcast(prefix), "h").where("pos >= off AND pos - off + len <= size(w)").where("slice(w, pos - off + 1, len) = win")
    else:  # the words around travel instead of the whole document
        around = F.slice("w", F.greatest(F.lit(1), F.col("pos") + 2 - size), F.least(F.col("pos") + 1, F.lit(size)) + (size - 1))
        at = at.select("doc_id", "th", "pos", "h", F.size("w").alias("n"), around.alias("c"), F.greatest(F.lit(0), F.col("pos") + 1 - size).alias("c0"))
        met = at.join(prefix, "h").where("pos >= off AND pos - off + len <= n").where("slice(c, pos - off - c0 + 1, len) = win")
    return met.select("doc_id", "th", (F.col("pos") - F.col("off")).alias("start"), "len", "wtxt"), windows.select("wtxt", "item")


def contamination(docs: DataFrame, bench: DataFrame, size: int = 10) -> DataFrame:
    """The rows of docs (all their columns) with n_words, n_hit, spans, items and contaminated.

    A document word inside any occurrence of a window of the benchmark is hit. ``spans`` holds the merged
    hit ranges (start, end exclusive, in words), ``items`` the sorted ids (as strings) of the items whose
    windows occur. Null or word-less texts have no words and no hits; a null item_id counts as the id ''.
    Repeated rows each get their own result; repeated doc_ids with other texts are told apart by the text.
    Empty tables give no hits or no rows. Columns of docs named like a result are replaced by it.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    hits, items = window_hits(pick(docs, "doc_id", "text"), pick(bench, "item_id", "text"), size, scratch)
    hits = scratch.table(hits, "hits")
    # Hits of a document in the order of their starts (as many as it has words, at most): a gap begins another span.
    each = hits.groupBy("doc_id", "th", "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
    order = Window.partitionBy("doc_id", "th").orderBy("start")
    gap = F.coalesce(F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    each = each.withColumn("gap", gap.cast("int")).withColumn("span", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = each.groupBy("doc_id", "th", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = each.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = hits.select("doc_id", "th", "wtxt").distinct().join(items, "wtxt").groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item")).alias("items"))
    got = scratch.table(spans.join(named, (spans.doc_id.eqNullSafe(named.doc_id)) & (spans.th == named.th)).select(spans.doc_id.alias("h_id"), spans.th.alias("h_th"), "spans", "items"), "found")
    new = {"n_words", "n_hit", "spans", "items", "contaminated"}
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new], F.size(word_array(F.col("text"))).cast("bigint").alias("n_words"))
    out = base.join(got, base["doc_id"].eqNullSafe(got.h_id) & (F.xxhash64(base["text"]) == got.h_th), "left")
    n_hit = F.coalesce(F.expr("aggregate(spans, 0L, (acc, x) -> acc + x.end - x.start)"), F.lit(0).cast("bigint"))
    return out.select(
        base["*"], n_hit.alias("n_hit"),
        F.coalesce("spans", F.expr("CAST(array() AS array<struct<start:int,end:int>>)")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"),
    )


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = contamination(pick(docs, "doc_id", "text"), bench)
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT rid, p, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
c AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM h) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN i USING (rid)
"""
