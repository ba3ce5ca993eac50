"""Lexical ranking: a sum of BM25 over weighted fields, with statistics of the candidates themselves."""

from __future__ import annotations

import unicodedata

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import STOP_WORDS, is_plain, normalized, spread, word_tokens, words

# What a hit in each field weighs, and the constants of the saturation.
FIELD_WEIGHTS = {"title": 4.0, "aliases": 4.0, "topics": 2.0, "summary": 2.5, "conditions": 1.0, "body": 1.0, "sources": 0.6}
K1, B = 1.2, 0.75
TITLE_BONUS, DOMAIN_BOOST, MODE_BOOST = 2.0, 1.15, 1.15


def _count(word: Column, term: str | None = None) -> Column:
    """How many tokens a word yields, or how many of them are one term."""
    if term is None:
        return F.when(is_plain(word), (~word.isin(*STOP_WORDS)).cast("int")).otherwise(F.size(word_tokens(word)))
    return F.when(is_plain(word), (word == term).cast("int")).otherwise(F.size(F.filter(word_tokens(word), lambda x: x == term)))


def bm25(records: DataFrame, terms: list[str], fields: dict[str, Column], weights: dict[str, float] | None = None, key: tuple[str, ...] = ("id",)) -> DataFrame:
    """records that hold a term in a field, with ``score``, ``hit_terms`` and ``hit_fields``.

    The number of records, the document frequencies (over the union of the fields) and the mean field lengths
    are those of ``records``, which the caller has filtered. Words are exploded and summed back to one row a
    record before anything is shuffled; the statistics are a single row, and only hits meet their records again.
    """
    weights, terms = weights or FIELD_WEIGHTS, sorted(set(terms))
    if not terms:
        none = F.array().cast("array<string>")
        return records.select("*", F.lit(0.0).alias("score"), none.alias("hit_terms"), none.alias("hit_fields")).limit(0)
    texts = F.array(*[F.struct(F.lit(f).alias("f"), words(normalized(F.coalesce(F.col(f"f_{f}"), F.lit("")))).alias("w")) for f in fields])
    each = spread(records.select(*key, *[c.alias(f"f_{f}") for f, c in fields.items()])).select(*key, F.explode(texts).alias("x")).select(*key, "x.f", F.explode_outer("x.w").alias("w"))
    word, of = F.col("w"), {f: F.col("f") == f for f in fields}
    n = {f: F.sum(F.when(of[f] & word.isNotNull(), _count(word)).otherwise(0)).alias(f"n_{f}") for f in fields}
    tf = {(f, i): F.sum(F.when(of[f] & word.isNotNull(), _count(word, t)).otherwise(0)).alias(f"tf_{f}_{i}") for f in fields for i, t in enumerate(terms)}
    rows = each.groupBy(*key).agg(*n.values(), *tf.values())
    at = {(f, i): F.col(f"tf_{f}_{i}") for f in fields for i in range(len(terms))}
    found = [reduce(lambda a, b: a | b, [at[f, i] > 0 for f in fields]) for i in range(len(terms))]
    stats = rows.agg(
        F.count("*").alias("__n"), *[F.greatest(F.lit(1.0), F.avg(f"n_{f}")).alias(f"avg_{f}") for f in fields],
        *[F.count_if(found[i]).alias(f"df_{i}") for i in range(len(terms))],
    )
    hits = rows.crossJoin(F.broadcast(stats)).where(reduce(lambda a, b: a | b, found))  # one row
    rarity = [F.log1p((F.col("__n") - F.col(f"df_{i}") + 0.5) / (F.col(f"df_{i}") + 0.5)) for i in range(len(terms))]
    norm = {f: K1 * ((1 - B) + B * F.col(f"n_{f}") / F.col(f"avg_{f}")) for f in fields}
    score = reduce(add, [weights[f] * rarity[i] * at[f, i] * (K1 + 1) / (at[f, i] + norm[f]) for f in fields for i in range(len(terms))])
    keep = lambda pairs: F.filter(F.array(*[F.when(c, F.lit(x)) for x, c in pairs]), lambda x: x.isNotNull())
    hits = hits.select(
        *key, score.alias("score"), keep(list(zip(terms, found))).alias("hit_terms"),
        keep([(f, reduce(lambda a, b: a | b, [at[f, i] > 0 for i in range(len(terms))])) for f in sorted(fields)]).alias("hit_fields"),
    )
    return records.join(hits, list(key)).select(*records.columns, "score", "hit_terms", "hit_fields")


def boosted(scored: DataFrame, query: str, title: Column, domain: Column | None = None, wanted_domain: str | None = None, places: int = 6) -> DataFrame:
    """The bonus for the whole query in the title, then the boost of the caller's domain, then rounding."""
    q = normalized(F.lit(query))
    score = F.col("score") + F.when((F.length(q) > 0) & (F.instr(normalized(title), unicodedata.normalize("NFKC", query).casefold().strip()) > 0), TITLE_BONUS).otherwise(0.0)
    if domain is not None and wanted_domain is not None:
        score = score * F.when(domain == wanted_domain, DOMAIN_BOOST).otherwise(1.0)
    return scored.withColumn("score", F.round(score, places))


def mode_boosted(scored: DataFrame, modes: Column, mode: str) -> DataFrame:
    return scored.withColumn("score", F.col("score") * F.when(F.array_contains(modes, mode), MODE_BOOST).otherwise(1.0))


def relevance_order(title: Column) -> list[Column]:
    return [F.desc("score"), normalized(title).asc(), F.col("project_id").asc(), F.col("id").asc()]


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, name: str = "rank") -> DataFrame:
    """``limit`` rows from ``offset`` on in a total order, with their place from 1: a bounded top-k, not a global sort."""
    top = rows.orderBy(*order).limit(limit + offset)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order))).where(F.col(name) > offset)
