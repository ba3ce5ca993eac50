"""Quality classifier: Naive Bayes support vectors over hashed n-gram indicators."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, crc_bucket, map_batches, pick, words_of
from .linear import dual_descent, platt

BITS = 20
#: Labelled rows that a model is fitted on at most: those whose hashed id comes first.
MAX_TRAIN_ROWS = 20_000
#: Words hashed at a time, so that one very long document needs little memory.
CHUNK = 1 << 18


class _Hash(dict):
    """crc32 of each word, remembered; emptied when large."""

    def __missing__(self, word):
        if len(self) > 200_000:
            self.clear()
        self[word] = h = zlib.crc32(word)
        return h


_HASH = _Hash()


def indicators(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct hashed indicators of a text: words, word pairs, repeated words, and bands of
    how many words repeat the one before them, repeat any word at all, or are bare punctuation."""
    words = words_of(text)
    n, mask, found, stutters, marks = len(words), (1 << bits) - 1, [], 0, 0
    mix = np.uint64(0x9E3779B97F4A7C15)
    last = np.empty(0, np.uint64)
    for at in range(0, n, CHUNK):
        h = np.fromiter(map(_HASH.__getitem__, words[at : at + CHUNK]), np.uint64, min(CHUNK, n - at))
        both = np.concatenate([last, h])
        same = both[1:] == both[:-1]
        stutters += int(same.sum())
        pair = (both[:-1] * mix + both[1:]) * mix >> np.uint64(64 - bits)
        found += [np.unique(h * mix >> np.uint64(64 - bits)), np.unique(pair[~same])]
        last = h[-1:]
    marks = sum(map(words.count, (b"|", b"-", b"*", b"#", b">", b"=", b"&", b"/", b"\\")))
    bands = [("n", n), ("s", 100 * stutters // max(1, n - 1)), ("m", 100 * marks // max(1, n)), ("u", 100 * len(set(words)) // max(1, n))]
    extra = [zlib.crc32(f"\0{k}{int(v).bit_length()}".encode()) & mask for k, v in bands[:3]] + [zlib.crc32(f"\0u{bands[3][1] // 10}".encode()) & mask]
    return np.unique(np.concatenate([*found, np.array(extra, np.uint64)])).astype(np.int32)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, dim: int, smooth: float = 1.0) -> np.ndarray:
    """log of (weighted count of an indicator in class 1 / its norm) over the same in class 0."""
    p, q = np.full(dim, smooth), np.full(dim, smooth)
    for idx, label, v in zip(rows, y, weight):
        (p if label > 0 else q)[idx] += v
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit(rows: list[np.ndarray], label: np.ndarray, bits: int = BITS, cost: float = 1.0) -> np.ndarray:
    """Weights over indicators, then bias, Platt's a and b."""
    dim, y = 1 << bits, np.where(np.asarray(label) > 0, 1.0, -1.0)
    if not len(rows) or len(set(y)) < 2:  # one class, or none: its smoothed rate
        rate = (float((y > 0).sum()) + 1) / (len(y) + 2)
        return np.concatenate([np.zeros(dim + 1), [1.0, np.log(rate / (1 - rate))]])
    weight = np.where(y > 0, len(y) / 2 / (y > 0).sum(), len(y) / 2 / (y < 0).sum())
    r = log_count_ratios(rows, y, np.ones(len(y)), dim)
    scaled = [r[i] / max(1e-9, float(np.sqrt(r[i] @ r[i]))) for i in rows]
    fold = np.arange(len(rows)) % 5 == 0  # for Platt's a and b, from a model that hasn't seen them
    part = [i for i in range(len(rows)) if not fold[i]]
    half = dual_descent([rows[i] for i in part], [scaled[i] for i in part], y[part], cost * weight[part], dim)
    seen = np.flatnonzero(fold)
    margin = np.array([float(half[rows[i]] @ scaled[i]) + half[dim] for i in seen])
    a, b = platt(margin, y[seen], np.ones(len(seen)))
    w = dual_descent(rows, scaled, y, cost * weight, dim)
    out = w[:dim] * r
    return np.concatenate([out, [w[dim], a, b]])


def scores(rows: list[np.ndarray], model: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    dim = len(ratios)
    out = np.empty(len(rows))
    for k, i in enumerate(rows):
        r = ratios[i]
        out[k] = float(model[i].sum()) / max(1e-9, float(np.sqrt(r @ r))) + model[dim]
    return 1 / (1 + np.exp(-np.clip(model[dim + 1] * out + model[dim + 2], -35, 35)))


def train(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_TRAIN_ROWS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ratios) from at most ``max_rows`` labelled documents, in one task of bounded size.

    docs: doc_id and text; labels: doc_id and the label column; rows with a null label or id teach nothing.
    The rows taken are those whose hashed ids come first, and of a repeated id the text of least hash, whatever the partitioning.
    """
    spark = docs.sparkSession
    wanted = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    scratch = Scratch(spark, "labelled")
    small = map_batches(
        docs.join(F.broadcast(wanted), "doc_id").select("doc_id", "text", F.xxhash64("text").alias("t"), F.col("y").cast("int").alias("y")),  # max_rows ids at most
        lambda part: {"y": part.column("y"), "t": part.column("t"), "k": part.column("doc_id").cast(pa.int64()), "idx": pa.array([indicators(t, bits).tobytes() for t in part.column("text").to_pylist()], pa.binary())},
        "y int, t bigint, k bigint, idx binary",
    )
    small = small.groupBy("k").agg(F.min_by(F.struct("y", "idx"), "t").alias("one")).select("one.y", "k", "one.idx")  # of repeated ids the text of least hash
    small = scratch.table(small, "rows")

    def solve(batches):
        rows, y, keys = [], [], []
        for b in batches:
            rows += [np.frombuffer(x, np.int32) for x in b.column("idx").to_pylist()]
            y += b.column("y").to_pylist()
            keys += b.column("k").to_pylist()
        order = np.argsort(np.array(keys, np.int64), kind="stable") if keys else []
        rows, y = [rows[i] for i in order], np.array([y[i] for i in order])
        model = fit(rows, y, bits)
        ratios = log_count_ratios(rows, np.where(y > 0, 1, -1), np.ones(len(y)), 1 << bits) if len(rows) else np.ones(1 << bits)
        yield pa.RecordBatch.from_arrays([pa.array([model.astype(np.float32).tobytes()], pa.binary()), pa.array([ratios.astype(np.float32).tobytes()], pa.binary())], ["w", "r"])

    got = small.coalesce(1).mapInArrow(solve, "w binary, r binary").collect()
    if not got:  # nothing is labelled
        return fit([], np.empty(0), bits), np.ones(1 << bits)
    return np.frombuffer(got[0]["w"], np.float32).astype(float), np.frombuffer(got[0]["r"], np.float32).astype(float)


def classify(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> DataFrame:
    """All columns of docs, and score (0 to 1); null and empty texts are scored by their bands alone."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(x.astype(np.float32) for x in model))  # 2**bits numbers each
    names = [c for c in docs.columns if c != "score"]

    def run(part):
        rows = [indicators(t, bits) for t in part.column("text").to_pylist()]
        return {n: part.column(n) for n in names} | {"score": scores(rows, *shared.value)}

    kept = pick(docs, *names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return map_batches(kept, run, f"{schema}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", learn=None) -> DataFrame:
    """docs with ``score``, the probability that a document's label is 1.

    learn: a condition on doc_id that says which labels may be learnt from (all, if None). Handles null or
    repeated ids and texts (every row is scored), missing labels, and empty tables (with nothing to learn
    from, the score is 0.5).
    """
    teach = pick(labels, "doc_id", label)
    model = train(pick(docs, "doc_id", "text"), teach.where(learn) if learn is not None else teach, label)
    return classify(docs, model)


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    fold = crc_bucket(F.col("doc_id"), 3)
    got = quality_scores(pick(docs, "doc_id", "text"), labels, "quality", fold != 1)
    return got.select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
