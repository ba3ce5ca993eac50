"""Language-model scoring: a hashed maximum-entropy model with class-factored softmax."""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, crc_bucket, pick, sliced, utf8, words_of

#: The token after the last word of a text; no word holds white space.
END = b"\n"
#: Words whose counts are broadcast: the most frequent ones. The rest are looked up by a join.
HEAD = 1 << 17
#: Classes: END and the most frequent words are classes of their own, the other words share the rest by form.
CLASSES, OWN = 64, 24
#: Kinds of features: the last word, the one before it, and the pair of them. Each has hashed rows of weights, whose number grows with
#: the square root of the vocabulary.
KINDS, LEAST_ROWS, PER_ROOT = 3, 1 << 12, 16
#: Tokens whose gradient is taken at a time, which fits a core's cache.
PART = 1 << 13
#: Tokens in a block, whose rows of equal context are added up by one small matrix product.
BLOCK = 16
#: Tasks whose sums are added up at a time, rows of weights that travel together, and tokens of a task at the mean.
FAN, PER, PER_TASK = 64, 256, 3_000_000
#: Rounds of summed gradients, each over its own share of the documents.
ROUNDS = 3
#: Weights start from counts with so much of the prior added, damped since the kinds overlap; rate and damping of a round.
PRIOR, START, RATE, DAMP = 50.0, 0.7, 0.3, 30.0
#: Gradients are summed in whole numbers of this, so that their order doesn't matter.
GRAIN = 4096.0


class Codes(dict):
    """word -> class << 52 | (place in the head + 1) << 32 | crc32: made ahead for the head and for words of their own class, which
    most tokens are, and worked out for each other token, so that nothing is remembered."""

    def __init__(self, own: dict[bytes, int], head: dict[bytes, int]):
        super().__init__((w, word_class(w, own) << 52 | (head.get(w, -1) + 1) << 32 | zlib.crc32(w)) for w in own | head)

    def __missing__(self, word):
        return OWN + zlib.crc32(word[-2:]) % (CLASSES - OWN) << 52 | zlib.crc32(word)


def word_class(word: bytes, own: dict[bytes, int]) -> int:
    """Its own class, or one by its last bytes (so that unseen words have a class too)."""
    got = own.get(word)
    return got if got is not None else OWN + zlib.crc32(word[-2:]) % (CLASSES - OWN)


def tokens(texts: list[bytes | None], codes: Codes) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Codes of all tokens of some texts, END after each, the place where each text starts, and its tokens."""
    words = [words_of(t) for t in texts]
    for ws in words:
        ws.append(END)
    flat = np.fromiter(map(codes.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
    return flat, np.concatenate([[0], np.cumsum([len(w) for w in words])[:-1]]).astype(np.int64), words


def rows_for(vocabulary: int) -> int:
    """A power of two near PER_ROOT times the root of the number of distinct tokens, LEAST_ROWS at least."""
    return max(LEAST_ROWS, 1 << round(float(np.log2(max(1.0, PER_ROOT * vocabulary**0.5)))))


def contexts(code: np.ndarray, starts: np.ndarray, rows: int = LEAST_ROWS) -> np.ndarray:
    """Rows of weights for each token: KINDS x tokens. Before a text stands a mark of its own."""
    crc = code & 0xFFFFFFFF
    one, two = np.empty_like(crc), np.empty_like(crc)
    one[1:], two[2:] = crc[:-1], crc[:-2]
    one[starts], two[starts] = 1, 1
    later = starts + 1
    two[later[later < len(crc)]] = 1
    two[starts] = 1
    pair = (one * 0x9E3779B1 + two * 0x85EBCA77) >> 13
    return np.stack([one % rows, two % rows, pair % rows]).astype(_kind(rows))  # 16 bits are sorted by radix


def _kind(rows: int):
    return np.uint16 if rows <= 1 << 16 else np.uint32


def softmax(w: np.ndarray, bias: np.ndarray, rows: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The logit of each token's class, the exponentials of the logits of all classes, and their sums."""
    e, part = w[0].take(rows[0], axis=0), np.empty((rows.shape[1], w.shape[2]), w.dtype)
    for k in range(1, KINDS):
        e += w[k].take(rows[k], axis=0, out=part, mode="clip")  # without a copy on the way; rows are always in range
    e += bias
    np.clip(e, -60, 60, out=e)  # far from what float32 can't exponentiate
    own = e[np.arange(len(y)), y]
    np.exp(e, out=e)
    return own, e, e @ np.ones(e.shape[1], np.float32)


def class_logs(w: np.ndarray, bias: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """log10 of the probability of each token's class."""
    out = np.empty(len(y))
    for at in range(0, len(y), PART):
        own, _, total = softmax(w, bias, rows[:, at : at + PART], y[at : at + PART])
        out[at : at + PART] = own - np.log(total)
    return out / np.log(10)


def row_sums(e: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values of r, sums of e over each; values and sums of the rest): the sorted rows are added up in blocks, and what runs on
    from one block into the next is the rest, where values can repeat."""
    order, n = np.argsort(r, kind="stable"), len(r)
    order = np.concatenate([order, np.repeat(order[-1:], -n % BLOCK)])
    r, m = r[order], len(order)
    first = np.concatenate([[True], r[1:] != r[:-1]])
    new = first.copy()
    new[::BLOCK] = True
    nth = np.cumsum(new.reshape(-1, BLOCK), axis=1, dtype=np.int8)
    nth.reshape(-1)[n:] = 0  # rows that only fill the last block
    hot = (nth[:, None, :] == np.arange(1, BLOCK + 1, dtype=np.int8)[None, :, None]).astype(np.float32)
    sums = np.matmul(hot, e.take(order, axis=0).reshape(m // BLOCK, BLOCK, -1)).reshape(m, -1)
    at = np.flatnonzero(new[:n])
    place, own = at // BLOCK * BLOCK + nth.reshape(-1)[at] - 1, first[at]
    return r[at[own]], sums.take(place[own], axis=0), r[at[~own]], sums.take(place[~own], axis=0)


def gradient(w: np.ndarray, bias: np.ndarray, rows: np.ndarray, y: np.ndarray, out: np.ndarray, scale: float = 1.0) -> None:
    """Adds the gradient of the log loss of some tokens, times ``scale``, to out (KINDS x rows x CLASSES): only the rows of these tokens are touched."""
    for at in range(0, len(y), PART):
        r, z = rows[:, at : at + PART], y[at : at + PART]
        _, e, total = softmax(w, bias, r, z)
        e *= (np.float32(scale) / total)[:, None]
        e[np.arange(len(z)), z] -= np.float32(scale)
        for k in range(KINDS):
            to, sums, rest, more = row_sums(e, r[k])
            while len(to):
                got = out[k].take(to, axis=0)
                got += sums
                out[k, to] = got
                to, sums, rest, more = row_sums(more, rest) if len(rest) else (rest, more, rest, more)


def count_tokens(docs: DataFrame) -> DataFrame:
    """(w binary, n bigint) over all texts of docs, END once for each; combined before the shuffle."""

    def run(batches):
        c: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["w", "n"])

        for part in sliced(batches):
            for t in utf8(part.column("text")):
                c.update(words_of(t))
                c[END] += 1
            if len(c) > 500_000:
                yield out()
                c.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


def planes(v: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bytes of whole numbers, bytes of equal weight side by side (width x numbers): that compresses far better."""
    return np.ascontiguousarray(v).view(np.uint8).reshape(-1, 8)[:, :width].T


def numbers(p: np.ndarray) -> np.ndarray:
    """The numbers of such planes."""
    z = np.zeros((p.shape[1], 8), np.uint8)
    z[:, : len(p)] = p.T
    return z.view(np.int64)[:, 0]


def packed(v: np.ndarray) -> bytes:
    """Whole numbers, in no more planes than the largest needs; the sign is the lowest bit, so small negative ones are small too."""
    z = v << 1 ^ v >> 63
    return planes(z, max(1, -(-int(z.view(np.uint64).max()).bit_length() // 8))).tobytes()


def whole(packs: bytes, n: int = PER * CLASSES) -> np.ndarray:
    """The n numbers of ``packed``."""
    z = numbers(np.frombuffer(packs, np.uint8).reshape(-1, n)).view(np.uint64)
    return (z >> 1).view(np.int64) ^ -(z & 1).view(np.int64)


def add(table: pa.Table) -> pa.Table:
    """One row for a block of whole numbers: the sum over at most FAN tasks."""
    total = sum(whole(x) for x in table.column("sum").to_pylist())
    first = table.slice(0, 1)
    return pa.Table.from_arrays([first.column("block"), first.column("task"), pa.array([packed(total)], pa.binary())], table.schema.names)


def stored(code: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """For each text the places in the head of its tokens, in three bytes, and crc32 and class of those outside, in five: what contexts and
    classes follow from in less room."""
    place = (code >> 32) & 0xFFFFF
    odd = np.flatnonzero(place == 0)
    rare = code[odd]
    made, cut = [], np.concatenate([starts, [len(code)]])
    for p, at in ((planes(place, 3), cut), (planes(rare & 0xFFFFFFFF | rare >> 52 << 32, 5), np.searchsorted(odd, cut))):
        made.append([p[:, a:b].tobytes() for a, b in zip(at.tolist(), at[1:].tolist())])
    return made[0], made[1]


def unpacked(part: pa.RecordBatch, known: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of weights, classes, place where each text starts) of the tokens of some encoded texts; known: codes by the place in the head."""
    raw, rare = ([np.frombuffer(x, np.uint8).reshape(n, -1) for x in part.column(c).to_pylist()] for c, n in (("places", 3), ("rare", 5)))
    starts = np.concatenate([[0], np.cumsum([x.shape[1] for x in raw])[:-1]]).astype(np.int64)
    place, rare = numbers(np.concatenate(raw, axis=1)), numbers(np.concatenate(rare, axis=1))
    code = known.take(place)
    code[place == 0] = rare >> 32 << 52 | rare & 0xFFFFFFFF
    return contexts(code, starts, rows), code >> 52, starts


def summed(codes: DataFrame, known, rows: int, tasks: int, fn) -> np.ndarray:
    """fn(contexts, classes, out) over all encoded texts, its KINDS x rows x CLASSES whole numbers summed: FAN tasks' at a time, by blocks.

    No more than ``tasks`` tasks, so that their sums stay small beside what they read. known: a broadcast of the head's codes.
    """

    def run(batches):
        out, some = np.zeros((KINDS, rows, CLASSES)), False
        for part in sliced(batches):
            x, y, _ = unpacked(part, known.value, rows)
            fn(x, y, out)
            some = True
        if some:
            flat = np.rint(out, out=out).reshape(-1, PER * CLASSES)
            for at in range(0, len(flat), 16):
                got = flat[at : at + 16].astype(np.int64)  # no second copy of all sums
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(got), dtype=np.int32)), pa.array(np.full(len(got), TaskContext.get().partitionId(), np.int32)), pa.array([packed(x) for x in got], pa.binary())], ["block", "task", "sum"])

    parts = codes.select("places", "rare").coalesce(tasks).mapInArrow(run, "block int, task int, sum binary")
    while True:  # sums of FAN at a time
        tasks = -(-tasks // FAN)
        parts = parts.withColumn("task", F.expr(f"CAST(task DIV {FAN} AS int)")).groupBy("block", "task").applyInArrow(add, parts.schema)
        if tasks == 1:
            break
    total = np.zeros((KINDS * rows // PER, PER * CLASSES), np.int64)
    for x in parts.toLocalIterator():  # one row a block
        total[x["block"]] = whole(x["sum"])
    return total.reshape(KINDS, rows, CLASSES)


def train(codes: DataFrame, known, rows: int, n: int, bias: np.ndarray) -> np.ndarray:
    """Weights KINDS x rows x CLASSES from encoded texts (places, rare, share) of n tokens; known: a broadcast of the head's codes.

    They start from how often each class follows each feature, counted over all texts. In each round all texts of
    its share give their gradient at the common weights; the sums move these, each by its own curvature. Counts and sums
    are the same whatever the partitions.
    """
    spark, prior = codes.sparkSession, np.exp(bias)
    # Each task hands on its whole sums, so there are no more tasks than keep all cores busy, however much each reads.
    tasks = min(-(-n // PER_TASK), 2 * spark.sparkContext.defaultParallelism)

    def count(x, y, out):
        for k in range(KINDS):  # only the places of these tokens are touched
            np.add.at(out[k].reshape(-1), x[k].astype(np.int64) * CLASSES + y, 1.0)

    seen = summed(codes, known, rows, tasks, count).astype(np.float32)
    total = seen.sum(2, keepdims=True)
    seen += PRIOR * prior
    seen /= total + PRIOR
    w = (START * (np.log(seen) - bias)).astype(np.float32)
    seen *= 1 - seen
    seen *= total
    seen += DAMP  # the curvature
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast((w, bias))  # KINDS x rows x CLASSES numbers: rows grow with the root of the vocabulary

        def step(x, y, out, shared=shared):
            gradient(*shared.value, x, y, out, GRAIN)

        w = w - (RATE * ROUNDS / GRAIN * summed(codes.where(F.col("share") == r), known, rows, tasks, step) / seen).astype(np.float32)
        shared.destroy()
    return w


def most_frequent(counts: DataFrame, most: int) -> list:
    """All words from some count up, as many as ``most`` allows, by count and word. The count is found from
    a histogram in sixteenths of a power of two, so no task or driver ever sorts the vocabulary."""
    band = F.floor(F.log2("n") * 16).cast("int").alias("band")
    sizes, room, least = sorted(((r["band"], r["count"]) for r in counts.groupBy(band).count().collect()), reverse=True), most, 1 << 30
    for at, n in sizes:
        if n > room:
            break
        room, least = room - n, at
    kept = counts.where(band >= least).toArrow()  # ``most`` rows at most
    rows = list(zip(kept.column("w").to_pylist(), kept.column("n").to_pylist()))
    return sorted(rows, key=lambda r: (-r[1], r[0]))


def lm_scores(docs: DataFrame, learn) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score, one row per input row.

    learn: a condition that says which rows are learnt from. The base is the unigram score with 0.1 added
    to each count. The model gives a token P(its class | context) * P(token | class): the class by a
    maximum-entropy model over hashed features of the last two words, the token by its smoothed share of
    the class, one share being left for unknown words of the class. Counts are over all training rows, and the scores
    don't depend on how the rows are dealt to tasks.
    Null and empty texts are one END. Repeated or null ids are rows of their own; with nothing to learn
    from every token is unknown; an empty table gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lm")
    docs = pick(docs, "doc_id", "text").withColumn("learn", F.coalesce(learn, F.lit(False)))
    counts = scratch.table(count_tokens(docs.where("learn")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = most_frequent(counts, HEAD)
    head = {w: i for i, (w, _) in enumerate(top)}
    head_n = np.array([n for _, n in top], np.int64)
    own = {END: 0} | {w: k + 1 for k, w in enumerate([w for w, _ in top[: OWN + 1] if w != END][: OWN - 1])}

    def by_class(batches):
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for b in batches:
            for w, c in zip(b.column("w").to_pylist(), b.column("n").to_pylist()):
                k = word_class(w, own)
                n[k] += c
                v[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(n), pa.array(v)], ["k", "n", "v"])

    sizes = counts.mapInArrow(by_class, "k int, n bigint, v bigint").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sizes:
        n_class[r["k"]], v_class[r["k"]] = r["n"], r["v"]
    bias = np.log((n_class + 0.5) / (n_class.sum() + 0.5 * CLASSES)).astype(np.float32)
    per_class, rows = np.log10(n_class + 0.1 * (v_class + 1)), rows_for(total["v"])
    codes = Codes(own, head)
    shared = spark.sparkContext.broadcast((codes, head_n, per_class))  # bounded by HEAD and CLASSES
    known = spark.sparkContext.broadcast(np.array([0, *(codes[w] for w in head)], np.int64))

    def encode(batches):
        codes, head_n, per_class = shared.value
        logs = np.concatenate([[0.0], np.log10(head_n + 0.1)])
        for part in sliced(batches):
            code, starts, words = tokens(utf8(part.column("text")), codes)
            y, place = code >> 52, (code >> 32) & 0xFFFFF
            odd, flat = np.flatnonzero(place == 0), list(chain.from_iterable(words))
            ends = np.searchsorted(odd, np.concatenate([starts, [len(code)]])).astype(np.int32)
            tails = pa.ListArray.from_arrays(pa.array(ends), pa.array([flat[i] for i in odd.tolist()], pa.binary()))
            sums = [np.add.reduceat(v, starts) for v in (logs[place], -per_class[y], (place > 0).astype(np.int64))]
            made = [pa.array(x, pa.binary()) for x in stored(code, starts)]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in ("rid", "doc_id", "learn", "share")], *map(pa.array, (np.array([len(v) for v in words], np.int64), *sums)), tails, *made],
                ["rid", "doc_id", "learn", "share", "n_tokens", "head_log", "in_class", "head_known", "tail", "places", "rare"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "learn", F.pmod(F.xxhash64("text"), F.lit(ROUNDS)).cast("int").alias("share"), "text")
    coded = scratch.table(given.mapInArrow(encode, f"rid bigint, doc_id {id_type}, learn boolean, share int, n_tokens bigint, head_log double, in_class double, head_known bigint, tail array<binary>, places binary, rare binary"), "codes", compression="zstd")
    w = train(coded.where("learn"), known, rows, total["n"], bias) if total["n"] else np.zeros((KINDS, rows, CLASSES), np.float32)
    model = spark.sparkContext.broadcast((w, bias))

    def score(batches):
        for part in sliced(batches):
            x, y, starts = unpacked(part, known.value, rows)
            yield pa.RecordBatch.from_arrays([part.column("rid"), pa.array(np.add.reduceat(class_logs(*model.value, x, y), starts))], ["rid", "class_log"])

    scored = scratch.table(coded.select("rid", "places", "rare").mapInArrow(score, "rid bigint, class_log double"), "scored")
    plain = coded.drop("places", "rare", "learn", "share")
    # Words outside the head meet their counts by a join; what all rows need of an unknown word is log10(0.1).
    tail = plain.select("rid", F.explode("tail").alias("w"))
    known = tail.join(counts, "w").groupBy("rid").agg(F.count("*").alias("tail_known"), F.sum(F.log10(F.col("n") + F.lit(0.1))).alias("tail_log"))
    out = plain.drop("tail").join(scored, "rid").join(known, "rid", "left")
    n_known = F.col("head_known") + F.coalesce("tail_known", F.lit(0))
    log_n = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) - (F.col("n_tokens") - n_known)  # log10(0.1) is -1
    z = float(np.log10(total["n"] + 0.1 * (total["v"] + 1)))
    return out.select(
        "doc_id", "n_tokens", n_known.cast("bigint").alias("n_known"), F.lit(int(total["n"])).cast("bigint").alias("train_tokens"),
        (log_n - F.col("n_tokens") * F.lit(z)).alias("base_score"), (log_n + F.col("in_class") + F.col("class_log")).alias("score"),
    )


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc_bucket(F.col("doc_id"), 10)
    got = lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold != 0)
    return got.select("doc_id", (fold == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
