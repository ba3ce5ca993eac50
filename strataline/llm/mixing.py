"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities."""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, pick, sliced, utf8

DIMENSIONS = ("source", "lang", "topic")
KEYS = [f"__{d}" for d in DIMENSIONS]
#: Exponents of the default targets: each value's share of the tokens to this power, made to sum to one.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.0}
#: Share of all tokens that a sample holds, as expected.
KEEP = 0.5
#: Cells of source, language and topic that are raked on the driver at most; more are raked by distributed aggregates.
DRIVER_CELLS = 200_000
#: Topics, the hashed words they are told by, the rounds of k-means over all texts, and the texts its first means come from.
TOPICS, DIM, ROUNDS, FIRST = 16, 4096, 3, 256
#: Shorter words say nothing of the topic.
LETTERS = 4
#: Words whose dimension a worker remembers, and entries of texts whose likeness to the topics is held at a time, at the mean (TOPICS numbers each).
REMEMBERED, PART = 50_000, 1 << 15


class _Dims(dict):
    """The hashed dimension of each word, or -1 for a short one; remembered, emptied when large."""

    def __missing__(self, word):
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = got = zlib.crc32(word) % DIM if len(word) >= LETTERS else -1
        return got


_DIMS = _Dims()


def bags(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; then the row, hashed dimension and damped count (1 + floor(log2 count)) of what is in it."""
    words = [t.lower().split() if t else [] for t in texts]
    size = np.fromiter(map(len, words), np.int64, len(words))
    at = np.fromiter(map(_DIMS.__getitem__, chain.from_iterable(words)), np.int64, int(size.sum()))
    row = np.repeat(np.arange(len(texts)), size)
    key, n = np.unique((row * DIM + at)[at >= 0], return_counts=True)
    return size, key // DIM, key % DIM, np.floor(np.log2(n)).astype(np.int64) + 1


def rarity(df: np.ndarray, n: int) -> np.ndarray:
    """Whole-numbered weights of the dimensions, larger the fewer texts have them."""
    return np.floor(16 * np.log2((n + 1.0) / (df + 1.0))).astype(np.int64)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to a length of about 4096, in whole numbers: their sums are exact in any order."""
    norm = np.sqrt((v * v).sum(1, keepdims=True, dtype=float))
    return np.floor(np.divide(4096.0 * v, norm, out=np.zeros(v.shape), where=norm > 0)).astype(np.int64)


def assign(size: int, row: np.ndarray, dim: np.ndarray, value: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The topic of each text, the first of equals; -1 for a text without weight. All sums are whole numbers."""
    out = np.full(size, -1, np.int64)
    some = value > 0
    row, dim, value = row[some], dim[some], value[some]
    if len(row):
        cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        columns, cuts, at = np.ascontiguousarray(means.T, float), np.append(cut, len(row)), 0  # whole numbers below 2**53
        while at < len(cut):
            to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + PART, "right")) - 1)
            near = columns.take(dim[cuts[at] : cuts[to]], axis=0)
            near *= value[cuts[at] : cuts[to], None]
            out[row[cut[at:to]]] = np.add.reduceat(near, cut[at:to] - cut[at], axis=0).argmax(1)
            at = to
    return out


def topic_model(docs: DataFrame, scratch: Scratch) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame]:
    """(weights of the dimensions, TOPICS means), from a spherical k-means over the hashed words of all texts; and the
    rows of docs with tokens and topic instead of the text.

    The first means are some of the FIRST distinct texts of least hash, each the one farthest from those
    before. Whole-numbered sums make the model the same whatever the partitions.
    """
    spark, keys = docs.sparkSession, [c for c in docs.columns if c != "text"]

    def gather(batches):
        for part in sliced(batches):
            size, row, dim, n = bags(utf8(part.column("text")))
            ends = np.searchsorted(row, np.arange(len(size) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("t"), *[part.column(k) for k in keys], pa.array(size), pa.ListArray.from_arrays(pa.array(ends), pa.array((dim * 64 + n).astype(np.int32)))], ["t", *keys, "tokens", "bag"])

    has = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    rows = scratch.table(docs.withColumn("t", F.xxhash64("text")).mapInArrow(gather, f"t bigint, {has}, tokens bigint, bag array<int>"), "bags")

    def opened(part):
        bag = part.column("bag")
        flat = bag.flatten().to_numpy()
        size = np.diff(np.concatenate([[0], np.cumsum(bag.value_lengths().to_numpy(zero_copy_only=False))]))
        return len(bag), np.repeat(np.arange(len(bag)), size), flat // 64, (flat % 64).astype(np.int64)

    def count(batches):
        df, n = np.zeros(DIM, np.int64), 0
        for part in sliced(batches, 4096):
            _, row, dim, _ = opened(part)
            df, n = df + np.bincount(dim, minlength=DIM), n + len(np.unique(row))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df.tobytes()], pa.binary())], ["n", "sum"])

    total, df = _summed(rows.mapInArrow(count, "n bigint, sum binary"), DIM)
    weight = rarity(df, total)
    some = rows.where("size(bag) > 0").select("t").distinct().orderBy("t").limit(FIRST)
    some = rows.join(F.broadcast(some), "t").groupBy("t").agg(F.first("bag").alias("bag")).orderBy("t").collect()  # FIRST rows
    dense = np.zeros((len(some), DIM), np.int64)
    for i, r in enumerate(some):
        x = np.array(r["bag"], np.int64)
        dense[i, x // 64] = x % 64
    dense = unit(dense * weight)
    means = np.zeros((TOPICS, DIM), np.int64)
    near = np.full(len(dense), -1, np.int64)
    for k in range(min(TOPICS, len(dense))):
        means[k] = dense[int(near.argmin())]
        near = np.maximum(near, dense @ means[k])
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(means)

        def move(batches):
            got, n = np.zeros((TOPICS, DIM), np.int64), 0
            for part in sliced(batches, 1024):
                size, row, dim, count = opened(part)
                value = count * weight[dim]
                norm = np.sqrt(np.bincount(row, value.astype(float) ** 2, size))
                topic = assign(size, row, dim, value, shared.value)
                one = np.floor(np.divide(4096.0 * value, norm[row], out=np.zeros(len(row)), where=norm[row] > 0))
                ok = topic[row] >= 0
                got += np.bincount((topic[row] * DIM + dim)[ok], one[ok], TOPICS * DIM).astype(np.int64).reshape(TOPICS, DIM)
                n += size
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([got.tobytes()], pa.binary())], ["n", "sum"])

        new = _summed(rows.mapInArrow(move, "n bigint, sum binary"), TOPICS * DIM)[1].reshape(TOPICS, DIM)
        means = np.where(new.any(1, keepdims=True), unit(new), means)
        shared.destroy()

    def label(batches):
        for part in sliced(batches, 1024):
            size, row, dim, count = opened(part)
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], part.column("tokens"), names_of(assign(size, row, dim, count * weight[dim], means))], [*keys, "tokens", "topic"])

    return (weight, means), rows.mapInArrow(label, f"{has}, tokens bigint, topic string")


def names_of(topic: np.ndarray) -> pa.Array:
    names = [*[f"t{k:02d}" for k in range(TOPICS)], "-"]
    return pa.array([names[k] for k in topic.tolist()], pa.string())


def _summed(parts: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """(n, sum) of whole-numbered arrays: 16 tasks add up all, one adds up their 16, and one row comes to the driver."""

    def add(batches):
        total, n = np.zeros(width, np.int64), 0
        for b in batches:
            for k, x in zip(b.column("n").to_pylist(), b.column("sum").to_pylist()):
                total, n = total + np.frombuffer(x, np.int64), n + k
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["n", "sum"])

    for tasks in (16, 1):
        parts = parts.repartition(tasks).mapInArrow(add, "n bigint, sum binary")
    got = parts.collect()  # one row
    return (got[0]["n"], np.frombuffer(got[0]["sum"], np.int64)) if got else (0, np.zeros(width, np.int64))


def with_topics(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """All columns of docs, and mix_tokens and mix_topic ("-" for a text without a telling word)."""
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at, out = names.index("text"), [*rows.columns, "mix_tokens", "mix_topic"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TOPICS x DIM numbers

    def run(batches):
        weight, means = shared.value
        for part in sliced(batches):
            size, row, dim, n = bags(utf8(part.column(at)))
            topic = assign(len(size), row, dim, n * weight[dim], means)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(size), names_of(topic)], out)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    got = rows.mapInArrow(run, f"{schema}, mix_tokens bigint, mix_topic string")
    return got.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "mix_tokens", "mix_topic")


def rake(cells: np.ndarray, tokens: np.ndarray, targets: list[np.ndarray], steps: int = 500, close: float = 1e-9) -> np.ndarray:
    """Weights of the cells under which each dimension's shares of the tokens meet its targets.

    cells: the value of each dimension by number; targets: a share for each value. Values that no cell has
    are left out and the other targets scaled up. Where the targets contradict each other the weights of the
    last step are returned, which meet the last dimension.
    """
    w, total = np.ones(len(tokens)), float(tokens.sum())
    if not total:
        return w
    goals = []
    for d, t in enumerate(targets):
        there = np.bincount(cells[:, d], tokens, len(t)) > 0
        t = np.where(there, t, 0.0)
        goals.append(total * t / t.sum() if t.sum() else np.bincount(cells[:, d], tokens, len(t)))
    for _ in range(steps):
        off = 0.0
        for d, goal in enumerate(goals):
            now = np.bincount(cells[:, d], tokens * w, len(goal))
            factor = np.divide(goal, now, out=np.ones_like(goal), where=now > 0)
            w *= factor[cells[:, d]]
            off = max(off, float(np.abs(factor - 1).max()))
        if off < close:
            break
    return w


def filled(goal: np.ndarray, most: np.ndarray, total: float) -> np.ndarray:
    """min(most, goal * rate), at the rate that makes the sum ``total`` (or as much of it as ``most`` allows)."""
    total, free, out = min(total, float(most.sum())), goal > 0, np.zeros(len(goal))
    while free.any():
        rate = max(0.0, total - float(out[~free].sum())) / float(goal[free].sum())
        over = free & (goal * rate > most)
        if not over.any():
            out[free] = goal[free] * rate
            break
        out[over], free = most[over], free & ~over
    return out


def probabilities(w: np.ndarray, tokens: np.ndarray, keep: float, cells: np.ndarray | None = None, steps: int = 500, close: float = 1e-9) -> np.ndarray:
    """Probabilities of 1 at most, so that ``keep`` of the tokens are expected to stay in the shares that the weights give.

    They start at weight times a common rate. Where 1 cuts one off, the cells that aren't cut off are raked again, so
    that each value of each dimension still gets its share; a value with too few tokens gives all it has, and the
    others of its dimension share what is missing. Without cells only the total is met.
    """
    total = keep * float(tokens.sum())
    p = np.divide(filled(tokens * w, tokens, total), tokens, out=np.minimum(1.0, w * keep), where=tokens > 0)
    if cells is None or not total or not (w * keep > 1)[tokens > 0].any():
        return p
    goals = []
    for d in range(cells.shape[1]):
        n = int(cells[:, d].max()) + 1
        goals.append(filled(np.bincount(cells[:, d], tokens * w, n), np.bincount(cells[:, d], tokens, n), total))
    for _ in range(steps):
        off = 0.0
        for d, goal in enumerate(goals):
            capped = p >= 1
            kept = np.bincount(cells[capped, d], tokens[capped], len(goal))
            free = np.bincount(cells[~capped, d], (tokens * p)[~capped], len(goal))
            factor = np.divide(np.maximum(goal - kept, 0.0), free, out=np.ones(len(goal)), where=free > 0)
            over = kept > goal * (1 + 1e-12)
            now = np.minimum(1.0, np.where(capped & ~over[cells[:, d]], p, p * np.where(over, np.divide(goal, kept + free, out=np.ones(len(goal)), where=kept + free > 0), factor)[cells[:, d]]))
            off, p = max(off, float(np.abs(now - p).max())), now
        if off < close:
            break
    return p


def tempered(share: np.ndarray, power: float, fixed: np.ndarray) -> np.ndarray:
    """Shares raised to a power and made to sum to one; those of fixed values stay what they are."""
    share = share / max(1.0, float(share.sum()))
    out = np.where((share > 0) & ~fixed, np.maximum(share, 1e-300) ** power, 0.0)
    free = 1 - float(share[fixed].sum())
    return np.where(fixed, share, out * free / out.sum() if out.sum() else out)


def _here(spark: SparkSession, cells: DataFrame, targets: dict, keep: float) -> DataFrame:
    """The cells with their weight and probability, raked on the driver: DRIVER_CELLS rows at most."""
    small = cells.orderBy(*KEYS).toArrow().to_pydict()
    at = {d: {v: i for i, v in enumerate(sorted(set(small[k])))} for d, k in zip(DIMENSIONS, KEYS)}
    grid = np.array([[at[d][v] for v in small[k]] for d, k in zip(DIMENSIONS, KEYS)], np.int64).reshape(3, -1).T
    tokens, goals = np.array(small["tokens"], float), []
    for i, d in enumerate(DIMENSIONS):
        share = np.bincount(grid[:, i], tokens, len(at[d]))
        given = targets.get(d)
        goals.append(shares_given(list(at[d]), share, given) if given else tempered(share, TEMPER[d], np.array([v == "-" for v in at[d]], bool)))
    w = rake(grid, tokens, goals)
    p = probabilities(w, tokens, keep, grid)
    return spark.createDataFrame(list(zip(*[small[k] for k in KEYS], w.tolist(), p.tolist())), ", ".join(f"{k} string" for k in KEYS) + ", mix_weight double, mix_probability double")


def shares_given(values: list[str], tokens: np.ndarray, given: dict[str, float]) -> np.ndarray:
    """The targets of the values; those without one share the target of "(other)" by their tokens."""
    rest = np.array([v not in given for v in values], bool)
    out = np.array([given.get(v, 0.0) for v in values])
    other = float(tokens[rest].sum())
    return np.where(rest, given.get("(other)", 0.0) * tokens / other, out) if other else out


def _spread(cells: DataFrame, targets: dict, keep: float, scratch: Scratch, steps: int = 500, close: float = 1e-9) -> DataFrame:
    """The same for any number of cells, by an aggregate and a join a dimension and step, until nothing moves by more than ``close``."""
    one = F.lit(1.0)
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    sized, goals = cells, {}
    for d, k in zip(DIMENSIONS, KEYS):
        share = cells.groupBy(k).agg((F.sum("tokens") / F.lit(max(total, 1.0))).alias("share"))
        given = targets.get(d)
        if given:
            named = cells.sparkSession.createDataFrame([(v, float(t)) for v, t in given.items()], "name string, given double")  # as many as the caller names
            share = share.join(F.broadcast(named), share[k] == named.name, "left").drop("name")
            other = float(share.where("given IS NULL").agg(F.sum("share")).first()[0] or 0)
            share = share.select(k, "share", F.coalesce("given", F.col("share") * F.lit(given.get("(other)", 0.0) / other if other else 0.0)).alias("goal"))
        else:
            raised = F.when((F.col("share") > 0) & (F.col(k) != "-"), F.pow("share", F.lit(TEMPER[d]))).otherwise(0.0)
            sums = share.agg(F.sum(raised), F.sum(F.when(F.col(k) == "-", F.col("share")))).first()
            share = share.select(k, "share", F.when(F.col(k) == "-", F.col("share")).otherwise(raised * F.lit((1 - (sums[1] or 0.0)) / sums[0] if sums[0] else 0.0)).alias("goal"))
        live = float(share.where("share > 0").agg(F.sum("goal")).first()[0] or 0)
        goals[k] = scratch.table(share.select(k, F.when(F.col("share") > 0, F.col("goal") / F.lit(live or 1.0)).otherwise(0.0).alias("goal")), f"goals{k}")
    now = scratch.table(sized.withColumn("mix_weight", one), "raked")
    for _ in range(steps):
        off = 0.0
        for k in KEYS:
            sums = now.groupBy(k).agg(F.sum(F.col("tokens") * F.col("mix_weight")).alias("now")).join(goals[k], k)
            factor = scratch.table(sums.select(k, F.when(F.col("now") > 0, F.col("goal") * F.lit(total) / F.col("now")).otherwise(1.0).alias("factor")), "factors")
            off = max(off, float(factor.agg(F.max(F.abs(F.col("factor") - 1))).first()[0] or 0))
            nxt = scratch.table(now.join(factor, k).withColumn("mix_weight", F.col("mix_weight") * F.col("factor")).select(*KEYS, "tokens", "mix_weight"), "raked")
            scratch.drop(now, factor)
            now = nxt
        if off < close:
            break
    # p = min(1, p * factor): a value that is short of its goal is raised through the cells that 1 hasn't cut off
    p = scratch.table(now.withColumn("p", F.least(F.lit(1.0), F.col("mix_weight") * F.lit(keep))), "kept")
    free = F.when(F.col("p") < 1, F.col("tokens") * F.col("p")).otherwise(0.0)
    for _ in range(steps):
        off = 0.0
        for k in KEYS:
            sums = p.groupBy(k).agg(F.sum(free).alias("free"), F.sum(F.when(F.col("p") >= 1, F.col("tokens")).otherwise(0)).alias("cut"), F.sum("tokens").alias("all")).join(goals[k], k)
            goal = F.least(F.col("all").cast("double"), F.col("goal") * F.lit(total * keep))
            factor = scratch.table(sums.select(k, F.when(F.col("cut") > goal, goal / (F.col("cut") + F.col("free"))).when(F.col("free") > 0, (goal - F.col("cut")) / F.col("free")).otherwise(1.0).alias("factor"), (F.col("cut") > goal).alias("over")), "factors")
            new = F.when((F.col("p") < 1) | F.col("over"), F.least(F.lit(1.0), F.col("p") * F.col("factor"))).otherwise(F.col("p"))
            nxt = scratch.table(p.join(factor, k).withColumn("moved", F.abs(new - F.col("p"))).withColumn("p", new).select(*KEYS, "tokens", "mix_weight", "p", "moved"), "kept")
            off = max(off, float(nxt.agg(F.max("moved")).first()[0] or 0))
            scratch.drop(p, factor)
            p = nxt.drop("moved")
            p._scratch_path = nxt._scratch_path
        if off < close:
            break
    return p.select(*KEYS, "mix_weight", F.col("p").alias("mix_probability"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, seed: int = 0, with_text: bool = True) -> DataFrame:
    """All rows and columns of docs (without the text, if it isn't wanted: this saves a pass over the texts), and mix_tokens, mix_topic, mix_weight, mix_probability, mix_kept.

    Topics are TOPICS means of a k-means over the hashed words of all texts. targets: for source, lang and topic, the
    share of the tokens that each value is to have ("(null)" for null; values without a name share "(other)", or
    nothing, by their tokens); a dimension without targets gets each value's share of the tokens raised to
    TEMPER (texts without a topic keep their share). Every value has its own marginal, however many there are. Weights
    of the cells of the three are raked to these; a document's probability is its cell's weight times a common
    rate, and where 1 cuts one off the others are raked again, so that ``keep`` of the tokens are expected
    to stay in the wanted shares, as far as there are tokens enough. Whether a document is kept follows from a
    hash of its id alone, so it doesn't depend on partitions or retries. Null ids hash alike; null or empty texts have no
    tokens and their cell's probability (a cell without any tokens has the weight that its values have
    elsewhere). Columns of docs named like a result are replaced. Empty tables give no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mixing")
    new = {"mix_tokens", "mix_topic", "mix_weight", "mix_probability", "mix_kept"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new])
    value = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col("mix_topic")}
    keyed = {k: F.coalesce(value[d].cast("string"), F.lit("(null)")) for d, k in zip(DIMENSIONS, KEYS)}
    names = [] if with_text else [c for c in docs.columns if c != "text"]
    named = docs.select("text", *[keyed[k].alias(k) for k in KEYS[:2]], *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    model, labelled = topic_model(named, scratch)
    cells = labelled.groupBy(*KEYS[:2], F.col("topic").alias(KEYS[2])).agg(F.sum("tokens").alias("tokens"))
    cells = scratch.table(cells, "cells")
    few = cells.count() <= DRIVER_CELLS
    table = _here(spark, cells, targets or {}, keep) if few else scratch.table(_spread(cells, targets or {}, keep, scratch), "weights")
    right = table.withColumnsRenamed({k: f"{k}_of" for k in KEYS})
    if with_text:
        rows = with_topics(docs, model)
    else:
        rows = labelled.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("tokens").alias("mix_tokens"), F.col("topic").alias("mix_topic"))
    on = [c == F.col(f"{k}_of") for k, c in keyed.items()]
    out = rows.join(F.broadcast(right) if few else right, on, "left")  # DRIVER_CELLS short rows at most are broadcast
    unit_ = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11) / F.lit(float(1 << 53))
    return out.select(*[rows[f"`{c}`"] for c in rows.columns], "mix_weight", "mix_probability", (unit_ < F.col("mix_probability")).alias("mix_kept"))


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source", "lang"), with_text=False)
    return got.select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_weight").alias("weight"), F.col("mix_probability").alias("probability"), F.col("mix_kept").alias("kept"))
