"""Nearest neighbours: inverted file of coarse centroids, product-quantised residuals, exact reranking with bounds on what was passed over."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, pick

#: Share of the true neighbours within the sample that the lists a query looks into must hold.
TARGET = 0.97
#: Vectors that centroids and codebooks are fitted on at most: those whose hashed id comes first.
FIT_ROWS = 20_000
#: Rows of one block of an inverted list, at the mean: a longer list is dealt into more blocks by hash.
BLOCK = 4096
#: Queries that meet a block in one task, at the mean, and in one batch of it.
QUERY_GROUP, QUERY_BATCH = 8192, 256
#: Rows, and queries at the mean, that meet in one task when lists that weren't probed are looked into, and rows that are scored at a time.
TILE, SLAB = 1 << 16, 8192

FOUND = pa.schema([("qid", pa.int64()), ("score", pa.float64()), ("h", pa.int64()), ("ids", pa.list_(pa.int64()))])


def kmeans(x: np.ndarray, k: int, steps: int = 12, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(steps):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        full = n > 0
        c[full] = np.add.reduceat(x[order], at[full], axis=0) / n[full, None]
        if (~full).any():
            c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def fit(sample: np.ndarray, lists: int, parts: int, codes: int) -> tuple:
    """(coarse centroids, cuts, books): books holds a codebook of residuals for each cut of the components."""
    d = sample.shape[1]
    cuts = [(round(i * d / min(parts, d)), round((i + 1) * d / min(parts, d))) for i in range(min(parts, d))]
    coarse = kmeans(sample, lists)
    rest = sample - coarse[nearest(sample, coarse)]
    return coarse, cuts, [kmeans(rest[:, a:b], codes, seed=i + 1) for i, (a, b) in enumerate(cuts)]


def encode(index: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    coarse, cuts, books = index
    at = nearest(x, coarse)
    rest = x - coarse[at]
    return at, np.stack([nearest(rest[:, a:b], book) for (a, b), book in zip(cuts, books)], 1).astype(np.uint8)


def distance_tables(index: tuple, q: np.ndarray) -> np.ndarray:
    """Inner products of each query with every code word: queries x parts x codes."""
    _, cuts, books = index
    out = np.zeros((len(q), len(cuts), max(map(len, books))), np.float32)
    for i, ((a, b), book) in enumerate(zip(cuts, books)):
        out[:, i, : len(book)] = q[:, a:b] @ book.T
    return out


def probes_for(index: tuple, sample: np.ndarray, k: int, target: float = TARGET, tries: int = 256) -> int:
    """The fewest lists that hold ``target`` of the k nearest rows of the sample, over some of its rows."""
    q = sample[:tries]
    near = q @ sample.T
    near[np.arange(len(q)), np.arange(len(q))] = -np.inf
    best = np.argsort(-near, axis=1)[:, : max(1, min(k, len(sample) - 1))]
    order = np.argsort(-(q @ index[0].T), axis=1)
    place = np.empty_like(order)
    place[np.arange(len(q))[:, None], order] = np.arange(order.shape[1])
    at = place[np.arange(len(q))[:, None], nearest(sample, index[0])[best]]
    return next(p for p in range(1, len(index[0]) + 1) if (at < p).mean() >= target or p == len(index[0]))


def scores(q: np.ndarray, v: np.ndarray, qi: np.ndarray, vi: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, the same for a pair whatever the others are."""
    return np.concatenate([np.einsum("nd,nd->n", q[qi[i : i + 16384]], v[vi[i : i + 16384]]) for i in range(0, len(qi), 16384)] or [np.zeros(0)])


def best_pairs(qi: np.ndarray, vi: np.ndarray, score: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best pairs of each query by score, then by the smaller id."""
    order = np.lexsort((first[vi], -score, qi))
    by = qi[order]
    start = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]])) if len(by) else np.zeros(0, np.int64)
    rank = np.arange(len(by)) - np.repeat(start, np.diff(np.concatenate([start, [len(by)]])))
    return order[rank < k]


def usable(vectors: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector is neither null nor zero and holds only finite numbers."""
    ok = F.expr(f"`{vec}` IS NOT NULL AND size(`{vec}`) > 0 AND forall(`{vec}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(`{vec}`, x -> x <> 0)")
    return vectors.where(ok)


def neighbours(vectors: DataFrame, queries, k: int = 20, lists: int | None = None, probes: int | None = None, parts: int = 16, codes: int = 256, rerank: int = 64, fit_rows: int = FIT_ROWS, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k rows of largest inner product found for each query.

    vectors: vec_id and embedding; queries: a condition on vec_id. All rows are indexed; centroids and
    codebooks are fitted on at most ``fit_rows`` of them. A query looks into the ``probes`` lists whose
    centroids have the largest inner product with it (as many as hold TARGET of the neighbours within the
    sample, if not given); tables of its inner products with the code words
    rank what is there, and the best ``rerank`` of each block get their exact score in double precision, as does every other row
    that could still be among the best by its distance from its code. Then the lists not probed follow whose radius or norms leave room for
    a nearer row than those found. So no neighbour is lost whatever the rows; where the bounds exclude little, this is
    brute force over blocks.
    A query meets every row but its own (a repeated row or id is a row like any other, and a query of its own); ties go to the smaller vec_id. Rows with the same vector are indexed
    once, with their k + 1 smallest ids, beyond which none can be among k neighbours; queries with the same
    vector are searched once. Vectors that are null, zero or not finite, or whose length is not the most
    frequent one, take no part, nor do null ids. Empty tables give no rows.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "ann")
    rows = usable(pick(vectors, "vec_id", "embedding").where("vec_id IS NOT NULL"), "embedding").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if sizes is None:
        return empty
    rows = rows.where(F.size("v") == sizes["d"]).select("vec_id", "v", F.xxhash64("v").alias("h"))
    # Every query, and the k + 1 smallest ids of each distinct vector (limited before the shuffle).
    order = Window.partitionBy("h", "v").orderBy("vec_id")
    kept = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    distinct = scratch.table(kept.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "distinct")  # k + 1 ids at most
    asked = scratch.table(rows.where(queries), "asked")
    n = distinct.count()
    sample = [r["v"] for r in distinct.select("v", F.element_at("ids", 1).alias("i")).orderBy(F.xxhash64("i"), "i").limit(fit_rows).select("v").collect()]
    x = np.array(sample, float)
    index = fit(x, min(lists or max(1, min(4096, round(n**0.5 / 4))), len(x)), parts, codes)
    probes = probes or probes_for(index, x, k)
    shared = spark.sparkContext.broadcast(index)  # 4096 centroids at most

    def code_rows(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"))
                at, code = encode(shared.value, x)
                coarse, cuts, books = shared.value
                rest = x - coarse[at]
                off = rest - np.concatenate([book[code[:, i]] for i, book in enumerate(books)], 1)
                size = [pa.array(np.sqrt((y * y).sum(1))) for y in (off, rest, x)]
                yield pa.RecordBatch.from_arrays([b.column("h"), b.column("ids"), b.column("v"), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), *size], ["h", "ids", "v", "list", "code", "off", "far", "norm"])

    coded = scratch.table(distinct.mapInArrow(code_rows, "h bigint, ids array<bigint>, v array<double>, list int, code binary, off double, far double, norm double"), "coded")
    held = coded.groupBy("list").agg(F.count("*").alias("count"), F.max("far").alias("far"), F.max("norm").alias("norm")).collect()  # 4096 lists at most
    split = {r["list"]: -(-r["count"] // block) for r in held}
    once = asked.groupBy("h", "v").agg(F.min("vec_id").alias("least")).withColumn("qid", F.monotonically_increasing_id())
    once = scratch.table(once.select("qid", "h", "v"), "once")

    def probe(batches):
        for b in batches:
            if b.num_rows:
                near = np.argsort(-(_matrix(b.column("v")) @ shared.value[0].T), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("v"), pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], ["qid", "v", "lists"])

    probed = scratch.table(once.mapInArrow(probe, "qid bigint, v array<double>, lists array<int>"), "probed")
    goals = probed
    load = {r["list"]: r["count"] for r in goals.select(F.explode("lists").alias("list")).groupBy("list").count().collect()}  # 4096 lists at most
    where = spark.createDataFrame([(c, m, -(-load.get(c, 0) // QUERY_GROUP)) for c, m in sorted(split.items())], "list int, blocks int, chunks int")
    where = F.broadcast(where)
    # A long list is dealt into blocks and many queries into chunks: every chunk meets every block of its list.
    dealt = coded.drop("far").join(where, "list").withColumn("block", F.pmod(F.xxhash64("h", F.lit(7)), F.col("blocks")).cast("int"))
    dealt = dealt.where("chunks > 0").withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).drop("blocks", "chunks")
    goals = goals.select("qid", "v", F.explode("lists").alias("list")).join(where, "list")
    goals = goals.select("qid", "v", "list", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int").alias("chunk"))

    def search(q, b):
        """A chunk of queries in batches, against one block."""
        if not q.num_rows or not b.num_rows:
            return FOUND.empty_table()
        index, out = shared.value, []
        v, code, ids = _matrix(b.column("v")), np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1), b.column("ids").combine_chunks()
        hs, at = b.column("h").to_numpy(), int(b.column("list")[0].as_py())
        off, most = b.column("off").to_numpy(), float(b.column("norm").to_numpy().max())
        first = np.array([x[0] for x in ids.to_pylist()], np.int64)
        qv, qid = _matrix(q.column("v")), q.column("qid").to_numpy()
        room = 1e-5 * (np.sqrt((index[0][at] ** 2).sum()) + 4 * most + 4 * float(off.max()))  # what single precision may be off by
        for i in range(0, len(qv), QUERY_BATCH):
            part = qv[i : i + QUERY_BATCH]
            norm = np.sqrt((part * part).sum(1))
            tables, near = distance_tables(index, part), (part @ index[0][at]).astype(np.float32)
            rough = np.repeat(near[:, None], len(v), 1)
            for m in range(code.shape[1]):
                rough += tables[:, m, code[:, m]]
            take = np.argpartition(-rough, rerank, axis=1)[:, :rerank] if len(v) > rerank else np.broadcast_to(np.arange(len(v)), rough.shape)
            exact = np.einsum("brd,bd->br", v[take], part)
            least = np.partition(exact, -k - 1, axis=1)[:, -k - 1] if exact.shape[1] > k else np.full(len(part), -np.inf)
            least = least - 1e-12 * norm * most
            may = ~(rough + norm[:, None] * (off + room) < least[:, None])  # what isn't a number may be anything
            if may.sum() > may.size // 8:
                may = part @ v.T >= least[:, None]
            np.put_along_axis(may, take, True, axis=1)
            qi, vi = np.nonzero(may)
            score = scores(part, v, qi, vi)
            keep = best_pairs(qi, vi, score, first, k + 1)
            out.append((qid[i + qi[keep]], score[keep], vi[keep]))
        best = np.concatenate([o[2] for o in out])
        return pa.Table.from_arrays([pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([o[1] for o in out])), pa.array(hs[best]), ids.take(pa.array(best))], schema=FOUND)

    found = goals.groupBy("list", "block", "chunk").cogroup(dealt.groupBy("list", "block", "chunk")).applyInArrow(search, "qid bigint, score double, h bigint, ids array<bigint>")
    # the k + 1 best distinct vectors of a query hold the k + 1 best rows
    nearest_first = Window.partitionBy("qid").orderBy(F.desc("score"), F.element_at("ids", 1))
    top = scratch.table(found.withColumn("n", F.row_number().over(nearest_first)).where(F.col("n") <= k + 1).drop("n"), "found")
    top = top.unionByName(_beyond(probed, top, coded, held, index[0], k))
    top = top.withColumn("n", F.row_number().over(nearest_first)).where(F.col("n") <= k + 1)
    top = top.select("qid", "score", "h", F.explode("ids").alias("vec_id"))
    top = top.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    top = scratch.table(top.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score", "h"))).alias("best")), "top")  # k + 1 at most
    each = asked.join(once.select("h", "v", "qid"), ["h", "v"]).select(F.col("vec_id").alias("query_id"), F.col("h").alias("own"), "qid").join(top, "qid")
    each = each.withColumn("at", F.expr("array_position(transform(best, b -> b.vec_id = query_id AND b.h = own), true)"))  # one row that is the query's own
    out = each.select("query_id", F.posexplode(F.expr(f"slice(filter(best, (b, i) -> i + 1 <> at), 1, {k})")).alias("p", "b"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


def _beyond(probed: DataFrame, found: DataFrame, coded: DataFrame, held: list, coarse: np.ndarray, k: int) -> DataFrame:
    """(qid, score, h, ids) of rows in lists that a query wasn't ``probed`` in and that may be as near as the k + 1 ``found``.

    A list is left out where neither its radius about its centroid nor its largest norm leaves room for that. Lists are packed
    into tiles of TILE rows (longer ones are dealt into several); each tile meets each chunk of queries once.
    """
    spark, dealt, fill, tile = probed.sparkSession, [], 0, 0
    for r in sorted(held, key=lambda r: r["list"]):
        pieces = -(-r["count"] // TILE)
        for piece in range(pieces):
            if fill and fill + r["count"] // pieces > TILE:
                fill, tile = 0, tile + 1
            dealt.append((r["list"], piece, pieces, tile))
            fill += r["count"] // pieces
    far, norm = np.full(len(coarse), -np.inf), np.full(len(coarse), -np.inf)
    for r in held:
        far[r["list"]], norm[r["list"]] = r["far"], r["norm"]
    tiles: dict[int, list[int]] = {}
    for at, _, _, number in dealt:
        tiles.setdefault(number, []).append(at)
    shared = spark.sparkContext.broadcast((coarse, far, norm, tiles))  # 4096 centroids at most

    def need(batches):
        coarse, far, norm, tiles = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                q, least = _matrix(part.column("v")), part.column("least").to_numpy()
                size = np.sqrt((q * q).sum(1))[:, None]
                room = np.minimum(q @ coarse.T + size * far, size * norm) + 1e-9 * size * (far + norm)
                may = ~(room < least[:, None]) & (far >= 0)
                for row, lists in enumerate(part.column("lists").to_pylist()):
                    may[row, lists] = False
                for number, lists in tiles.items():
                    rows = np.flatnonzero(may[:, lists].any(1))
                    if len(rows):
                        some = part.take(pa.array(rows))
                        wanted = [np.array(lists, np.int32)[may[r, lists]] for r in rows]
                        yield pa.RecordBatch.from_arrays([some.column("qid"), some.column("v"), some.column("least"), pa.array(np.full(len(rows), number, np.int32)), pa.array(wanted, pa.list_(pa.int32()))], ["qid", "v", "least", "tile", "lists"])

    least = found.groupBy("qid").agg(F.when(F.count("*") > k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("least"))
    asked = probed.join(least, "qid", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    goals = asked.select("qid", "v", "lists", "least").mapInArrow(need, "qid bigint, v array<double>, least double, tile int, lists array<int>")
    chunks = max(1, -(-probed.count() // TILE))
    where = F.broadcast(spark.createDataFrame(dealt, "list int, piece int, pieces int, tile int"))  # a row a list and TILE rows
    rows = coded.select("h", "ids", "v", "list").join(where, "list").where(F.col("piece") == F.pmod(F.xxhash64("h", F.lit(11)), F.col("pieces")))
    rows = rows.select("h", "ids", "v", "list", "tile", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    goals = goals.withColumn("chunk", F.pmod(F.xxhash64("qid"), F.lit(chunks)).cast("int"))

    def search(q, b):
        if not q.num_rows or not b.num_rows:
            return FOUND.empty_table()
        qv, qid, least = _matrix(q.column("v")), q.column("qid").to_numpy(), q.column("least").to_numpy()
        asks = q.column("lists").combine_chunks()
        asker = np.repeat(np.arange(len(qv)), asks.value_lengths().to_numpy())
        asked, at = asks.flatten().to_numpy(), b.column("list").to_numpy()
        v, ids, hs = _matrix(b.column("v")), b.column("ids").combine_chunks(), b.column("h").to_numpy()
        first = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
        size, most, out = np.sqrt((qv * qv).sum(1)), float(np.sqrt((v * v).sum(1).max())), []
        for one in np.unique(asked):
            who, rows = asker[asked == one], np.flatnonzero(at == one)
            for j in range(0, len(rows), SLAB):
                some = rows[j : j + SLAB]
                x = v[some]
                for i in range(0, len(who), QUERY_BATCH):
                    part = who[i : i + QUERY_BATCH]
                    near = qv[part] @ x.T
                    floor = least[part]
                    if len(some) > k + 1 and np.isinf(floor).any():
                        floor = np.maximum(floor, np.partition(near, -k - 1, axis=1)[:, -k - 1])
                    qi, vi = np.nonzero(near >= (floor - 1e-12 * size[part] * most)[:, None])
                    score = scores(qv[part], x, qi, vi)
                    keep = best_pairs(qi, vi, score, first[some], k + 1)
                    out.append((qid[part[qi[keep]]], score[keep], some[vi[keep]]))
        if not out:
            return FOUND.empty_table()
        got = np.concatenate([o[2] for o in out])
        return pa.Table.from_arrays([pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([o[1] for o in out])), pa.array(hs[got]), ids.take(pa.array(got))], schema=FOUND)

    return goals.groupBy("tile", "chunk").cogroup(rows.groupBy("tile", "chunk")).applyInArrow(search, "qid bigint, score double, h bigint, ids array<bigint>")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
