"""SimHash near copies of word shingles: wide fingerprints compared in tiles, every link verified by its exact similarity."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, map_batches, pick, words_of
from .simhash import SUB, majority

#: Words of a shingle, and the least similarity of a link.
SHINGLE, LEAST = 5, Fraction(4, 5)
#: 64-bit words of a fingerprint; the first half of them is compared first.
WIDE = 4
#: Bits that may differ: in each half, and in all 256. Sets of similarity 0.8 differ in 39 of 256 bits (deviation 6), those of a
#: few shingles in 48; unrelated ones in 128 (deviation 8).
RADIUS_HALF, RADIUS = 44, 76
#: Sets of fewer shingles than this have no other set of similarity 0.8.
SMALL = 4
#: Sets in a tile, and bytes of its whole sets where these travel along, at the mean.
TILE, TILE_BYTES = 32768, 32 << 20
_STEPS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the word shingles, ascending, each copy of a shingle with one of its own; fewer words are one
    shingle, no words none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    digest, known = xxhash.xxh64_intdigest, {}
    h = np.fromiter((known[w] if w in known else known.setdefault(w, digest(w)) for w in words), np.uint64, len(words))
    size = min(shingle, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mixed(out ^ h[k : k + len(out)], np.uint64(0x9E3779B97F4A7C15))
    out.sort()
    nth = np.arange(len(out)) - np.searchsorted(out, out)  # the second copy of a shingle is another member
    return np.unique(out ^ nth.astype(np.uint64) * np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray, step: np.uint64) -> np.ndarray:
    x = x * step
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def node_of(s: np.ndarray) -> int:
    """A signed number that stands for a set of shingles: texts of equal sets are one node."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64))


def wide_fingerprint(s: np.ndarray) -> np.ndarray:
    """WIDE words of majority bits, each from another hash of the shingles."""
    return np.concatenate([majority(s), *[majority(_mixed(s, step)) for step in _STEPS[: WIDE - 1]]])


def _bounds(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[slice]]:
    cuts = [slice(i, i + SUB) for i in range(0, len(n), SUB)]
    return np.array([n[c].min() for c in cuts]), np.array([n[c].max() for c in cuts]), cuts


def candidates(a: tuple, b: tuple, same: bool, least: Fraction = LEAST):
    """Pairs (x, y, bits) of places in two tiles (n, fp) sorted by n: sizes that can be similar, fingerprints within the radius.

    Sub-tiles are skipped where their sizes already rule the similarity out.
    """
    (n, fp), (m, gp) = a, b
    p, q, half = least.numerator, least.denominator, WIDE // 2
    alo, ahi, acuts = _bounds(n)
    blo, bhi, bcuts = _bounds(m)
    for i, cut in enumerate(acuts):
        for j in np.flatnonzero((bhi * q >= alo[i] * p) & (ahi[i] * q >= blo * p)):
            if same and j < i:
                continue
            far = np.bitwise_count(fp[0][cut][:, None] ^ gp[0][bcuts[j]][None, :])
            for k in range(1, half):
                far += np.bitwise_count(fp[k][cut][:, None] ^ gp[k][bcuts[j]][None, :])
            x, y = np.nonzero(far <= RADIUS_HALF)
            if not len(x):
                continue
            first = far[x, y].astype(np.int64)
            x, y = x + cut.start, y + bcuts[j].start
            rest = sum(np.bitwise_count(fp[k][x] ^ gp[k][y]).astype(np.int64) for k in range(half, WIDE))
            ok = (rest <= RADIUS_HALF) & (first + rest <= RADIUS) & (np.minimum(n[x], m[y]) * q >= np.maximum(n[x], m[y]) * p)
            if same:
                ok &= x < y
            if ok.any():
                yield x[ok], y[ok], (first + rest)[ok]


def leads(a: tuple, b: tuple, same: bool, least: Fraction = LEAST) -> np.ndarray:
    """For every set of two tiles its nearest candidate, and the one that has the most close candidates of its own."""
    size, off = len(a[0]) + (0 if same else len(b[0])), 0 if same else len(a[0])
    near, at, close = np.full(size, 1 << 20), np.full(size, -1), np.zeros(size, np.int64)

    def better(x, y, key, best, who):
        order = np.lexsort((y, key, x))
        x, y, key = x[order], y[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        x, y, key = x[first], y[first], key[first]
        take = key < best[x]
        best[x[take]], who[x[take]] = key[take], y[take]

    for x, y, bits in candidates(a, b, same, least):
        y = y + off
        better(x, y, bits, near, at)
        better(y, x, bits, near, at)
        tight = bits <= RADIUS * 2 // 3
        close += np.bincount(x[tight], minlength=size) + np.bincount(y[tight], minlength=size)
    if not (at >= 0).any():
        return np.empty((0, 2), np.int64)
    most, hub = np.full(size, 1), np.full(size, -1)
    for x, y, _ in candidates(a, b, same, least):
        y = y + off
        better(x, y, -close[y], most, hub)
        better(y, x, -close[x], most, hub)
    who = np.arange(size)
    pairs = np.concatenate([np.stack([who, w], 1)[w >= 0] for w in (at, hub)])
    return np.unique(np.sort(pairs, axis=1), axis=0)


def linked(x: np.ndarray, y: np.ndarray, a: tuple, b: tuple, parent: dict, least: Fraction = LEAST) -> list[tuple[int, int]]:
    """The candidates (x, y) of two tiles (roots, n, offsets, sets) that hold by their whole sets and join what wasn't joined yet."""

    def top(r):
        while (up := parent.get(r, r)) != r:
            r = up
        return r

    out = []
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    for lo, hi in zip(np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])), [*(np.flatnonzero(x[1:] != x[:-1]) + 1), len(x)]):
        i, mine = int(x[lo]), a[3][a[2][x[lo]] : a[2][x[lo] + 1]]
        js = np.array([j for j in y[lo:hi].tolist() if top(int(b[0][j])) != top(int(a[0][i]))], np.int64)
        for js in np.array_split(js, max(1, -(-int(b[1][js].sum()) // (1 << 22)))) if len(js) else ():  # words held at a time
            if not len(js):
                continue
            size = b[1][js]
            starts = np.cumsum(size) - size
            other = b[3][np.repeat(b[2][js] - starts, size) + np.arange(int(size.sum()))]
            at = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
            same = np.add.reduceat((mine[at] == other).astype(np.int64), starts)
            for j in js[same * least.denominator >= least.numerator * (len(mine) + size - same)].tolist():
                p, q = top(int(a[0][i])), top(int(b[0][j]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((i, j))
    return out


def tile_pairs(nodes: DataFrame, scratch: Scratch, want: str, least: Fraction = LEAST, tile: int = TILE) -> DataFrame:
    """(a, b): of nodes(node, n, fp, root) the pairs of ``leads``; or (a = b) the ``open`` nodes, which have a candidate of another
    root; or, of nodes with their sets s, the ``links`` between different roots, each verified where its tiles meet, as a forest.

    Nodes are dealt into tiles by bands of their size, each 1 / least times as wide as the one before, so that a tile
    meets its own band and the next one alone. A tile travels as packed arrays. The work grows with the square of the
    sets in a band; memory for a task is two tiles, whatever the size.
    """
    spark, wide = nodes.sparkSession, float(1 / least)
    band = F.floor(F.log("n") / F.lit(float(np.log(wide))) + F.lit(1e-9)).cast("int")
    banded = nodes.withColumn("band", band)
    whole = want == "links"
    sizes = banded.groupBy("band").agg(F.count("*").alias("n"), F.sum("n").alias("words")).collect()  # a few dozen bands
    parts = {r["band"]: max(-(-r["n"] // tile), -(-8 * r["words"] // TILE_BYTES) if whole else 1) for r in sizes}
    if not parts:
        return spark.createDataFrame([], "a bigint, b bigint")
    meta = spark.createDataFrame(sorted(parts.items()), "band int, parts int")
    dealt = banded.join(F.broadcast(meta), "band").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    packed = dealt.groupBy("band", "part").agg(F.sort_array(F.collect_list(F.struct("n", "node", "root", "fp", *["s"] * whole))).alias("s"))  # tile rows, at the mean
    packed = scratch.table(packed.select("band", "part", *[F.col(f"s.{c}").alias(c) for c in ("n", "node", "root")], F.flatten("s.fp").alias("fp"), *[F.flatten("s.s").alias("sets")] * whole), "tiles")
    cols = ["n", "node", "root", "fp", *["sets"] * whole]
    left = packed.select("*", F.explode(F.array("band", F.col("band") + 1)).alias("other")).join(F.broadcast(meta.selectExpr("band AS other", "parts")), "other")
    left = left.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("opart")).where("other > band OR opart >= part")
    right = packed.selectExpr("band AS other", "part AS opart", *[f"{c} AS o_{c}" for c in cols])
    n_pairs = sum(k * (k + parts.get(b + 1, 0)) for b, k in parts.items())
    pairs = left.join(right, ["other", "opart"]).repartition(max(1, min(n_pairs, 20000)), "band", "part", "other", "opart")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                col = {c: row.column(c).flatten().to_numpy(zero_copy_only=False) for c in row.schema.names if row.schema.field(c).type.num_fields}
                same = row.column("band").equals(row.column("other")) and row.column("part").equals(row.column("opart"))
                a, b = ((col[o + "n"].astype(np.int64), np.ascontiguousarray(col[o + "fp"].view(np.uint64).reshape(-1, WIDE).T)) for o in ("", "o_"))
                node, root = ([col[c], col[c] if same else col[f"o_{c}"]] for c in ("node", "root"))
                if want == "leads":
                    pair = np.concatenate(node)[leads(a, b, same, least)] if not same else node[0][leads(a, b, same, least)]
                    pair = np.sort(pair.reshape(-1, 2), axis=1)
                elif want == "open":
                    open_ = [np.zeros(len(node[0]), bool), np.zeros(len(node[1]), bool)]
                    for x, y, _ in candidates(a, b, same, least):
                        apart = root[0][x] != root[1][y]
                        open_[0][x[apart]], open_[1][y[apart]] = True, True
                    some = np.concatenate([node[0][open_[0]], node[1][open_[1]]])
                    pair = np.stack([some, some], 1)
                else:
                    sides = [(r, n, np.concatenate([[0], np.cumsum(n)]), s.view(np.uint64)) for r, n, s in zip(root, (a[0], b[0]), (col["sets"], col["sets"] if same else col["o_sets"]))]
                    got, parent = [], {}
                    for x, y, _ in candidates(a, b, same, least):
                        got += linked(x, y, *sides, parent, least)
                    pair = np.array([(node[0][i], node[1][j]) for i, j in got], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, i])) for i in (0, 1)], ["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity."""
    both = pairs.join(sets.selectExpr("node AS a", "s AS sa"), "a").join(sets.selectExpr("node AS b", "s AS sb"), "b").select("a", "b", "sa", "sb")

    def run(part):
        good = []
        for x, y in zip(part.column("sa"), part.column("sb")):
            x, y = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            same = int((y[at] == x).sum())
            good.append(same * least.denominator >= least.numerator * (len(x) + len(y) - same))
        keep = pa.array(good, pa.bool_())
        return {"a": part.column("a").filter(keep), "b": part.column("b").filter(keep)}

    return map_batches(both, run, "a bigint, b bigint")


def text_groups(docs: DataFrame, least: Fraction = LEAST) -> DataFrame:
    """(t, group): of each distinct text of docs its xxhash64 and its group, equal for texts that chains of links reach; nulls
    have the hash that Spark gives them.

    A link joins two texts whose five-word shingles have a Jaccard similarity of ``least`` (0.8 or more) or more. Shingles
    count as often as they stand in a text and are compared by 64-bit hashes. Texts of equal shingles are one node;
    null and word-less texts are one group. SimHash fingerprints of 256 bits, compared exactly in tiles, propose
    pairs: those within a radius that a pair of the similarity exceeds once in 10,000 cases at the very threshold, hardly
    ever above it. The exact similarity of every proposed pair decides. First each node meets two others
    of each tile (its nearest one, and the one with most close ones); after that all proposed pairs that this
    hasn't joined are verified where their tiles meet, which then hold the sets of what is still open, so that no pair ever
    travels and a large group of near copies makes no more rows than it has members. Whoever has a candidate is in a pair of the
    first step, so texts are fetched for their sets once. Empty tables give no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "nearcopies")
    keyed = pick(docs, "text").where("text IS NOT NULL").select(F.xxhash64("text").alias("t"), "text")

    def first(part):
        sets = [shingles(t) for t in part.column("text").to_pylist()]
        prints = np.concatenate([np.empty(0, np.uint64), *[wide_fingerprint(s) if len(s) >= SMALL else np.zeros(WIDE, np.uint64) for s in sets]]).view(np.int64)
        ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * WIDE)
        return {"t": part.column("t"), "node": pa.array([node_of(s) for s in sets], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int32()), "fp": pa.ListArray.from_arrays(ends, pa.array(prints))}

    own = scratch.table(map_batches(keyed, first, "t bigint, node bigint, n int, fp array<bigint>"), "own")
    nodes = own.where(F.col("n") >= SMALL).groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.min("t").alias("t"))
    nodes = scratch.table(nodes.withColumn("root", F.col("node")), "nodes")

    pairs = scratch.table(tile_pairs(nodes, scratch, "leads", least).distinct(), "pairs")
    wanted = pairs.selectExpr("a AS node").union(pairs.selectExpr("b AS node")).distinct()
    wanted = scratch.table(nodes.join(wanted, "node").select("node", "t"), "wanted")
    full = keyed.join(wanted, "t").groupBy("node").agg(F.first("text").alias("text"))  # of each node one text

    def whole(part):
        return {"node": part.column("node"), "s": pa.array([shingles(t).view(np.int64) for t in part.column("text").to_pylist()], pa.list_(pa.int64()))}

    sets = scratch.table(map_batches(full, whole, "node bigint, s array<bigint>"), "sets")
    edges = scratch.table(verified(pairs, sets, least), "links")
    comp = components(spark, edges, scratch)
    joined = scratch.table(nodes.drop("root").join(comp, "node", "left").withColumn("root", F.coalesce("root", "node")), "joined")
    rest = scratch.table(tile_pairs(joined, scratch, "open", least).select(F.col("a").alias("node")).distinct(), "rest")
    open_ = joined.join(sets.join(rest, "node", "left_semi"), "node")
    edges = edges.unionByName(scratch.table(tile_pairs(open_, scratch, "links", least), "more"))
    comp = components(spark, edges, scratch)
    empty = node_of(np.empty(0, np.uint64))
    group = own.select("t", "node").distinct().join(comp, "node", "left").select("t", F.coalesce("root", "node").alias("group"))
    nulls = pick(docs, "text").where("text IS NULL").select(F.xxhash64("text").alias("t"), F.lit(empty).alias("group"))
    group = scratch.table(group.unionByName(nulls.distinct()).groupBy("t").agg(F.min("group").alias("group")), "groups")
    scratch.only(group)
    return group


def near_copies(docs: DataFrame, least: Fraction = LEAST) -> DataFrame:
    """All rows and columns of docs, and ``group`` as in ``text_groups``; a column of docs named group is replaced."""
    group = text_groups(docs, least).select(F.col("t").alias("__t"), F.col("group").alias("__group"))
    got = docs.join(group, F.xxhash64(docs["text"]) == group["__t"])
    return got.select(*[docs[f"`{c}`"] for c in docs.columns if c != "group"], F.col("__group").alias("group"))


def representatives(docs: DataFrame, least: Fraction = LEAST) -> DataFrame:
    """One row of each group of ``text_groups``, with the columns of docs: the one of least doc_id, null ids last; of equal ids the one of
    least text hash, and any one of rows that agree in both.

    Ids and hashes choose; then texts travel once, by their hash, exact copies reduced to one row a task before.
    """
    t, names = F.xxhash64("text").alias("__t"), docs.columns
    order = F.struct(F.isnull("doc_id"), "doc_id")
    group = text_groups(docs, least)
    ids = pick(docs, "doc_id", "text").groupBy(t).agg(F.min(order).alias("id"))
    best = ids.join(group, ids["__t"] == group["t"]).groupBy("group").agg(F.min(F.struct("id", "t")).alias("best")).select(F.col("best.t").alias("__t"))
    rows = docs.groupBy(t).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in names]), order).alias("kept"))
    return rows.join(best, "__t", "left_semi").select(*[F.col(f"kept.`{c}`") for c in names])
