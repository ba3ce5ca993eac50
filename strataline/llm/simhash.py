"""SimHash near-duplicates by tiled exact comparison of fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, map_batches, pick, words_of

#: Fingerprints in a tile (at the mean: fingerprints are dealt by hash) and in a sub-tile.
TILE, SUB = 65536, 256
#: Shingles whose bits are summed at a time, so that one very long document needs little memory.
CHUNK = 1 << 16


def majority(h: np.ndarray) -> np.ndarray:
    """One word (uint64, in an array of one): the bits set in more than half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        part = np.ascontiguousarray(h[at : at + CHUNK])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Majority of the bits of XXH64 over word shingles; no words give zero."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(shingle, len(words)) - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at : min(n, at + CHUNK)].tolist(), last[at : at + CHUNK].tolist())
        h = np.array([digest(joined[s:e], seed) for s, e in pairs], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and ``fp``, the 64-bit fingerprint as a signed bigint."""

    def run(part):
        fps = np.array([fingerprint(t, shingle) for t in part.column("__text").to_pylist()], np.uint64)
        return {n: part.column(n) for n in carry} | {"fp": fps.view(np.int64)}

    kept = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__text")
    return map_batches(kept, run, f"{schema}, fp bigint")


def _box(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[slice]]:
    """Smallest and largest byte-wise population counts of each sub-tile."""
    counts = np.bitwise_count(a.view(np.uint16).reshape(-1, 4)).astype(np.int8)
    cuts = [slice(i, i + SUB) for i in range(0, len(a), SUB)]
    return np.array([counts[c].min(0) for c in cuts]), np.array([counts[c].max(0) for c in cuts]), cuts


def _ordered(a: np.ndarray) -> np.ndarray:
    """Fingerprints with like population counts of their four words side by side."""
    counts = np.bitwise_count(a.view(np.uint16).reshape(-1, 4))
    return a[np.lexsort((a, counts[:, 3], counts[:, 2], counts[:, 1], counts[:, 0]))]


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles: every link is compared, at most len(a)+len(b) are kept.

    Sub-tiles are skipped where the population counts of their four 16-bit words already differ by more
    than the radius in sum.
    """
    a = _ordered(a)
    b = a if same else _ordered(b)
    nodes = a if same else np.concatenate([a, b])
    off, parent = 0 if same else len(a), np.arange(len(nodes))
    alo, ahi, acuts = _box(a)
    blo, bhi, bcuts = (alo, ahi, acuts) if same else _box(b)

    def find(x):
        r = parent[x]
        while True:
            up = parent[r]
            if np.array_equal(up, r):
                parent[x] = r
                return r
            r = up

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, cut in enumerate(acuts):
        gap = np.maximum(0, np.maximum(blo - ahi[i], alo[i] - bhi)).sum(1, dtype=np.int64)
        for j in np.flatnonzero(gap <= radius):
            if same and j < i:
                continue
            near = np.bitwise_count(a[cut][:, None] ^ b[bcuts[j]][None, :]) <= radius
            x, y = np.nonzero(near)
            x, y = x + cut.start, y + bcuts[j].start + off
            if same:
                x, y = x[x < y], y[x < y]
            if len(x):
                rx, ry = find(x), find(y)
                odd = rx != ry
                if odd.any():
                    pairs = np.unique(np.stack([rx[odd], ry[odd]], 1), axis=0)
                    for p, q in pairs.tolist():
                        p, q = root(p), root(q)
                        if p != q:
                            parent[max(p, q)] = min(p, q)
    top = find(np.arange(len(nodes)))
    odd = top != np.arange(len(nodes))
    return nodes[odd], nodes[top[odd]]


def links(fps: DataFrame, radius: int, scratch: Scratch, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect whatever distinct fingerprints lie within ``radius`` bits of each other.

    Fingerprints are dealt into tiles of one population count each; a pair of tiles is compared only if
    their counts differ by no more than the radius. A tile travels as one packed array. The work grows
    with the square of the number of distinct fingerprints (less what the counts rule out); memory for a
    task is two tiles whatever the size.
    """
    spark = fps.sparkSession
    ones = fps.groupBy(F.bit_count("fp").cast("int").alias("ones")).count().collect()  # 65 rows at most
    parts = {r["ones"]: -(-r["count"] // tile) for r in ones}
    if not parts:
        return spark.createDataFrame([], "a bigint, b bigint")
    split = F.element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), F.bit_count("fp").cast("int"))
    packed = fps.select("fp", F.bit_count("fp").cast("int").alias("ones"), F.pmod(F.xxhash64(F.col("fp")), split).cast("int").alias("part"))
    packed = scratch.table(packed.groupBy("ones", "part").agg(F.collect_list("fp").alias("fps")), "tiles")
    # Every pair of tiles within the radius once, made where the tile is: the smaller side first.
    meta = spark.createDataFrame(sorted(parts.items()), "ones int, n int")
    left = packed.select("ones", "part", "fps", F.explode(F.sequence("ones", F.col("ones") + radius)).alias("other"))
    left = left.join(F.broadcast(meta.selectExpr("ones AS other", "n")), "other")  # 65 rows at most
    left = left.select("ones", "part", "fps", "other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("opart"))
    left = left.where("other > ones OR opart >= part")
    n_pairs = sum(parts[p] * sum(parts.get(q, 0) for q in range(p, p + radius + 1)) for p in parts)
    right = packed.selectExpr("ones AS other", "part AS opart", "fps AS ofps")
    pairs = left.join(right, ["other", "opart"]).select("ones", "part", "other", "opart", "fps", "ofps").repartition(max(1, min(n_pairs, 20000)), "ones", "part", "other", "opart")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                a, b = (row.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in ("fps", "ofps"))
                same = row.column("ones").equals(row.column("other")) and row.column("part").equals(row.column("opart"))
                x, y = tile_links(a, b, radius, same)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, tile: int = TILE) -> DataFrame:
    """One row per input row: doc_id, ``fp`` (signed bigint) and ``component_id``.

    ``component_id`` is the smallest doc_id that chains of links between fingerprints reach, the row's own
    included. Null and word-less texts have fingerprint zero and link like any other. Repeated doc_ids are
    rows of their own; null ids never become a component_id unless the whole component has none. An empty
    table gives an empty result. Columns other than doc_id and text are not looked at.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(fingerprints(pick(docs, "doc_id", "text"), "text", shingle), "rows")
    own = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    edges = scratch.table(links(own.select("fp"), radius, scratch, tile), "links")
    comp = components(spark, edges, scratch)
    top = own.join(comp.selectExpr("node AS fp", "root"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = top.groupBy("root").agg(F.min("least_id").alias("component_id"))
    ids = scratch.table(top.join(least, "root").select("fp", "component_id"), "ids")
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
