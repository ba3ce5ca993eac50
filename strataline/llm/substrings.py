"""Substring dedup: documents parsed against every indexed block of the corpus."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, pick, sliced, utf8

#: Words of a window, and of the anchor that each window is known by.
WINDOW, ANCHOR = 35, 8
#: Bits of a filter of anchors at most (8 MB); a fuller one lets more through and changes no result.
FILTER_BITS = 1 << 26
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Hash(dict):
    """XXH64 of each word, remembered; emptied when large."""

    def __missing__(self, word):
        if len(self) > 300_000:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word)
        return got


_HASH = _Hash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64, known: dict = {}) -> np.ndarray:  # noqa: B006  kept for the next texts
    """1, base, base**2, ... (modulo 2**64), n of them at least."""
    if len(known.get(base, ())) < n:
        known[base] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, base, np.uint64))])
    return known[base]


def blocks(texts: list[list[bytes]], window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """The blocks of some texts: runs of windows that share an anchor.

    A window's anchor is its ``anchor``-word run of least hash (the first of equals), so windows of the same
    words have the same anchor at the same place, wherever they are. Returns for each block its text, its
    first window, its number of windows, the hash of its anchor and the hash of all its words with the
    anchor's place in it; then the hash of each window, block after block.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    n, start = int(size.sum()), np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    if n < window:
        none = np.empty(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64)
    h = np.fromiter(map(_HASH.__getitem__, chain.from_iterable(texts)), np.uint64, n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * _powers(n, _B)[:n], dtype=np.uint64)])
    inverse = _powers(n + 1, _B_INV)

    def run(at, count):  # hash of ``count`` words from each place
        return _mix((sums[at + count] - sums[at]) * inverse[at] + np.asarray(count, np.uint64))

    k = _mix((sums[anchor:] - sums[:-anchor]) * inverse[: n - anchor + 1])
    span, width = window - anchor + 1, 1
    least, have = k, np.arange(len(k), dtype=np.int32)  # least hash of a power of two of runs, the first of equals
    while width * 2 <= span:
        take = least[width:] < least[:-width]
        least, have = np.where(take, least[width:], least[:-width]), np.where(take, have[width:], have[:-width])
        width *= 2
    last = span - width
    take = least[last:] < least[: len(least) - last]
    where = np.where(take, have[last:], have[: len(have) - last])
    fit = np.maximum(0, size - window + 1)  # windows of each text; none reaches into the next one
    text = np.repeat(np.arange(len(texts)), fit)
    at = np.arange(int(fit.sum())) + np.repeat(start - (np.cumsum(fit) - fit), fit)
    where = where[at]
    first = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (text[1:] != text[:-1])])) if len(at) else np.empty(0, np.int64)
    count = np.diff(np.concatenate([first, [len(at)]]))
    head = at[first]
    whole = _mix(run(head, count + window - 1) + (where[first] - head).astype(np.uint64))
    return text[first], head - start[text[first]], count, k[where[first]], whole, run(at, window)


def _words(part: pa.RecordBatch) -> list[list[bytes]]:
    return [t.split() if t else [] for t in utf8(part.column("text"))]


def _bits(anchors: np.ndarray, m: int) -> list[np.ndarray]:
    return [(_mix(anchors + np.uint64(s)) % np.uint64(m)).astype(np.int64) for s in (1, 2, 3)]


def anchor_filter(anchors: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the anchors, its bits set by the executors; at most FILTER_BITS."""
    m = 64 * max(16, min(FILTER_BITS, 12 * n) // 64)

    def place(batches):
        for b in batches:
            at = np.unique(np.concatenate(_bits(b.column("anchor").to_numpy().view(np.uint64), m)))
            word, bit = at // 64, np.uint64(1) << (at % 64).astype(np.uint64)
            cut = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(at) else np.empty(0, np.int64)
            if len(cut):
                yield pa.RecordBatch.from_arrays([pa.array(word[cut].astype(np.int32)), pa.array(np.bitwise_or.reduceat(bit, cut).view(np.int64))], ["word", "bits"])

    got = anchors.select("anchor").mapInArrow(place, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(m // 64, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _in(filter_: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    ok = np.ones(len(anchors), bool)
    for at in _bits(anchors, 64 * len(filter_)):
        ok &= (filter_[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) > 0
    return ok


def duplicate_windows(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """(doc_id, tk, first, n): runs of windows of docs(doc_id, tk, text) whose words start somewhere else too.

    Each document is parsed into blocks, and every block of the corpus is indexed by its anchor. A block that
    is indexed elsewhere as a whole is one factor. Where the blocks of an anchor differ, their factors may end
    inside them: one copy of each such block has its windows looked up one by one. Copies are only counted,
    so a group of many exact copies of a block costs one row a copy and one set of windows.
    """
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()

    def anchors(batches):
        for part in sliced(batches):
            got = blocks(_words(part), window)
            yield pa.RecordBatch.from_arrays([pa.array(got[i].view(np.int64)) for i in (3, 4)], ["anchor", "whole"])

    index = docs.select("text").mapInArrow(anchors, "anchor bigint, whole bigint")
    index = index.groupBy("anchor").agg(F.count("*").alias("n"), F.min("whole").alias("low"), F.max("whole").alias("high")).where("n > 1")
    index = scratch.table(index.select("anchor", (F.col("low") != F.col("high")).alias("differ")), "anchors")
    n, n_differ = index.agg(F.count("*"), F.coalesce(F.sum(F.col("differ").cast("bigint")), F.lit(0))).first()
    if not n:
        return docs.select("doc_id", "tk", F.lit(0).alias("first"), F.lit(0).alias("n")).limit(0)
    shared = spark.sparkContext.broadcast((anchor_filter(index.where("NOT differ"), n - n_differ), anchor_filter(index.where("differ"), n_differ)))

    def candidates(batches):
        same, differ = shared.value
        for part in sliced(batches):
            text, first, count, anchor, whole, single = blocks(_words(part), window)
            if len(text):
                inside = _in(differ, anchor)
                take = np.flatnonzero(inside | _in(same, anchor))
                ends = np.cumsum(count)
                singles = [single[e - c : e].tobytes() if i else None for e, c, i in zip(ends[take].tolist(), count[take].tolist(), inside[take].tolist())]
                row = pa.array(text[take])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(row), part.column("tk").take(row), pa.array(first[take].astype(np.int32)), pa.array(count[take].astype(np.int32)), pa.array(anchor[take].view(np.int64)), pa.array(whole[take].view(np.int64)), pa.array(singles, pa.binary())],
                    ["doc_id", "tk", "first", "n", "anchor", "whole", "singles"],
                )

    rows = scratch.table(docs.mapInArrow(candidates, f"doc_id {id_type}, tk bigint, first int, n int, anchor bigint, whole bigint, singles binary"), "candidates")
    # Each distinct block once: how often it is there, and one place of it (its only one, if it is there once).
    place = F.min(F.struct("doc_id", "tk", "first", "n")).alias("place")
    each = scratch.table(rows.groupBy("anchor", "whole").agg(F.count("*").alias("copies"), place), "blocks")
    again = rows.drop("singles").join(each.where("copies > 1").select("anchor", "whole"), ["anchor", "whole"]).select("doc_id", "tk", "first", "n")

    def unpack(batches):
        for part in sliced(batches, 4096):
            sets = [np.frombuffer(s, np.int64) for s in part.column("singles").to_pylist()]
            size = np.array([len(s) for s in sets], np.int64)
            row = pa.array(np.repeat(np.arange(len(sets)), size))
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            key = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
            first = part.column("first").to_numpy(zero_copy_only=False)[np.asarray(row)] + at
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(row), part.column("tk").take(row), pa.array(first.astype(np.int32)), part.column("alone").take(row), part.column("anchor").take(row), key], ["doc_id", "tk", "first", "alone", "anchor", "key"])

    # The windows of one copy of each block whose anchor has others: the row that holds its place.
    held = each.select((F.col("copies") == 1).alias("alone"), F.col("place.doc_id").alias("p_id"), F.col("place.tk").alias("p_tk"), F.col("place.first").alias("p_first"), F.col("anchor").alias("p_anchor"), F.col("whole").alias("p_whole"))
    one = rows.where("singles IS NOT NULL").join(held, (rows.anchor == held.p_anchor) & (rows.whole == held.p_whole) & rows.doc_id.eqNullSafe(held.p_id) & (rows.tk == held.p_tk) & (rows["first"] == held.p_first))
    one = one.select("doc_id", "tk", "first", "alone", "anchor", "singles")
    windows = scratch.table(one.mapInArrow(unpack, f"doc_id {id_type}, tk bigint, first int, alone boolean, anchor bigint, key bigint"), "windows")
    scratch.drop(index)
    # A window that two blocks have is found in another place; a block that is there twice is a factor already.
    twice = windows.groupBy("anchor", "key").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    inner = windows.where("alone").join(twice, ["anchor", "key"]).select("doc_id", "tk", "first", F.lit(1).alias("n"))
    return again.unionByName(inner)


def duplicate_spans(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """(doc_id, tk, spans): for each document the factors, long enough and joined where they meet: words [start, end)."""
    hits = duplicate_windows(docs, scratch, window)
    one = hits.groupBy("doc_id", "tk").agg(F.sort_array(F.collect_set(F.struct("first", (F.col("first") + F.col("n") + (window - 1)).alias("end")))).alias("s"))  # as many as the document has words, at most

    def join(batches):
        for part in sliced(batches):
            spans = []
            for s in part.column("s").to_pylist():
                out = []
                for x in s:
                    if out and x["first"] <= out[-1]["end"]:
                        out[-1]["end"] = max(out[-1]["end"], x["end"])
                    else:
                        out.append({"start": x["first"], "end": x["end"]})
                spans.append(out)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tk"), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["doc_id", "tk", "spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return one.mapInArrow(join, f"doc_id {id_type}, tk bigint, spans array<struct<start:int,end:int>>")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, spans (removed words, [start, end)) and ``kept``, the words left, joined by one space.

    A word goes if a window of ``window`` consecutive words that covers it also starts anywhere else, in any
    row or further on in the same one; all copies go, the first too, and all windows are judged on the input.
    Texts of fewer words than a window, empty and null ones lose nothing. Repeated rows are copies of each
    other. Null or repeated ids are rows of their own; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    rows = pick(docs, "doc_id", "text").withColumn("tk", F.xxhash64("text"))  # a row is known by its id and its text
    spans = scratch.table(duplicate_spans(rows, scratch, window), "spans")
    scratch.only(spans)
    spans = spans.withColumnsRenamed({"doc_id": "s_id", "tk": "s_tk"})
    both = rows.join(spans.hint("shuffle_hash"), rows.doc_id.eqNullSafe(spans.s_id) & (rows.tk == spans.s_tk), "left").select("doc_id", "text", "spans")

    def cut(batches):
        for part in sliced(batches):
            n, kept = [], []
            for words, spans in zip(_words(part), part.column("spans").to_pylist()):
                n.append(len(words))
                for s in reversed(spans or ()):
                    del words[s["start"] : s["end"]]
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), part.column("spans"), pa.array(kept, pa.string())], ["doc_id", "n_words", "spans", "kept"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(cut, f"doc_id {id_type}, n_words bigint, spans array<struct<start:int,end:int>>, kept string")


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = F.coalesce(F.expr("aggregate(spans, 0L, (acc, s) -> acc + s.end - s.start)"), F.lit(0).cast("bigint"))
    return got.select("doc_id", "n_words", n.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT rid, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
t AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
x AS (SELECT DISTINCT rid, q FROM (SELECT rid, unnest(range(p, p + 35)) AS q FROM p JOIN t USING (h))),
k AS (SELECT rid, list(q) AS gone FROM x GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
    list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
