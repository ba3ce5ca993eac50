"""Cross-tokenizer alignment by byte-owner arrays, and the counts of token pairs that end together."""

from __future__ import annotations

import base64
import sys
import types
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, pick, sliced

#: Where the vocabulary files of the public tokenizers lie, on every machine.
TOKENIZERS = "/opt/tokenizers"
#: Texts aligned at a time, and pairs that a task keeps before it folds them.
ROWS, HELD = 32, 1 << 21
#: Bits of a pair that hold its B id.
B_BITS = 15
#: The pattern that splits text before the merges of A. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabularies:
    """The two tokenizers, the bytes of each of their tokens, and the texts that stand for ids in a list of groups."""

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken

        with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as file:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            self.a_bytes[rank] = word
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        if len(self.b_bytes) > 1 << B_BITS or len(self.a_bytes) > 1 << 31 - B_BITS:
            raise ValueError("a pair of ids does not fit 31 bits")
        self.a_size, self.b_size = (np.array([len(x) for x in v], np.int32) for v in (self.a_bytes, self.b_bytes))
        #: Three texts an id: inside a group, before the other side, and before the next group.
        self.shown = [f"{i}{end}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for end in ",|;"]


def vocabularies(folder: str) -> Vocabularies:
    """Read once by each worker process; kept in a module of its own, as functions come with each task anew."""
    kept = sys.modules.setdefault("_strataline_vocabularies", types.ModuleType("_strataline_vocabularies"))
    if folder not in vars(kept):
        setattr(kept, folder, Vocabularies(folder))
    return getattr(kept, folder)


def tokens(v: Vocabularies, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
    """A ids and B ids of each text; both empty where the text has no tokens (null, empty, or not kept byte by byte)."""
    a, b = [], []
    for t in texts:
        x, y = [], []
        if t:
            x, y, want = v.a.encode_ordinary(" " + t), v.b.encode(t, num_threads=1), b" " + t.encode()
            if b"".join(map(v.a_bytes.__getitem__, x)) != want or b"".join(map(v.b_bytes.__getitem__, y)) != want:
                x, y = [], []
        a.append(x)
        b.append(y)
    return a, b


def align(v: Vocabularies, texts: list[str | None]) -> dict[str, np.ndarray | list]:
    """Tokens, groups, overlaps and links of some texts.

    The byte-owner arrays repeat each token's place over its bytes, for all texts one after the other. Where the pair of owners
    changes, two tokens overlap; where both owners change, both tokens end, which is a cut between groups and links the two tokens.
    """
    a, b = tokens(v, texts)
    n_a, n_b = (np.array([len(x) for x in y], np.int64) for y in (a, b))
    ia, ib = (np.fromiter(chain.from_iterable(y), np.int64, int(n.sum())) for y, n in ((a, n_a), (b, n_b)))
    out = {"n_a": n_a, "n_b": n_b}
    if not len(ia):
        zero = np.zeros(len(texts), np.int64)
        return out | {"n_groups": zero, "n_overlaps": zero, "groups": [""] * len(texts), "pairs": np.zeros(0, np.int32), "text": np.zeros(0, np.int64)}
    owner_a, owner_b = (np.repeat(np.arange(len(i), dtype=np.int32), size[i]) for i, size in ((ia, v.a_size), (ib, v.b_size)))
    end_a, end_b = (np.append(o[1:] != o[:-1], True) for o in (owner_a, owner_b))
    cut, meet = np.flatnonzero(end_a & end_b), np.flatnonzero(end_a | end_b)
    text_a = np.repeat(np.arange(len(texts)), n_a)
    last_a, last_b = owner_a[cut], owner_b[cut]  # of each group
    out["n_groups"] = np.bincount(text_a[last_a], minlength=len(texts))
    out["n_overlaps"] = np.bincount(text_a[owner_a[meet]], minlength=len(texts))
    out["pairs"], out["text"] = (ia[last_a] << B_BITS | ib[last_b]).astype(np.int32), text_a[last_a]
    # A list of groups: the A tokens of a group, then its B tokens. Each goes after the tokens of both kinds before it.
    in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    shown = np.empty(len(ia) + len(ib), np.int64)
    end_of_a, end_of_b = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
    end_of_a[last_a], end_of_b[last_b] = 1, 2
    shown[np.arange(len(ia)) + np.repeat(np.cumsum(in_b) - in_b, in_a)] = 3 * ia + end_of_a
    shown[np.arange(len(ib)) + np.repeat(np.cumsum(in_a), in_b)] = 3 * ib + end_of_b
    put, ends = list(map(v.shown.__getitem__, shown.tolist())), np.cumsum(n_a + n_b).tolist()
    out["groups"] = ["".join(put[i:j])[:-1] for i, j in zip([0, *ends], ends)]
    return out


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n): how often each pair is linked, from texts' pairs and how often each has them; folded in each task before the shuffle."""

    def fold(held):
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, at, np.concatenate([n for _, n in held]))
        return keys, sums

    def run(batches):
        held, rows = [], 0
        for b in batches:
            held.append(tuple(b.column(c).flatten().to_numpy() for c in ("pairs", "times")))
            rows += len(held[-1][0])
            if rows > HELD:  # what is left is bounded by the vocabularies
                held = [fold(held)]
                rows = 0
        if held:
            keys, sums = fold(held)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(sums)], ["pair", "n"])

    return links.select("pairs", "times").mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def alignment(docs: DataFrame, folder: str = TOKENIZERS, digests: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_overlaps, n_best, count_sum and groups, one row per input row.

    groups lists the ids of each group (`a1,a2|b1;a3|b2,b3`); it is longer than the text, so ``digests`` gives groups_sha256 instead,
    and nothing but that is written.

    A: byte-level BPE of 50k over a space and the text; B: pieces of 32k over the text. Texts that are null or empty, or whose bytes a
    tokenizer doesn't keep, have no tokens: zeros and an empty list (and an empty digest). Tokens that end at the same byte are linked. A pair's count is how many
    links all rows have of it; n_best counts the links whose count is the highest of their B token, count_sum adds up the counts. Repeated or null
    ids are rows of their own; an empty table gives no rows.

    Each text is tokenized once; its links and groups (or their digests) are written to the shared folder. Of two tokens that end together one
    is a suffix of the other, so there are no more different pairs than the vocabularies have suffixes: that is what bounds the
    table of counts that all tasks receive, whatever the corpus.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "alignment")
    id_type, shown = docs.schema["doc_id"].dataType.simpleString(), "groups_sha256" if digests else "groups"

    def run(batches):
        v = vocabularies(folder)
        for part in sliced(batches, ROWS):
            got = align(v, part.column("text").to_pylist())
            key, times = np.unique(got["text"] << 31 | got["pairs"], return_counts=True)
            ends = np.searchsorted(key, np.arange(part.num_rows + 1) << 31).astype(np.int32)
            groups = [sha256(g.encode()).hexdigest() if g else "" for g in got["groups"]] if digests else got["groups"]
            pairs = pa.array((key & (1 << 31) - 1).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array(got[c].astype(np.int64)) for c in ("n_a", "n_b", "n_groups", "n_overlaps")], pa.array(groups, pa.string()), *[pa.ListArray.from_arrays(pa.array(ends), x) for x in (pairs, pa.array(times.astype(np.int32)))]],
                ["doc_id", "n_a", "n_b", "n_groups", "n_overlaps", shown, "pairs", "times"],
            )

    found = pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_overlaps bigint, {shown} string, pairs array<int>, times array<int>")
    return _counted(scratch.table(found, "links"))


def _counted(found: DataFrame) -> DataFrame:
    """The rows of ``found`` (written), with n_links, n_best and count_sum instead of their pairs."""
    counts = pair_counts(found).toArrow().sort_by("pair")  # bounded by the vocabularies, see alignment
    keys, n = (counts.column(c).to_numpy() for c in ("pair", "n"))
    best = np.zeros(1 << B_BITS, np.int64)
    np.maximum.at(best, keys & (1 << B_BITS) - 1, n)
    shared = found.sparkSession.sparkContext.broadcast((keys, n, n == best[keys & (1 << B_BITS) - 1]))
    kept = [f.name for f in found.schema if f.name not in ("pairs", "times")]

    def run(batches):
        keys, n, top = shared.value
        for b in batches:
            size = b.column("pairs").value_lengths().to_numpy()
            times, at = b.column("times").flatten().to_numpy().astype(np.int64), np.searchsorted(keys, b.column("pairs").flatten().to_numpy())
            ends = np.concatenate([[0], np.cumsum(size)])
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (times, times * top[at], times * n[at])]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *map(pa.array, sums)], [*kept, "n_links", "n_best", "count_sum"])

    have = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name in kept)
    return found.mapInArrow(run, f"{have}, n_links bigint, n_best bigint, count_sum bigint")


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
