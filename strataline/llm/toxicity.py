"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, crc_bucket, map_batches, pick, sliced
from .linear import dual_descent, platt

#: Labelled rows that lexicons are mined from and the classifier is fitted on at most.
MAX_TRAIN_ROWS = 20_000
#: Lexicon entries at most, the most telling first.
MAX_LEXICON = 20_000
BINS = 20
#: Families of lexicon entries: the word itself and its first bytes.
PREFIXES = (0, 4, 5, 6, 7, 8)
PATTERNS = len(PREFIXES) << BINS
#: Words that the seed voters know, with or without digits for letters and drawn-out letters.
SEEDS = frozenset(b"idiot moron stupid dumb loser trash garbage scum worthless pathetic disgusting clown filth vermin freak creep jerk bastard".split())
_LEET = bytes.maketrans(b"013457@$", b"oieastas")
_EDGE = bytes(b for b in range(33, 127) if not chr(b).isalnum())
VOTERS = 2 * len(PREFIXES) + 4


class _Features(dict):
    """The lexicon bins and pattern ids of each word, remembered; emptied when large."""

    def __init__(self, keep: frozenset[int] | None):
        super().__init__()
        self.keep = keep

    def __missing__(self, word):
        if len(self) > 150_000:
            self.clear()
        w, crc = word.strip(_EDGE), zlib.crc32
        ids = [f << BINS | crc(w[:k] if k else w, f) & (1 << BINS) - 1 for f, k in enumerate(PREFIXES) if len(w) >= max(k, 2)]
        if w in SEEDS:
            ids.append(PATTERNS)
        elif len(w) < 40 and (plain := w.translate(_LEET)) != w and plain in SEEDS:
            ids.append(PATTERNS + 1)
        elif len(w) < 40 and any(a == b for a, b in zip(w, w[1:])) and bytes(b for i, b in enumerate(w) if i == 0 or b != w[i - 1]) in _THIN:
            ids.append(PATTERNS + 1)
        self[word] = got = tuple(i for i in ids if self.keep is None or i in self.keep or i >= PATTERNS)
        return got


_THIN = frozenset(bytes(b for i, b in enumerate(s) if i == 0 or b != s[i - 1]) for s in SEEDS)


def features(text: str | None, memo: _Features) -> list[int]:
    """Sorted distinct lexicon bins and pattern ids of a whole text."""
    found = set(chain.from_iterable(map(memo.__getitem__, set(text.lower().encode().split() if text else ()))))
    if text and "!!" in text:
        found.add(PATTERNS + 2)
    if text and text.isupper():
        found.add(PATTERNS + 3)
    return sorted(found)


def votes(ids: list[int]) -> int:
    """Bit j is voter j: two halves of each lexicon family, then the four patterns."""
    mask = 0
    for i in ids:
        mask |= 1 << (VOTERS - 4 + i - PATTERNS if i >= PATTERNS else 2 * (i >> BINS) + (i & 1))
    return mask


def label_model(patterns: dict[int, int], known: np.ndarray, steps: int = 60, prior: float = 0.1) -> dict[int, float]:
    """The posterior probability of class 1 for each pattern of votes, from how often each occurs.

    A voter votes for class 1 or abstains; that nobody votes is a vote against. ``known`` has each voter's
    right and wrong votes on labelled rows, where it starts and which weigh as much as so many documents.
    Expectation-maximisation
    estimates how often each voter is right from how the others vote beside it. Voters that vote together
    more than their class explains (their correlation within the classes) share one voice where both vote.
    """
    if not patterns:
        return {}
    masks = sorted(patterns)
    v = np.array([[m >> j & 1 for j in range(VOTERS)] for m in masks], float)
    n, silent = np.array([patterns[m] for m in masks], float), np.array([m == 0 for m in masks])
    start = known + np.array([[1.0], [1.0]])
    right, shared, post = np.clip(start[0] / start.sum(0), 0.02, 0.98), np.zeros((VOTERS, VOTERS)), np.zeros(len(masks))
    for _ in range(steps):
        base = np.log(prior / (1 - prior))
        odds = base + (v / (1 + v @ shared)) @ np.maximum(0, np.log(right / (1 - right)) - base) - silent * np.log(0.99 / 0.01)
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        moved, post = float(np.abs(new - post).max()), new
        prior = min(0.5, max(0.01, float(n @ post) / n.sum()))
        cast = n @ v
        right = np.clip(((n * post) @ v + start[0]) / (cast + start.sum(0)), 0.02, 0.98)
        shared = np.zeros((VOTERS, VOTERS))
        for p in (n * post, n * (1 - post)):
            off = v - (p @ v) / (p.sum() + 1e-9)
            cov = (off * p[:, None]).T @ off / (p.sum() + 1e-9)
            sd = np.sqrt(np.diag(cov))
            ok = np.outer(sd > 1e-4, sd > 1e-4)
            shared += 0.5 * np.where(ok, np.clip(cov, 0, None) / np.maximum(np.outer(sd, sd), 1e-9), 0)
        np.fill_diagonal(shared, 0)
        if moved < 1e-6:
            break
    return dict(zip(masks, post.tolist()))


def _cover(c: np.ndarray, n: list[int], told: list[np.ndarray], precision: float, least: int) -> np.ndarray:
    """Bins that explain class 1: greedily the bin found in most rows not yet explained, and its companions.

    c: rows of either class with each bin; told: the bins of each row of class 1. A bin counts only if
    ``precision`` of its rows are of class 1. What goes along with an explained row by chance is not taken.
    """
    ok = (c[1] >= least) & (c[1] >= precision * (c[0] + c[1]))
    ids = [x[ok[x]] for x in told]
    row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    bins, at = np.unique(np.concatenate(ids) if ids else np.empty(0, np.int32), return_inverse=True)
    if not len(bins):
        return bins
    total, open_, chosen = np.bincount(at, minlength=len(bins)), np.ones(len(told), bool), set()
    while len(chosen) < MAX_LEXICON:
        gain = np.bincount(at[open_[row]], minlength=len(bins))
        best = int(np.lexsort((bins, -total, -gain))[0])
        if gain[best] < max(least, 0.002 * n[1]):
            break
        mine = np.zeros(len(told), bool)
        mine[row[at == best]] = True
        both = np.bincount(at[mine[row]], minlength=len(bins))
        chosen.update(np.flatnonzero(both >= 0.7 * (total + mine.sum() - both)).tolist())
        open_ &= ~mine
    return bins[sorted(chosen)]


def mine(docs: DataFrame, wanted: DataFrame, scratch: Scratch, precision: float = 0.9, least: int = 5) -> dict[int, tuple[int, int]]:
    """Lexicon bins that tell class 1, from the distinct texts of the wanted rows: in how many rows of class 1 and of class 0 each is; and the fixed patterns."""

    def ids(part):
        memo = _Features(None)
        return {"y": part.column("y"), "k": part.column("k"), "ids": pa.array([np.array(features(t, memo), np.int32).tobytes() for t in part.column("text").to_pylist()], pa.binary())}

    rows = docs.join(F.broadcast(wanted), "doc_id").select("y", F.xxhash64("text").alias("k"), "text")  # max_rows at most
    rows = scratch.table(map_batches(rows, ids, "y int, k bigint, ids binary"), "mined")

    def count(batches):
        c, n, told, seen = np.zeros((2, PATTERNS + 4), np.int32), [0, 0], [], set()
        for b in sliced(batches):
            for y, k, x in zip(*(b.column(i).to_pylist() for i in ("y", "k", "ids"))):
                if (k, y > 0) not in seen:
                    seen.add((k, y > 0))
                    x = np.frombuffer(x, np.int32)
                    c[int(y > 0), x] += 1
                    n[int(y > 0)] += 1
                    if y > 0:
                        told.append(x[x < PATTERNS].copy())
        got = np.concatenate([_cover(c[:, :PATTERNS], n, told, precision, least), np.arange(PATTERNS, PATTERNS + 4)])
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (got, c[1, got], c[0, got])], ["id", "yes", "no"])

    return {r["id"]: (r["yes"], r["no"]) for r in rows.coalesce(1).mapInArrow(count, "id int, yes int, no int").collect()}


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn=None, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id and score, the probability that a document is toxic, one row per input row.

    learn: a condition on doc_id that says which labels may be learnt from. Voters are lexicons mined from
    at most ``max_rows`` of those labels and fixed patterns; the label model sees the votes of all documents
    and no label; the classifier learns the posterior of the label model. Null and empty texts get no vote
    and a score near the floor. Null ids, repeated rows, missing labels and empty tables are all right.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "toxicity")
    docs, teach = pick(docs, "doc_id", "text"), pick(labels, "doc_id", label)
    teach = teach.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (learn if learn is not None else F.lit(True)))
    wanted = teach.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    wanted = scratch.table(wanted, "wanted")
    lexicon = mine(docs, wanted, scratch)
    keep, start = frozenset(lexicon), np.zeros((2, VOTERS))  # of each voter: right and wrong votes
    for i, (yes, no) in lexicon.items():
        start[:, votes([i]).bit_length() - 1] += yes, no

    def look(part):
        memo = look.__dict__.setdefault("memo", _Features(keep))
        ids = [features(t, memo) for t in part.column("text").to_pylist()]
        return {"doc_id": part.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32())), "mask": pa.array(list(map(votes, ids)), pa.int32())}

    id_type = docs.schema["doc_id"].dataType.simpleString()
    seen = scratch.table(map_batches(docs, look, f"doc_id {id_type}, ids array<int>, mask int"), "votes")
    posterior = label_model({r["mask"]: r["count"] for r in seen.groupBy("mask").count().collect()}, start)  # 65,536 patterns at most
    known = seen.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min(F.struct("mask", "ids")).alias("one")).select("doc_id", "one.*").orderBy("doc_id").collect()  # max_rows at most; one text of a repeated id
    slot = {i: k for k, i in enumerate(sorted(keep | {PATTERNS + k for k in range(4)}))}
    post = np.array([posterior[r["mask"]] for r in known])
    y, sure = np.where(post >= 0.5, 1.0, -1.0), np.abs(2 * post - 1)
    rows = [np.array([slot[i] for i in r["ids"]], np.int64) for r in known]
    values = [np.full(len(r), 1 / np.sqrt(max(1, len(r)))) for r in rows]
    if len(set(y.tolist())) == 2:
        balance = np.where(y > 0, len(y) / 2 / (y > 0).sum(), len(y) / 2 / (y < 0).sum())
        w = dual_descent(rows, values, y, 10 * sure * balance + 1e-9, len(slot))
        a, b = platt(np.array([float(w[r] @ v) + w[-1] for r, v in zip(rows, values)]), y, sure + 1e-9)
    else:  # nothing to tell apart
        rate = (float((y > 0).sum()) + 1) / (len(y) + 2)
        w, a, b = np.zeros(len(slot) + 1), 1.0, float(np.log(rate / (1 - rate)))
    shared = spark.sparkContext.broadcast((slot, w, a, b))  # MAX_LEXICON entries at most

    def score(part):
        slot, w, a, b = shared.value
        at = [[slot[i] for i in ids] for ids in part.column("ids").to_pylist()]
        margin = np.array([w[x].sum() / np.sqrt(max(1, len(x))) + w[-1] if x else w[-1] for x in at])
        return {"doc_id": part.column("doc_id"), "score": 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))}

    return map_batches(seen.select("doc_id", "ids"), score, f"doc_id {id_type}, score double")


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    fold = crc_bucket(F.col("doc_id"), 5)
    got = toxicity_scores(docs, labels, "toxic", fold != 0)
    return got.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
