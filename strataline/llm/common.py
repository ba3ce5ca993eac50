"""Plumbing shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text turned into Python strings at a time, whatever the size of the Arrow batch.
SLICE_ROWS = 128
#: Bytes of text in such a slice, so that many long texts together need little memory.
SLICE_BYTES = 4 << 20
#: Edges that one task joins at the end of components (16 bytes each), and that a task folds before it hands them on.
FEW_EDGES, HELD_EDGES = 1 << 17, 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``.

    Only where the setting is absent and all runs on one machine (tests, a laptop) is a local folder made and set.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        got = "file://" + tempfile.mkdtemp(prefix="strataline-")
        spark.sparkContext.setCheckpointDir(got)
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """Intermediate tables written to the shared folder, so a lost executor costs no recomputation.

    ``table`` writes and rereads one (this cuts lineage), ``drop`` deletes it once no later plan reads
    it. What is left goes when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.made: list[DataFrame] = []
        atexit.register(_forget, spark, self.root)

    def table(self, df: DataFrame, name: str = "t", **options: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.mode("overwrite").options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.made.append(out)
        return out

    def only(self, *tables: DataFrame) -> None:
        """Deletes all but these."""
        self.drop(*[t for t in self.made if not any(t is k for k in tables)])
        self.made = list(tables)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _forget(self.spark, t._scratch_path)


def tidy() -> None:
    """Hands freed memory back to the system: a Python worker outlives its task and shares the executor's memory with the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of so many rows at most, and of SLICE_BYTES of text at most unless one row alone is longer. What tasks before this one,
    and the batches of this one, left behind is handed back."""
    tidy()
    for batch in batches:
        size = np.zeros(batch.num_rows + 1, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                size[1:] += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1))
            yield batch.slice(at, min(to, batch.num_rows) - at)
            at = to
    batch = None
    tidy()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """``mapInArrow`` over small slices; ``fn`` turns one slice into a dict of columns."""

    def run(batches):
        names = None
        for part in sliced(batches):
            got = fn(part)
            if got is not None:
                names = names or list(got)
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in got.values()], names)

    return df.mapInArrow(run, schema)


def words_of(text: str | bytes | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space: ``bytes`` methods touch only ASCII."""
    return (text.encode() if isinstance(text, str) else text).lower().split() if text else []


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of a column as bytes, without decoding them first."""
    return column.cast(pa.binary()).to_pylist()


def crc_bucket(doc_id, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, by exact position, so that extra columns of any name can't clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def ascii_lower(text):
    """A-Z to a-z and nothing else; pure-ASCII texts take the fast built-in."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the components of some edges, root the smallest node; roots themselves are left out."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, parent = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while True:
        x, y = parent[a], parent[b]
        odd = x != y
        if not odd.any():
            break
        a, b, x, y = a[odd], b[odd], x[odd], y[odd]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    odd = parent != np.arange(len(ids))
    return ids[odd], ids[parent[odd]]


def forests(edges: DataFrame) -> DataFrame:
    """(u, v): each task's forest of edges(u bigint, v bigint), every node next to its smallest; at most HELD_EDGES and a batch are held."""

    def run(batches):
        u, v = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            u, v = forest(*(np.concatenate([x, b.column(i).to_numpy()]) for i, x in enumerate((u, v))))
            if len(u) > HELD_EDGES:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                u, v = u[:0], v[:0]
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return edges.mapInArrow(run, "u bigint, v bigint")


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, few: int = FEW_EDGES) -> DataFrame:
    """Connected components of edges(a bigint, b bigint): (node, root), root the smallest node reachable.

    Each task first keeps a forest of its own edges. Then come alternating large-star and small-star steps, each a
    pre-aggregated minimum and an equi-join, so a star with a third of all nodes is neither collected nor
    expanded. Once no more than ``few`` edges are left, one task joins them. Nodes without an edge are absent.
    """
    now = scratch.table(forests(edges.where("a <> b").selectExpr("a AS u", "b AS v")), "edges")
    last, n = None, now.count()
    while n > few:
        both = now.unionByName(now.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.join(low, "u").where("v > u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        large = scratch.table(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("v AS u", "m AS v").where("u <> v").unionByName(low.selectExpr("u", "m AS v")).distinct()
        nxt = scratch.table(small, "small")
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(large, now)
        now, n = nxt, mark[0]
        if mark == last:
            return now.selectExpr("u AS node", "v AS root")
        last = mark
    roots = scratch.table(forests(now.coalesce(1)), "roots")
    scratch.drop(now)
    return roots.selectExpr("u AS node", "v AS root")
