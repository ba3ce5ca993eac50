"""Line dedup: a suffix array over line ids by distributed prefix doubling, and its longest-common-prefix intervals."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, pick, sliced, utf8

#: A repeated run counts if it has so many lines, or more words than this.
MIN_LINES, MIN_WORDS = 3, 50
#: Suffixes that one task orders, and that are broadcast, at most.
FEW = 1 << 17


def line_table(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(tx, at, a, b, need): the lines of each distinct text, known by tx, a hash of it.

    a and b are 128 bits of hash that stand for the line; need is the least number of lines from here on that count as a
    run (min_lines, or fewer of more than min_words words), null if the text ends before. A null text has no lines.
    """

    def run(batches):
        for part in sliced(batches):
            out = []
            for tx, text in zip(part.column("tx").to_pylist(), utf8(part.column("text"))):
                lines = text.split(b"\n")
                ends = np.concatenate([[0], np.cumsum([len(x.split()) for x in lines])])
                need = np.full(len(lines), min_lines, np.int32)
                for m in range(min(min_lines - 1, len(lines)), 0, -1):
                    need[: len(lines) - m + 1][ends[m:] - ends[:-m] > min_words] = m
                at = np.arange(len(lines), dtype=np.int32)
                need[at + need > len(lines)] = 0
                out.append((np.full(len(lines), tx), at, need, b"".join(map(xxhash.xxh3_128_digest, lines))))
            if out:
                tx, at, need = (np.concatenate([x[i] for x in out]) for i in range(3))
                a, b = np.frombuffer(b"".join(x[3] for x in out), ">i8").astype(np.int64).reshape(-1, 2).T.copy()
                got = pa.RecordBatch.from_arrays([pa.array(tx), pa.array(at), pa.array(a), pa.array(b), pa.array(need, mask=need == 0)], ["tx", "at", "a", "b", "need"])
                for i in range(0, len(tx), 1 << 16):
                    yield got.slice(i, 1 << 16)

    texts = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("tx"), "text")
    rows = texts.mapInArrow(run, "tx bigint, at int, a bigint, b bigint, need int")
    return rows.groupBy("tx", "at").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.first("need").alias("need"))


def _in_parts(rows: DataFrame, keys: list[str], scratch: Scratch, fn, schema: str) -> DataFrame:
    """fn over the rows in the order of the keys: sorted by ranges over all tasks; ``part`` numbers the tasks in order."""
    rows = scratch.table(rows, "unsorted")  # read twice: for the ranges, then for the sort

    def run(batches):
        state, part = {}, TaskContext.get().partitionId()
        for b in batches:
            if b.num_rows:
                got = fn(b, state)
                yield pa.RecordBatch.from_arrays([*b.columns, *got.values(), pa.array(np.full(b.num_rows, part, np.int32))], [*b.schema.names, *got, "part"])

    have = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    out = scratch.table(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"{have}, {schema}, part int"), "sorted")
    scratch.drop(rows)
    return out


def ordered(groups: DataFrame, top: str, under: list[str], scratch: Scratch) -> DataFrame:
    """groups(top, under, n) and ``offset``: the sum of n over the groups of the same ``top`` that come earlier by ``under``.

    They are sorted by ranges over all tasks; what a task doesn't see of its first ``top`` is added from the
    sums of the tasks before it.
    """

    def add(b, state):
        t, n = b.column(top).to_numpy(), b.column("n").to_numpy()
        ends = np.cumsum(n)
        begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        out = ends - n - np.repeat((ends - n)[begin], np.diff(np.concatenate([begin, [len(t)]])))
        if "first" not in state:
            state["first"], state["top"], state["sum"] = int(t[0]), int(t[0]), 0
        out[t == state["top"]] += state["sum"]  # the group that the batch before ended in
        state["sum"], state["top"] = int(out[-1] + n[-1]), int(t[-1])
        return {"offset": pa.array(out), "lead": pa.array(t == state["first"])}

    part = _in_parts(groups.select(top, *under, "n"), [top, *under], scratch, add, "offset bigint, lead boolean")
    edge = part.groupBy("part").agg(F.min(top), F.max(top), F.max_by(F.col("offset") + F.col("n"), F.struct(top, *under)))
    carry, last, held = [], None, 0
    for p, low, high, tail in sorted(tuple(r) for r in edge.collect()):  # one row a partition
        carry.append((p, held if low == last else 0))
        held = tail + (held if low == last and low == high else 0)
        last = high
    carry = part.sparkSession.createDataFrame(carry, "part int, held bigint")
    return part.join(F.broadcast(carry), "part").select(top, *under, "n", (F.col("offset") + F.when(F.col("lead"), F.col("held")).otherwise(0)).alias("offset"))


def finish(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank, base) of some suffixes (tx, at, rank, next) in the order given, ``rank`` and ``next`` being their ranks by
    ``length`` lines and those of the suffixes so many lines on: the doubling carried on to the end in arrays.

    base is a number of lines, a multiple of ``length``, that a suffix shares with the one before it in the order; they have less
    than ``length`` more in common.
    """
    tx, at, rank, nxt = (table.column(c).to_numpy() for c in ("tx", "at", "rank", "next"))
    n, number = len(tx), np.unique(tx, return_inverse=True)[1].astype(np.int64)
    key = number << 32 | at.astype(np.int64)
    order = np.argsort(key)
    sorted_key = key[order]

    def ahead(rows, lines):  # the row so many lines on, or -1
        want = key[rows] + lines
        got = np.minimum(np.searchsorted(sorted_key, want), n - 1)
        return np.where(sorted_key[got] == want, order[got], -1)

    levels, lines = [], length
    while True:
        levels.append(rank)
        by = np.argsort(rank, kind="stable")
        same = rank[by][1:] == rank[by][:-1]
        if not same.any():
            break
        tied = by[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        on = ahead(tied, lines)
        before = ahead(tied, lines - length)  # of a tied suffix these are among the rows
        then = np.where(on >= 0, rank[on], nxt[before])
        by = np.lexsort((then, rank[tied]))
        tied, then = tied[by], then[by]
        top = np.concatenate([[True], rank[tied][1:] != rank[tied][:-1]])
        new = top | np.concatenate([[True], then[1:] != then[:-1]])
        place, first = np.arange(len(tied)), np.flatnonzero(new)
        begin = np.maximum.accumulate(np.where(top, place, 0))
        rank = rank.copy()
        rank[tied] += np.repeat(first, np.diff(np.concatenate([first, [len(tied)]]))) - begin
        lines *= 2
    by = np.argsort(rank)
    x, y = by[1:], by[:-1]
    pairs = np.flatnonzero((levels[0][x] == levels[0][y]) & (rank[x] == rank[y] + 1))
    x, y, cur = x[pairs], y[pairs], np.zeros(len(pairs), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        i, k = ahead(x, cur), ahead(y, cur)
        cur += np.where((i >= 0) & (k >= 0) & (levels[j][i] == levels[j][k]), length << j, 0)
    base = np.zeros(n, np.int64)
    base[x] = cur
    return rank, base


def suffix_array(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(rank, tx, at, lcp) of all suffixes that share their first line with another one: rank is the place in the order of all
    suffixes, lcp the number of lines that each shares with the one before it in that order.

    Prefix doubling: the order by 2 k lines follows from the ranks by k lines of a suffix and of the one k
    lines on. A suffix that is alone with its prefix has its rank for good; the others go on until none is
    left. The end of a text differs from the end of any other and comes before all lines. Lines stand in the order of
    their hashes. Once FEW suffixes are left, one task carries the doubling on in arrays. The common prefixes
    follow by halving steps: the next 2**j lines of two suffixes are equal if their ranks of that level are.
    """
    groups = ordered(lines.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("all", F.lit(0).cast("bigint")), "all", ["a", "b"], scratch)
    first = lines.join(groups, ["a", "b"]).select("tx", "at", F.col("offset").alias("rank"), (F.col("n") > 1).alias("open"))
    first = scratch.table(first, "ranks")
    single, now = first.where("NOT open").drop("open"), first.where("open").drop("open")
    final, levels, length = [], [], 1
    while True:
        n = now.count()
        own = F.broadcast(now) if n <= FEW else now  # FEW rows of 20 bytes at most
        known = reduce(DataFrame.unionByName, [now, single, *final]).select(F.col("tx").alias("t"), (F.col("at") - length).alias("p"), F.col("rank").alias("next"))
        halves = scratch.table(known.join(own, (own.tx == known.t) & (own["at"] == known.p)).select("tx", "at", "rank", "next"), "halves")
        last = now.join(halves.select(F.col("tx").alias("t"), F.col("at").alias("p")), (F.col("tx") == F.col("t")) & (F.col("at") == F.col("p")), "left_anti")
        both = halves.unionByName(last.select("tx", "at", "rank", (-1 - F.shiftrightunsigned("tx", 1)).alias("next")))  # the texts that end
        if n <= FEW:
            break
        levels.append(now)
        groups = ordered(both.groupBy("rank", "next").agg(F.count("*").alias("n")), "rank", ["next"], scratch)
        groups = groups.select(F.col("rank").alias("r"), F.col("next").alias("x"), "n", (F.col("rank") + F.col("offset")).alias("new"))
        got = scratch.table(both.join(groups, (both.rank == groups.r) & (both.next == groups.x)).select("tx", "at", F.col("new").alias("rank"), (F.col("n") > 1).alias("open")), "ranks")
        scratch.drop(halves)
        final.append(got.where("NOT open").drop("open"))
        now, length = got.where("open").drop("open"), 2 * length

    def end(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None  # FEW rows at most
        if table:
            rank, base = finish(table, length)
            yield from pa.table([pa.array(rank), table.column("tx"), table.column("at"), pa.array(base.astype(np.int32))], ["rank", "tx", "at", "lcp"]).to_batches(8192)

    ended = both.repartition(1).mapInArrow(end, "rank bigint, tx bigint, at int, lcp int")
    suffixes = reduce(DataFrame.unionByName, [f.select("rank", "tx", "at", F.lit(0).alias("lcp")) for f in final], ended)
    suffixes = scratch.table(suffixes, "suffixes")
    if not levels:
        return suffixes
    prior = suffixes.select((F.col("rank") + 1).alias("rank"), F.col("tx").alias("o_tx"), F.col("at").alias("o_at"))
    now = suffixes.join(prior, "rank")
    for j in range(len(levels) - 1, -1, -1):
        x, y = (levels[j].select(F.col("tx").alias(f"{c}_t"), F.col("at").alias(f"{c}_p"), F.col("rank").alias(f"{c}_r")) for c in "xy")
        now = now.join(x, (now.tx == x.x_t) & (now["at"] + now.lcp == x.x_p), "left").join(y, (now.o_tx == y.y_t) & (now.o_at + now.lcp == y.y_p), "left")
        now = scratch.table(now.select("rank", "tx", "at", "o_tx", "o_at", (F.col("lcp") + F.when(F.col("x_r") == F.col("y_r"), 1 << j).otherwise(0)).alias("lcp")), "prefixes")
    return suffixes.drop("lcp").join(now.select("rank", "lcp"), "rank", "left").select("rank", "tx", "at", F.coalesce("lcp", F.lit(0)).alias("lcp"))


def intervals(array: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """array and ``starts``: for each number of lines 1 to depth, the rank at which the interval begins whose suffixes share them."""

    def fill(b, state):
        rank, lcp = b.column("rank").to_numpy(), b.column("lcp").to_numpy()
        out = np.empty((b.num_rows, depth), np.int64)
        for m in range(1, depth + 1):
            start = np.where(lcp < m, rank, -1)
            start[0] = max(start[0], state.get(m, -1))
            out[:, m - 1] = np.maximum.accumulate(start)
            state[m] = int(out[-1, m - 1])
        return {"starts": pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * depth), pa.array(out.ravel()))}

    part = _in_parts(array, ["rank"], scratch, fill, "starts array<bigint>")
    last = sorted(tuple(r) for r in part.groupBy("part").agg(*[F.max(F.element_at("starts", m)).alias(f"s{m}") for m in range(1, depth + 1)]).collect())  # one row a partition
    carry, held = [], [-1] * depth
    for p, *s in last:
        carry.append((p, list(held)))
        held = [max(x, y) for x, y in zip(held, s)]
    carry = part.sparkSession.createDataFrame(carry, "part int, held array<bigint>")
    return part.join(F.broadcast(carry), "part").select("rank", "tx", "at", "lcp", F.zip_with("starts", "held", lambda x, y: F.greatest(x, y)).alias("starts"))


def copies(docs: DataFrame, min_lines: int, min_words: int, scratch: Scratch) -> DataFrame:
    """(tx, lead, many, marks): for each distinct text its least doc_id, whether other documents hold it too, and
    where runs start in it: at, ``late`` lines that came before, ``first`` lines that come again but not before (0: none)."""
    texts = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("tx"), F.struct("doc_id").alias("d"))
    texts = scratch.table(texts.groupBy("tx").agg(F.min("d").alias("lead"), F.max("d").alias("last")).select("tx", "lead", (~F.col("lead").eqNullSafe(F.col("last"))).alias("many")), "texts")
    lines = scratch.table(line_table(docs, min_lines, min_words), "lines")
    array = intervals(suffix_array(lines, scratch), min_lines, scratch)
    runs = array.join(lines.select("tx", "at", "need").where("need IS NOT NULL"), ["tx", "at"]).join(texts, "tx")
    runs = runs.select("tx", "at", "many", F.struct("lead", "tx", "at").alias("place"), F.explode(F.expr(f"transform(sequence(need, {min_lines}), m -> named_struct('m', m, 'start', element_at(starts, m)))")).alias("i"))
    runs = scratch.table(runs.select("tx", "at", "many", "place", "i.m", "i.start"), "runs")
    low = runs.groupBy("m", "start").agg(F.min("place").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    seen = runs.join(low, ["m", "start"])
    late = F.max(F.when(~F.col("place").eqNullSafe(F.col("low")), F.col("m")).otherwise(0))
    first = F.max(F.when(F.col("place").eqNullSafe(F.col("low")), F.col("m")).otherwise(0))
    marks = seen.groupBy("tx", "at").agg(late.alias("late"), first.alias("first"))
    marks = marks.groupBy("tx").agg(F.array_sort(F.collect_list(F.struct("at", "late", "first"))).alias("marks"))  # as many as the text has lines, at most
    return texts.join(marks, "tx", "left").where("many OR marks IS NOT NULL").select("tx", "lead.doc_id", "many", "marks")


def _dead(lines: list[str], later: bool, many: bool, marks: list, min_lines: int, min_words: int) -> list[bool]:
    """Which lines of a text go. later: it isn't the first document of this text; many: others hold the text."""
    n, late, first = len(lines), {}, {}
    for m in marks or ():
        late[m["at"]], first[m["at"]] = m["late"], m["first"]
    if many:  # every run of the text is repeated
        c = [len(x.encode().split()) for x in lines]
        for p in range(n):
            most = min(min_lines, n - p)
            if most == min_lines or sum(c[p : p + most]) > min_words:
                if later:
                    late[p], first[p] = most, 0
                elif late.get(p, 0) < most:
                    first[p] = most
    dead = [False] * n
    for p, m in late.items():
        dead[p : p + m] = [True] * m
    for p, m in first.items():
        dead[p : p + m] = [False] * m
    return dead


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs (all their columns), with the later copies of repeated line runs deleted from ``text``.

    A run is min_lines consecutive lines, or fewer of more than min_words words together. A line goes if it lies in a run
    that also starts earlier (in a document of smaller doc_id, or further up in the same one), unless it also lies in
    one that comes again but not earlier: the first copy of a repeated run stays, even where it overlaps a later one.
    n_lines and n_removed count lines (a text without a line break has one; null has none and stays null).
    Rows that agree in id and text are one document, and all of them get its result; null ids come first;
    rows of one id with other texts come in the order of a hash of the text. Texts are told apart by 64-bit hashes, lines by
    128-bit ones. Empty tables give no rows. Columns of docs named n_lines or n_removed are replaced.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    gone = scratch.table(copies(pick(docs, "doc_id", "text"), min_lines, min_words, scratch), "gone")
    scratch.only(gone)
    gone = gone.select(F.col("tx").alias("g_tx"), F.col("doc_id").alias("g_id"), F.col("many").alias("g_many"), F.col("marks").alias("g_marks"))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    doc_id, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    both = rows.join(gone.hint("shuffle_hash"), F.xxhash64(text) == F.col("g_tx"), "left").withColumn("g_later", F.col("g_tx").isNotNull() & ~doc_id.eqNullSafe(F.col("g_id"))).drop("g_id", "g_tx")
    at = names.index("text")

    def cut(batches):
        for part in sliced(batches):
            out, n, removed = [], [], []
            for t, later, many, marks in zip(*(part.column(c).to_pylist() for c in (at, "g_later", "g_many", "g_marks"))):
                lines = t.split("\n") if t is not None else []
                n.append(len(lines))
                if many or marks:
                    lines = [x for x, d in zip(lines, _dead(lines, later, many, marks, min_lines, min_words)) if not d]
                removed.append(n[-1] - len(lines))
                out.append(t if t is None else "\n".join(lines))
            cols = [part.column(i) for i in range(len(names))]
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(removed, pa.int64())], [*[f"c{i}" for i in range(len(names))], "n_lines", "n_removed"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    got = both.mapInArrow(cut, f"{schema}, n_lines bigint, n_removed bigint")
    return got.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "n_lines", "n_removed")


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup_lines(pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS w FROM documents),
l AS (SELECT doc_id, w, list_transform(w, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS c FROM d),
p AS (SELECT doc_id, p, m, m || md5(array_to_string(w[p:p + m - 1], chr(10))) AS h
      FROM (SELECT doc_id, w, c, unnest(range(1, len(w) + 1)) AS p FROM l), (SELECT unnest([1, 2, 3]) AS m)
      WHERE p + m - 1 <= len(w) AND (m = 3 OR list_sum(c[p:p + m - 1]) > 50)),
n AS (SELECT doc_id, p, m, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS n, count(*) OVER (PARTITION BY h) AS c FROM p),
late AS (SELECT doc_id, unnest(range(p, p + m)) AS q FROM n WHERE n > 1),
kept AS (SELECT doc_id, unnest(range(p, p + m)) AS q FROM n WHERE n = 1 AND c > 1),
x AS (SELECT doc_id, list(q) AS gone FROM (SELECT * FROM late EXCEPT SELECT * FROM kept) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(
    list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]), chr(10)), '') END) AS text_sha256
FROM d LEFT JOIN x USING (doc_id)
"""
