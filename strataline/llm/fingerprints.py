"""Document fingerprints by locally consistent parsing: deterministic coin tossing builds a hierarchy of phrase names."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, pick, sliced

#: Slots of a fingerprint: so many over the names of the first level (some 3 bytes each), the others over all higher ones.
LOW_SLOTS, HIGH_SLOTS = 16, 48
#: Texts parsed at a time: their arrays fit a core's cache.
ROWS = 64
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits; consumes its argument."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _stream(seed: int, n: int) -> np.ndarray:
    """n spread numbers that depend on the seed alone."""
    return _mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_BYTES, _POWERS, _SEEDS = _stream(1, 256), _stream(2, 64) | _U(1), _stream(3, LOW_SLOTS + HIGH_SLOTS) | _U(1)
_LENGTH, _SIZE, _LEVEL = (int(x) | 1 for x in _stream(4, 3))


def _toss_table() -> np.ndarray:
    """For two different bytes before << 8 | here: twice the place of the lowest bit in which they differ, and that bit of ``here``."""
    before, here = np.divmod(np.arange(1 << 16), 256)
    odd = (before ^ here) | 256
    place = np.round(np.log2(odd & -odd)).astype(np.int64)
    return (2 * place + (here >> place & 1)).astype(np.uint8)


_TOSS = _toss_table()


def _toss(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Labels below 6 of symbols that differ from their neighbours; neighbours' labels differ too. A label depends on the symbol
    and the four before it. The first of a text is compared with itself but for its lowest bit."""

    def before(y):
        out = np.empty_like(y)
        out[1:] = y[:-1]
        out[begin] = y[begin] ^ y.dtype.type(1)
        return out

    rounds = 3  # below 256, 16, 8, 6
    if x.dtype == np.uint64:
        odd = x ^ before(x)
        place = (np.frexp((odd & (~odd + _U(1))).astype(np.float64))[1] - 1).astype(np.uint8)
        x = (2 * place + (x >> place & _U(1)).astype(np.uint8)).astype(np.uint8)  # below 128
    for _ in range(rounds):
        x = _TOSS.take(before(x).astype(np.uint16) << np.uint16(8) | x)
    return x


def phrases(x: np.ndarray, begin: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, begin) of the next level of the hierarchy: bytes or names x of some texts that start at ``begin`` are cut into phrases.

    A run of equal symbols is one symbol. Phrases start at the local maxima of the labels, so a place is a cut because of a
    few symbols around it alone; a text's first two symbols and its last one are none, so that a text of several symbols shrinks.
    A name is a hash of what it stands for.
    """
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    new[begin] = True
    at = np.flatnonzero(new)
    y, begin = x[at], np.searchsorted(at, begin)
    label = _toss(y, begin)
    up, peak = label[1:] > label[:-1], np.zeros(len(y), bool)
    peak[1:-1] = up[:-1] & ~up[1:]
    second = begin + 1
    peak[second[second < len(y)]] = False
    peak[begin - 1] = False  # -1 is the last symbol of the last text
    peak[-1] = False
    peak[begin] = True
    cut = np.flatnonzero(peak)
    size = np.diff(cut, append=len(y))
    value = _BYTES.take(y) if y.dtype == np.uint8 else y
    run = np.diff(at, append=len(x))
    if (many := np.flatnonzero(run > 1)).size:
        value = value.copy()
        value[many] = _mix(value[many] + run[many].astype(_U) * _U(_LENGTH))
    place = np.arange(len(y)) - np.repeat(cut, size)
    names = np.add.reduceat(value * _POWERS.take(place), cut)  # a phrase has 10 symbols at most, as labels rise and fall between 0 and 5
    return _mix(names + size.astype(_U) * _U(_SIZE) + _U(level * _LEVEL % (1 << 64))), np.searchsorted(cut, begin)


def names(texts: list[bytes]):
    """(level, number of each text that has come so far, where its names start, names) from level 1 up; a text ends with its only name."""
    size = np.array([len(t) for t in texts], np.int64)
    which = np.flatnonzero(size)
    x, level = np.frombuffer(b"".join(texts), np.uint8), 0
    begin = (np.cumsum(size) - size)[which]
    while len(which):
        level += 1
        x, begin = phrases(x, begin, level)
        yield level, which, begin, x
        count = np.diff(begin, append=len(x))
        on = count > 1
        if not on.all():
            x, which, count = x[np.repeat(on, count)], which[on], count[on]
            begin = np.cumsum(count) - count


def fingerprint(texts: list[bytes]) -> np.ndarray:
    """One row of 16-bit slots for each text: minima of hashes of its names, so that two texts agree in a slot as often as their sets
    of names overlap (Jaccard). A text of one first-level name has it in the high slots as well; the empty text is all zeros."""
    least = np.full((len(_SEEDS), len(texts)), ~_U(0))
    for level, which, begin, x in names(texts):
        for k in range(0, LOW_SLOTS) if level == 1 else range(LOW_SLOTS, len(_SEEDS)):
            got = np.minimum.reduceat(x * _SEEDS[k], begin)
            least[k, which] = np.minimum(least[k, which], got)
        if level == 1:
            only = np.flatnonzero(np.diff(begin, append=len(x)) == 1)
            least[LOW_SLOTS:, which[only]] = x[begin[only]] * _SEEDS[LOW_SLOTS:, None]
    out = (_mix(least) >> _U(48)).astype(np.uint16)
    out[:, [i for i, t in enumerate(texts) if not t]] = 0
    return np.ascontiguousarray(out.T)


def _hex(slots: np.ndarray) -> list[str]:
    raw = slots.astype(">u2").tobytes().hex()
    width = 4 * slots.shape[1]
    return [raw[i : i + width] for i in range(0, len(raw), width)]


def likeness(a, b):
    """Share of equal slots of two fingerprint columns, 0 to 1."""
    equal = F.aggregate(
        F.sequence(F.lit(0), F.lit(LOW_SLOTS + HIGH_SLOTS - 1)), F.lit(0),
        lambda n, i: n + (F.substring(a, i * 4 + 1, F.lit(4)) == F.substring(b, i * 4 + 1, F.lit(4))).cast("int"),
    )
    return equal / F.lit(float(LOW_SLOTS + HIGH_SLOTS))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs and a column ``fingerprint``: hex digits of the slots over the UTF-8 bytes of ``text`` (null counts as empty).

    Equal texts have equal fingerprints, whatever else is in the table; rows stay as they are. A column of that name is replaced.
    """
    names_ = [c for c in docs.columns if c != "fingerprint"]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names_)])
    at = names_.index("text")

    def run(batches):
        for part in sliced(batches, ROWS):
            slots = fingerprint([(t or "").encode() for t in part.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_hex(slots), pa.string())], [*part.schema.names, "fingerprint"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    got = rows.mapInArrow(run, f"{schema}, fingerprint string")
    return got.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names_)], "fingerprint")


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _compare(ids: pa.Array, texts: list[str], following: list[str], own: np.ndarray, after: np.ndarray) -> list:
    """Columns of result rows, given the slots of the texts and of those that follow."""
    changed = [edited(t, f).encode() for t, f in zip(texts, following)]
    slots = fingerprint(changed)
    likely = [np.mean(own == x, axis=1) if len(texts) else np.zeros(0) for x in (slots, after)]
    return [ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([sha256(t).hexdigest() for t in changed], pa.string()), pa.array(_hex(own), pa.string()), pa.array(_hex(slots), pa.string()), *map(pa.array, likely)]


_RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def edit_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next: each text beside an edit of it, whose last
    third is the beginning of the next document's text, and beside that document.

    Next is the document of the next smaller id; after the smallest (null ids) comes the largest. Rows of one id come in the order of a hash of
    the text, rows that agree in both in any order. Null texts are empty. A table of one row is its own next; an empty one gives no rows.
    Texts are sorted by ranges over all tasks, once; a task finds what follows in its own rows, and of each task only the last row
    waits for the first one of the task after it.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "fingerprints")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keys = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("m")]  # m tells equal rows apart, so that any number of them can be dealt out
    rows = rows.withColumns({"h": F.xxhash64("text"), "m": F.monotonically_increasing_id()}).repartitionByRange(*keys).sortWithinPartitions(*keys)
    results = f"doc_id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def edge(ids, text, slots, part, end):
        blank = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([ids, *blank, pa.array([part], pa.int32()), pa.array([end]), pa.array([text], pa.string()), pa.array([slots.tobytes()], pa.binary())], [*_RESULT, "part", "end", "text", "slots"])

    def run(batches):
        part, held = TaskContext.get().partitionId(), None
        for b in sliced(batches, ROWS):
            ids, texts = b.column("doc_id"), b.column("text").to_pylist()
            slots = fingerprint([t.encode() for t in texts])
            if held is None:
                yield edge(ids.slice(0, 1), texts[0], slots[0], part, False)
            else:
                ids, texts, slots = pa.concat_arrays([held[0], ids]), [held[1], *texts], np.concatenate([held[2], slots])
            n = len(texts) - 1
            got, blank = _compare(ids.slice(0, n), texts[:-1], texts[1:], slots[:-1], slots[1:]), [pa.nulls(n, t) for t in (pa.bool_(), pa.string(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*got, pa.array(np.full(n, part, np.int32)), *blank], [*_RESULT, "part", "end", "text", "slots"])
            held = ids.slice(n, 1), texts[-1], slots[-1:]
        if held is not None:
            yield edge(held[0], held[1], held[2], part, True)

    done = scratch.table(rows.select("doc_id", "text").mapInArrow(run, f"{results}, part int, end boolean, text string, slots binary"), "rows")
    order = Window.orderBy("part")  # one row a task
    first = done.where("end = false").select("part", F.col("text").alias("next_text"), F.col("slots").alias("next_slots"))
    last = done.where("end = true").select("doc_id", "text", "slots", "part")
    to = last.select("part").withColumns({"to": F.lead("part").over(order), "top": F.min("part").over(Window.partitionBy())})
    last = last.join(to.select("part", F.coalesce("to", "top").alias("to")), "part").join(first.withColumnRenamed("part", "to"), "to")

    def close(batches):
        for b in sliced(batches, ROWS):
            own, after = (np.stack([np.frombuffer(x, np.uint16) for x in b.column(c).to_pylist()]) for c in ("slots", "next_slots"))
            yield pa.RecordBatch.from_arrays(_compare(b.column("doc_id"), b.column("text").to_pylist(), b.column("next_text").to_pylist(), own, after), _RESULT)

    return done.where("end IS NULL").select(*_RESULT).unionByName(last.select("doc_id", "text", "slots", "next_text", "next_slots").mapInArrow(close, results))


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))
