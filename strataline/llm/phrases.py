"""Phrase collocations: candidates from sketch upper bounds, counted exactly by delimiter-guarded automata."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, pick, sliced

#: Words of a phrase at most, its least count, and phrases returned for a language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Buckets of a sketch (2 to this power), and bits of a filter of heavy buckets at most (8 MB); a fuller filter lets more through and changes no result.
SKETCH_BITS, FILTER_BITS = 40, 1 << 26
#: Hashes that a task keeps before it folds them, and bytes of phrases that the automata of one scan are built from.
HELD, ROUND_BYTES = 1 << 21, 48 << 20
#: Counts of phrases that travel together, and tasks whose counts are added up at a time.
BLOCK, FAN = 1 << 10, 64
#: Stands between pieces and between texts; no UTF-8 text holds this byte.
GUARD = b"\xff"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + 10 * GUARD)
_U = np.uint64


class _Hash(dict):
    """XXH64 of each word, 0 for the guard; emptied when large."""

    def __missing__(self, word):
        if len(self) > 400_000:
            self.clear()
        self[word] = got = 0 if word == GUARD else xxhash.xxh64_intdigest(word)
        return got


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words(part: pa.RecordBatch):
    """(lang, words) of some texts: those of a language one after the other, a guard after each piece and each text."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
        texts.setdefault(lang, []).append(text)
    for lang, some in texts.items():
        yield lang, (GUARD.join(some) + GUARD).translate(_TABLE).replace(GUARD, b" \xff ").split()


def runs(hashes: np.ndarray, lang: str, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``longest`` words: the sketch bucket of the words from each place on, and whether no guard is among them."""
    inside = hashes != 0
    h, ok, out = _mix(hashes + _U(xxhash.xxh64_intdigest(lang))), inside, []
    for k in range(1, longest + 1):
        if k > 1:
            h, ok = _mix(h[:-1] * _U(0x9E3779B97F4A7C15) + hashes[k - 1 :] + _U(k)), ok[:-1] & inside[k - 1 :]
        out.append(((h >> _U(64 - SKETCH_BITS)).astype(np.int64), ok))
    return out


def passes(bits: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether a filter has the buckets; an empty filter has none."""
    if not len(bits):
        return np.zeros(len(bucket), bool)
    at = bucket & (8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & np.uint8(1)).astype(bool)


def filter_of(buckets: DataFrame) -> np.ndarray:
    """Bits of the buckets, 64 for each of them but FILTER_BITS at most, put together before they come to the driver."""
    n = buckets.count()
    if not n:
        return np.zeros(0, np.uint8)
    size = min(FILTER_BITS, 1 << max(6, int(64 * n - 1).bit_length()))
    at = F.col("bucket").bitwiseAND(size - 1)
    got = buckets.groupBy(F.shiftright(at, 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(bucket & 63 AS int)))").alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
    out = np.zeros(size // 64, np.int64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint8)


def heavy_runs(hashes: np.ndarray, lang: str, longest: int, ones: np.ndarray, twos: np.ndarray | None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(k, bucket, ok) of the runs of k words that may be frequent by what is known of shorter ones: both words of a pair, all pairs of more."""
    made, out = runs(hashes, lang, longest), []
    one = made[0][1] & passes(ones, made[0][0])
    pair = one[:-1] & one[1:] & made[1][1] if len(one) > 1 else one[:0]
    if twos is None:
        return [(2, made[1][0], pair)]
    ok = pair & passes(twos, made[1][0])
    chain = ok
    out.append((2, made[1][0], ok))
    for k in range(3, longest + 1):
        chain = chain[:-1] & ok[k - 2 :]
        out.append((k, made[k - 1][0], chain & made[k - 1][1]))
    return out


def sketch(docs: DataFrame, least: int, some, by_lang: bool = False) -> DataFrame:
    """(bucket, n) or (lang, bucket, n): how many of the buckets that ``some(hashes, lang)`` gives fall together, over all texts, where n
    is ``least`` or more. Runs that share a bucket are counted together, so n is never below a run's own count. Tasks add up first."""

    def run(batches):
        memo, held, rows = _Hash(), {}, 0

        def out(lang):
            got = held.pop(lang)
            buckets, at = np.unique(np.concatenate([b for b, _ in got]), return_inverse=True)
            sums = np.zeros(len(buckets), np.int64)
            np.add.at(sums, at, np.concatenate([n for _, n in got]))
            return buckets, sums

        def batch(lang, got):
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(got[0]), pa.string()), pa.array(got[0]), pa.array(got[1])], ["lang", "bucket", "n"])

        for part in sliced(batches):
            for lang, flat in words(part):
                got = some(np.fromiter(map(memo.__getitem__, flat), _U, len(flat)), lang)
                buckets, n = np.unique(got, return_counts=True)
                held.setdefault(lang if by_lang else "", []).append((buckets, n))
                rows += len(buckets)
            if rows > HELD:
                for lang in list(held):
                    held[lang] = [out(lang)]
                rows = sum(len(v[0][0]) for v in held.values())
                if rows > HELD // 2:
                    for lang in list(held):
                        yield batch(lang, held.pop(lang)[0])
                    rows = 0
        for lang in list(held):
            yield batch(lang, out(lang))

    keys = ["lang", "bucket"] if by_lang else ["bucket"]
    return docs.mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def candidates(docs: DataFrame, longest: int, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): all phrases whose sketched count reaches ``least``, as (lang, phrase, k), and how many words each language has.

    Words are sketched first, then pairs of words that may be frequent, then longer runs whose pairs all may be: a phrase is never more
    frequent than its parts, so none is lost. Only filters of bounded size reach the tasks.
    """
    spark = docs.sparkSession
    words_n = scratch.table(sketch(docs, 1, lambda h, lang: runs(h, lang, 1)[0][0][h != 0], by_lang=True), "words")
    totals = scratch.table(words_n.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    heavy_words = words_n.where(F.col("n") >= least).select("bucket").distinct()
    ones = spark.sparkContext.broadcast(filter_of(heavy_words))
    scratch.drop(words_n)

    def pairs(h, lang):
        _, bucket, ok = heavy_runs(h, lang, 2, ones.value, None)[0]
        return bucket[ok]

    two = scratch.table(sketch(docs, least, pairs), "pairs")
    twos = spark.sparkContext.broadcast(filter_of(two))

    def longer(h, lang):
        return np.concatenate([bucket[ok] for _, bucket, ok in heavy_runs(h, lang, longest, ones.value, twos.value)[1:]] or [np.zeros(0, np.int64)])

    more = scratch.table(sketch(docs, least, longer), "longer")
    many = spark.sparkContext.broadcast(filter_of(more))

    def gather(batches):
        memo, seen, held = _Hash(), {}, 0
        for part in sliced(batches):
            got = []
            for lang, flat in words(part):
                known = seen.setdefault(lang, set())
                for k, bucket, ok in heavy_runs(np.fromiter(map(memo.__getitem__, flat), _U, len(flat)), lang, longest, ones.value, twos.value):
                    at = np.flatnonzero(ok)
                    if k > 2:
                        at = at[passes(many.value, bucket[at])]
                    for i in at.tolist():
                        phrase = b" ".join(flat[i : i + k])
                        if phrase not in known:
                            known.add(phrase)
                            got.append((lang, phrase, k, int(bucket[i])))
            held += len(got)
            if held > 200_000:  # what comes out again is merged below
                seen, held = {}, 0
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.string(), pa.binary(), pa.int32(), pa.int64()))], ["lang", "phrase", "k", "bucket"])

    found = docs.mapInArrow(gather, "lang string, phrase binary, k int, bucket bigint").distinct()
    heavy = two.unionByName(more).select("bucket").distinct()
    kept = found.join(heavy, "bucket", "left_semi").select("lang", F.col("phrase").cast("string").alias("phrase"), "k")
    return scratch.table(kept, "candidates"), totals


def automaton(langs: list[str], phrases: pa.Array) -> tuple:
    """(words, langs, steps, ends) of an automaton over words that knows the distinct phrases of each language.

    A state is reached by the first words of some phrase; steps[j] holds the sorted keys (state after j words) * (number of words) +
    word, and a key's place is the next state; ends[j] says which phrase ends there, or -1. No key holds a guard.
    """
    split = pc.split_pattern(phrases, " ")
    size, word = split.value_lengths().to_numpy().astype(np.int64), split.flatten().dictionary_encode()
    start, ids, names = np.cumsum(size) - size, word.indices.to_numpy().astype(np.int64), sorted(set(langs))
    of = {lang: i for i, lang in enumerate(names)}
    at, state, steps, ends = np.arange(len(size)), np.fromiter(map(of.__getitem__, langs), np.int64, len(langs)), [], []
    while len(at):
        keys, state = np.unique(state * len(word.dictionary) + ids[start[at] + len(steps)], return_inverse=True)
        steps.append(keys)
        last = size[at] == len(steps)
        ends.append(np.full(len(keys), -1, np.int64))
        ends[-1][state[last]] = at[last]
        at, state = at[~last], state[~last]
    return word.dictionary.cast(pa.binary()), names, steps, ends


def occurrences(steps: list[np.ndarray], n_words: int, lang: int, ids: np.ndarray, counts: list[np.ndarray]) -> None:
    """Walks the automaton from every one of the words (-1: a guard, or one that no phrase has) at once and adds to the counts of the states."""
    at = np.flatnonzero(ids >= 0)
    state = np.full(len(at), lang, np.int64)
    for j, keys in enumerate(steps):
        key = state * n_words + ids[at]
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        ok = keys[place] == key
        state, at = place[ok], at[ok] + 1
        np.add.at(counts[j], state, 1)
        ok = at < len(ids)
        ok[ok] = ids[at[ok]] >= 0
        state, at = state[ok], at[ok]


def _added(table: pa.Table) -> pa.Table:
    """One block of counts: the sum of those of FAN tasks at most."""
    total = sum(np.frombuffer(x, np.int64) for x in table.column("sum").to_pylist())
    first = table.slice(0, 1)
    return pa.Table.from_arrays([first.column("block"), first.column("task"), pa.array([total.tobytes()], pa.binary())], table.schema.names)


def counted(docs: DataFrame, phrases: DataFrame, scratch: Scratch, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(lang, phrase, k, n): how often each of phrases(lang, phrase, k) occurs in the texts of its language, overlaps included.

    An automaton over words finds all phrases of a language at once; it has no step over a guard, so none crosses the end of a piece. A state
    is one number, whatever the words are, so a scan takes millions of phrases. Tasks get the phrases of one round (``round_bytes`` of them);
    more phrases take more rounds, each a scan of its own. Counts leave a task in blocks, which are added up in arrays.
    """
    spark = docs.sparkSession
    size = phrases.agg(F.coalesce(F.sum(F.octet_length("phrase") + 24), F.lit(0))).first()[0]
    rounds = max(1, -(-size // round_bytes))
    listed = scratch.table(phrases.withColumns({"id": F.monotonically_increasing_id(), "round": F.pmod(F.xxhash64("lang", "phrase"), F.lit(rounds)).cast("int")}), "listed")
    done = []
    for number in range(rounds):
        some = listed.where(F.col("round") == number).select("lang", "id", "phrase").toArrow()  # round_bytes of phrases
        shared = spark.sparkContext.broadcast((some.column("id").to_numpy(), *automaton(some.column("lang").to_pylist(), some.column("phrase").combine_chunks())))
        del some

        def scan(batches, shared=shared):
            ids, listed_words, langs, steps, ends = shared.value
            known, of = {w: i for i, w in enumerate(listed_words.to_pylist())}, {lang: i for i, lang in enumerate(langs)}
            counts, total = [np.zeros(len(keys), np.int64) for keys in steps], np.zeros(len(ids), np.int64)
            for part in sliced(batches):
                for lang, flat in words(part):
                    if lang in of:
                        occurrences(steps, len(known), of[lang], np.fromiter(map(known.get, flat, repeat(-1)), np.int64, len(flat)), counts)
            for end, n in zip(ends, counts):
                total[end[end >= 0]] = n[end >= 0]
            total = np.pad(total, (0, -len(total) % BLOCK)).reshape(-1, BLOCK)
            at = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), TaskContext.get().partitionId(), np.int32)), pa.array([x.tobytes() for x in total[at]], pa.binary())], ["block", "task", "sum"])

        parts = scratch.table(docs.mapInArrow(scan, "block int, task int, sum binary"), "parts")
        tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
        summed = parts
        while True:  # FAN tasks' blocks at a time
            tasks = -(-tasks // FAN)
            summed = summed.withColumn("task", F.expr(f"CAST(task DIV {FAN} AS int)")).groupBy("block", "task").applyInArrow(_added, parts.schema)
            if tasks == 1:
                break

        def unpack(batches, shared=shared):
            ids = shared.value[0]
            for b in batches:
                for block, total in zip(b.column("block").to_pylist(), b.column("sum").to_pylist()):
                    n = np.frombuffer(total, np.int64)[: len(ids) - block * BLOCK]
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[block * BLOCK + at]), pa.array(n[at])], ["id", "n"])

        done.append(scratch.table(summed.mapInArrow(unpack, "id bigint, n bigint"), "counts"))
        scratch.drop(parts)
        shared.destroy()
    sums = done[0]
    for more in done[1:]:
        sums = sums.unionByName(more)
    return listed.join(sums, "id").select("lang", "phrase", "k", "n")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language by score, a, and the phrase in byte order.

    Texts of docs(text, lang) are cut into pieces at punctuation and line breaks, those into words at spaces and tabs; A-Z is lower-cased.
    A phrase is 2 to ``longest`` words of a piece that come ``least`` times or more (a) among the n words of the language. Its score is the least
    of floor(1000 a n / (l r)) over the places where it can be cut in two, l and r being how often the parts come; of equal cuts the first
    counts. A phrase goes if a longer one that holds it comes as often. A null text is empty, a null language is ``und``; repeated rows count
    each; a table without such a phrase gives no rows. Whole numbers are exact up to 38 digits.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    docs = docs.coalesce(2 * spark.sparkContext.defaultParallelism)  # what each task adds up is handed on once for all its input: fewer tasks, fewer rows
    docs = docs.select(F.coalesce("`text`", F.lit("")).alias("text"), F.coalesce("`lang`", F.lit("und")).alias("lang"))
    found, totals = candidates(docs, longest, least, scratch)
    parts = found.select("lang", F.explode(F.array_distinct(F.split("phrase", " "))).alias("phrase")).distinct()
    freq = scratch.table(counted(docs, found.unionByName(parts.withColumn("k", F.lit(1))), scratch, round_bytes).where(F.col("n") >= least), "frequent")
    phrases = freq.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.expr("array_join(slice(w, 1, cut), ' ')").alias("first"), F.expr("array_join(slice(w, cut + 1, size(w)), ' ')").alias("rest"))
    left, right = (freq.select(F.col("lang").alias(f"{c}_lang"), F.col("phrase").alias(f"{c}_phrase"), F.col("n").alias(c)) for c in "lr")
    cuts = cuts.join(left, (F.col("lang") == F.col("l_lang")) & (F.col("first") == F.col("l_phrase"))).join(right, (F.col("lang") == F.col("r_lang")) & (F.col("rest") == F.col("r_phrase")))
    score = F.expr("CAST((1000 * CAST(a AS decimal(17, 0)) * CAST(n AS decimal(17, 0))) DIV (CAST(l AS decimal(19, 0)) * CAST(r AS decimal(19, 0))) AS bigint)")
    scored = cuts.join(F.broadcast(totals), "lang").withColumn("score", score)  # totals: a row a language
    scored = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "n")).alias("best")).select("lang", "phrase", "best.*")
    inner = phrases.where("k > 2").select("lang", F.col("a").alias("longer"), F.explode(F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(w, i, m), ' '))))")).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 100 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # each task keeps its own first ones before the shuffle
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", "lang"))


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
v AS (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS k FROM w),
i AS (SELECT lang, w, k, unnest(range(1, CAST(len(w) AS BIGINT) - k + 2)) AS i FROM v WHERE len(w) >= k),
g AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM i GROUP BY ALL),
n AS MATERIALIZED (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
h AS MATERIALIZED (SELECT * FROM g WHERE f >= 100),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM h WHERE k > 1),
u AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS cut FROM c),
t AS MATERIALIZED (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:k], ' ') AS rest FROM u),
s AS (SELECT t.lang, t.phrase, t.a, x.f AS l, y.f AS r, n.n, CAST((1000::HUGEINT * t.a * n.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score, t.cut
      FROM t JOIN n USING (lang) JOIN h x ON x.lang = t.lang AND x.phrase = t.first JOIN h y ON y.lang = t.lang AND y.phrase = t.rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN c ON c.lang = b.lang AND len(c.phrase) > len(b.phrase) AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * c.a >= 100 * b.a),
r AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN o USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= 2000
"""
