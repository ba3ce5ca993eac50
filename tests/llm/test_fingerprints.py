import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F
from strataline.llm import fingerprints as fp

M = (1 << 64) - 1


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def stream(seed, n):
    return [plain_mix((i * 0x9E3779B97F4A7C15 + seed) & M) for i in range(1, n + 1)]


def toss(symbols, rounds):
    for _ in range(rounds):
        before = [symbols[0] ^ 1, *symbols[:-1]]
        place = [((a ^ b) & -(a ^ b)).bit_length() - 1 for a, b in zip(before, symbols)]
        symbols = [2 * p + (b >> p & 1) for p, b in zip(place, symbols)]
    return symbols


def plain_names(text: bytes):
    """Names of every level of one text, symbol by symbol."""
    table, powers = stream(1, 256), [p | 1 for p in stream(2, 64)]
    length, size, step = (x | 1 for x in stream(4, 3))
    symbols, level, out = list(text), 0, []
    while symbols and (level == 0 or len(symbols) > 1):
        level += 1
        runs = []
        for s in symbols:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        label = toss([s for s, _ in runs], 3 if level == 1 else 4)
        value = [table[s] if level == 1 else s for s, _ in runs]
        value = [plain_mix((v + n * length) & M) if n > 1 else v for v, (_, n) in zip(value, runs)]
        starts = [i for i in range(len(runs)) if i == 0 or 1 < i < len(runs) - 1 and label[i - 1] < label[i] > label[i + 1]]
        symbols = [plain_mix((sum(v * p for v, p in zip(value[a:b], powers)) + (b - a) * size + level * step) & M) for a, b in zip(starts, [*starts[1:], len(runs)])]
        out.append(symbols)
    return out


def plain_slots(text: bytes):
    low, levels = fp.LOW_SLOTS, plain_names(text)
    if not levels:
        return [0] * 64
    high = [x for names in levels[1:] for x in names] or levels[0]
    seeds = [x | 1 for x in stream(3, 64)]
    return [plain_mix(min(x * s & M for x in (levels[0] if k < low else high))) >> 48 for k, s in enumerate(seeds)]


TEXTS = ["", "a", "aa", "ab", "aaaaaaaaab", "abcabcabcabcabcabc", "ÄÖ𝔘 straße", "x" * 5000, "the same words " * 40]


def test_parsing_equals_a_plain_one():
    rng = random.Random(3)
    texts = [t.encode() for t in TEXTS] + [bytes(rng.choices(b"abcd ", k=rng.randrange(400))) for _ in range(60)] + [rng.randbytes(3000)]
    got = {}
    for level, which, begin, names in fp.names(texts):
        for w, a, b in zip(which.tolist(), begin.tolist(), [*begin[1:].tolist(), len(names)]):
            got.setdefault(w, []).append(names[a:b].tolist())
            assert len(got[w]) == level
    assert [got.get(i, []) for i in range(len(texts))] == [plain_names(t) for t in texts]
    assert fp.fingerprint(texts).tolist() == [plain_slots(t) for t in texts]
    assert fp.fingerprint([]).shape == (0, 64) and all((fp.fingerprint([t])[0] == fp.fingerprint(texts)[i]).all() for i, t in enumerate(texts[:12]))


def test_equal_substrings_share_names_inside_whatever_their_offset():
    rng = random.Random(5)
    common = rng.randbytes(4000)
    a, b = plain_names(rng.randbytes(777) + common + rng.randbytes(50)), plain_names(rng.randbytes(31) + common)
    for level, least in ((0, 0.97), (1, 0.95), (2, 0.9), (3, 0.75)):
        expected = len(plain_names(common)[level])
        assert len(set(a[level]) & set(b[level])) >= least * len(set(plain_names(common)[level])) and expected


def expected_rows(rows):
    """The whole operator, row by row."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for (i, t), (_, n) in zip(rows, [*rows[1:], *rows[:1]]):
        k = len(t) // 3
        e = t[: len(t) - k] + n[:k]
        mine, theirs, after = (plain_slots(x.encode()) for x in (t, e, n))
        out.append((i, len(t), sha256(e.encode()).hexdigest(), *("".join(f"{x:04x}" for x in s) for s in (mine, theirs)), np.mean(np.equal(mine, theirs)), np.mean(np.equal(mine, after))))
    return out


def key(r):
    return [(x is not None, x) for x in r]


@pytest.mark.parametrize("partitions", [1, 7])
def test_edit_likeness_equals_a_plain_one(spark, partitions):
    rng = random.Random(11)
    rows = [(i * 3, "".join(rng.choices("abcde ,é𝔘", k=rng.choice([0, 1, 2, 3, 50, 300])))) for i in range(90)]
    rows += [(5, "only one of this id"), (None, None)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = fp.edit_likeness(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(partitions)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got), key=key) == sorted(expected_rows(rows), key=key)


def test_odd_tables(spark, odd, empty, docs, corpus):
    assert fp.edit_likeness(empty).collect() == []
    one = fp.edit_likeness(spark.createDataFrame([(4, "abcdefghi")], "doc_id int, text string")).collect()
    assert [tuple(one[0])[i] for i in (0, 1, 2)] == [4, 9, sha256(b"abcdefabc").hexdigest()]
    assert fp.edit_likeness(odd).count() == odd.count()
    same = spark.createDataFrame([(1, "one text of all rows")] * 500, "doc_id bigint, text string").repartition(6)
    assert {tuple(r) for r in fp.edit_likeness(same).collect()} == set(expected_rows([(1, "one text of all rows")]))
    got = fp.fingerprints(odd)
    assert got.columns == [*odd.columns, "fingerprint"] and got.count() == odd.count()
    assert fp.fingerprints(empty).count() == 0
    rows = {r.doc_id: r for r in fp.edit_likeness(docs).collect()}
    assert len(rows) == len(corpus)
    by_text = {}
    for i, t, *_ in corpus:
        by_text.setdefault(t or "", set()).add(rows[i].fingerprint)
        assert rows[i].n_chars == len(t or "") and 0 <= rows[i].near_edited <= 1
    assert all(len(v) == 1 for v in by_text.values())


def test_likeness_column(spark):
    texts = [(1, "alpha beta gamma delta " * 9), (2, "alpha beta gamma delta " * 8 + "other end here"), (3, "")]
    got = fp.fingerprints(spark.createDataFrame(texts, "doc_id bigint, text string")).alias("x")
    pairs = got.join(got.alias("y"), F.lit(True)).select(F.col("x.text").alias("a"), F.col("y.text").alias("b"), fp.likeness(F.col("x.fingerprint"), F.col("y.fingerprint")).alias("l"))
    for r in pairs.collect():
        assert r.l == np.mean(np.equal(plain_slots(r.a.encode()), plain_slots(r.b.encode())))
