import math
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataline.llm import lm


@pytest.mark.parametrize("head", [1 << 17, 8])
def test_base_is_exact_and_model_better(spark, docs, corpus, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    got = {r.doc_id: r for r in lm.lm_scores(docs, F.col("doc_id") % 10 != 0).collect()}
    words = {r[0]: (r[1] or "").encode().lower().split() + [lm.END] for r in corpus}
    c = Counter(w for i, ws in words.items() if i % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in words.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in c for w in ws), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert sum(r.score for i, r in got.items() if i % 10) > sum(r.base_score for i, r in got.items() if i % 10)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    w, bias = rng.normal(size=(lm.KINDS, lm.LEAST_ROWS, lm.CLASSES)).astype(np.float32), np.zeros(lm.CLASSES, np.float32)
    rows = np.zeros((lm.KINDS, lm.CLASSES), np.uint16)
    assert math.isclose((10 ** lm.class_logs(w, bias, rows, np.arange(lm.CLASSES))).sum(), 1, rel_tol=1e-5)


def test_context_starts_anew_with_each_text():
    codes = lm.Codes({lm.END: 0}, {})
    one, starts, _ = lm.tokens([b"a b", b"a b"], codes)
    rows = lm.contexts(one, starts)
    assert (rows[:, :3] == rows[:, 3:]).all()


def test_few_codes_are_remembered():
    codes, most = lm.Codes({lm.END: 0}, {b"w7": 3}), 0
    for i in range(250_000):
        codes[b"w%d" % i]
        most = max(most, len(codes))
    assert most <= 100_000 and codes[b"w7"] == lm.Codes({lm.END: 0}, {b"w7": 3})[b"w7"]


def test_codes_of_the_head_are_made_ahead_and_others_not_kept():
    own, head = {lm.END: 0, b"the": 1}, {b"the": 0, b"house": 1}
    codes = lm.Codes(own, head)
    assert len(codes) == 3
    for w in (lm.END, b"the", b"house", b"mouse", "gr\u00fcn".encode(), b"x"):
        crc, k = zlib.crc32(w), lm.word_class(w, own)
        assert codes[w] == k << 52 | (head.get(w, -1) + 1) << 32 | crc
    assert len(codes) == 3


@pytest.mark.parametrize("n", [1, 15, 16, 17, 700, 5000])
def test_rows_of_equal_context_are_summed_whole(n):
    """Small whole numbers, so the sums are exact; one context holds half of all tokens and runs over many blocks."""
    rng = np.random.default_rng(n)
    e, r = rng.integers(-9, 9, (n, 5)).astype(np.float32), rng.integers(0, 40, n).astype(np.uint16)
    r[rng.random(n) < 0.5] = 7
    want, got = np.zeros((40, 5)), np.zeros((40, 5))
    np.add.at(want, r, e)
    to, sums, rest, more = lm.row_sums(e, r)
    assert len(set(to.tolist())) == len(to) and len(rest) <= n // lm.BLOCK
    np.add.at(got, to, sums)
    np.add.at(got, rest, more)
    assert (want == got).all()


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    w, bias = rng.normal(size=(lm.KINDS, lm.LEAST_ROWS, lm.CLASSES)).astype(np.float32), rng.normal(size=lm.CLASSES).astype(np.float32)
    x, y = rng.integers(0, 50, (lm.KINDS, 300)).astype(np.uint16), rng.integers(0, lm.CLASSES, 300)
    got = np.zeros_like(w)
    lm.gradient(w, bias, x, y, got)
    for k, r, c in ((0, 3, 5), (1, 7, int(y[0])), (2, int(x[2, 0]), int(y[0]))):
        up, down = w.copy(), w.copy()
        up[k, r, c] += 0.05
        down[k, r, c] -= 0.05
        slope = -np.log(10) * (lm.class_logs(up, bias, x, y).sum() - lm.class_logs(down, bias, x, y).sum()) / 0.1
        assert math.isclose(slope, got[k, r, c], rel_tol=2e-2, abs_tol=1e-2)
    assert (lm.CLASSES, lm.OWN) >= (64, 24)


def test_scores_are_the_same_whatever_the_partitions_and_gain(spark):
    """Texts in which the next word follows from the last one: held-out texts gain, by the same scores for 1, 4 and 16 partitions."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        at, w = int(rng.integers(200)), []
        for _ in range(60):
            at = (at * 7 + 1) % 200 if rng.random() < 0.8 else int(rng.integers(200))
            w.append(f"w{at}")
        rows.append((i, " ".join(w)))
    docs, got = spark.createDataFrame(rows, "doc_id bigint, text string"), []
    for n in (1, 4, 16):
        got.append({r.doc_id: r for r in lm.lm_scores(docs.repartition(n), F.col("doc_id") % 10 != 0).collect()})
    for i in range(400):
        assert max(abs(got[0][i].score - g[i].score) for g in got) < 1e-4 * abs(got[0][i].score)
    held = [r for i, r in got[0].items() if i % 10 == 0]
    assert sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held) > 0.25


def test_rows_grow_with_the_vocabulary():
    assert lm.rows_for(0) == lm.rows_for(1000) == lm.LEAST_ROWS and lm.rows_for(400_000) == 8192 and lm.rows_for(10**8) == 1 << 17
    code, starts, _ = lm.tokens([b"a b c"], lm.Codes({lm.END: 0}, {}))
    assert lm.contexts(code, starts, 1 << 17).dtype == np.uint32


def test_encoded_texts_take_few_bytes_a_token(spark, monkeypatch):
    """Whole intermediate rows, ids and words outside the head included; hashed rows of three kinds took 7 bytes a token alone."""
    rng, sizes, table = np.random.default_rng(3), {}, lm.Scratch.table

    def sized(self, df, name="t", **options):
        out = table(self, df, name, **options)
        sizes[name] = sum(f.stat().st_size for f in Path(out._scratch_path.removeprefix("file://")).glob("*.parquet"))
        return out

    monkeypatch.setattr(lm.Scratch, "table", sized)
    monkeypatch.setattr(lm, "HEAD", 3000)
    rows = [(i, " ".join(f"w{w}" for w in rng.zipf(1.3, 1000) % 5000)) for i in range(200)]
    assert lm.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), F.lit(True)).count() == 200
    assert sizes["codes"] < 4 * 200 * 1001


@pytest.mark.parametrize("head", [[], [lm.END], [lm.END, b"the", b"house", *(b"h%d" % i for i in range(70_000))]])
def test_stored_tokens_come_back(head):
    own, head = {lm.END: 0, b"the": 1}, {w: i for i, w in enumerate(head)}
    codes = lm.Codes(own, head)
    known = np.array([0, *(codes[w] for w in head)], np.int64)
    code, starts, _ = lm.tokens([b"the mouse h7 h69999", b"", None, "gr\u00fcn house the the".encode(), b"mouse"], codes)
    places, rare = lm.stored(code, starts)
    part = pa.RecordBatch.from_arrays([pa.array(places, pa.binary()), pa.array(rare, pa.binary())], ["places", "rare"])
    for rows in (lm.LEAST_ROWS, 1 << 17):
        x, y, at = lm.unpacked(part, known, rows)
        assert (x == lm.contexts(code, starts, rows)).all() and (y == code >> 52).all() and (at == starts).all()


def test_packed_sums_are_exact_and_no_wider_than_their_largest():
    rng, n = np.random.default_rng(4), lm.PER * lm.CLASSES
    for most, width in ((0, 1), (127, 1), (128, 2), (1 << 22, 3), ((1 << 63) - 1, 8)):
        v = rng.integers(-most, most, n, endpoint=True)
        v[:2] = most, -most
        assert (lm.whole(lm.packed(v)) == v).all() and len(lm.packed(v)) == n * width
    v = np.full(n, -(1 << 63), np.int64)
    assert (lm.whole(lm.packed(v)) == v).all()


def test_odd_rows_and_empty(odd, empty):
    assert lm.lm_scores(odd, F.lit(True)).count() == 5
    got = lm.lm_scores(odd, F.lit(False)).collect()
    assert len(got) == 5 and all(r.n_known == 0 and r.train_tokens == 0 for r in got)
    assert lm.lm_scores(empty, F.lit(True)).count() == 0
