import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from strataline.llm import common, mixing


def test_rake_meets_targets():
    rng = np.random.default_rng(2)
    cells = np.array([(a, b, c) for a in range(4) for b in range(3) for c in range(2)])
    tokens = rng.integers(1, 10_000, len(cells)).astype(float)
    targets = [np.array(t) for t in ([0.4, 0.3, 0.2, 0.1], [0.5, 0.25, 0.25], [0.3, 0.7])]
    w = mixing.rake(cells, tokens, targets)
    for d, t in enumerate(targets):
        assert np.allclose(np.bincount(cells[:, d], tokens * w) / tokens.sum(), t, atol=1e-6)
    p = mixing.probabilities(w, tokens, 0.4)
    assert p.max() <= 1 and np.isclose((p * tokens).sum(), 0.4 * tokens.sum())


def test_rows_and_shares(spark):
    """Every cell of source, language and topic has rows here, so that the targets can all be met."""
    tops = ["alpha", "bravos", "charlie"]
    rows = [(i, " ".join([tops[i % 3]] * (3 + i % 5)), ("en", "fr", None)[i // 3 % 3], f"src{i // 9 % 2}") for i in range(720)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = mixing.mix(docs, {"lang": {"en": 0.5, "fr": 0.3, "(null)": 0.2}}, keep=0.3)
    assert got.count() == len(rows) and set(docs.columns) <= set(got.columns)
    share = {r.lang: r.e for r in got.groupBy("lang").agg((F.sum(F.col("mix_tokens") * F.col("mix_weight"))).alias("e")).collect()}
    total = sum(share.values())
    assert np.allclose([share["en"] / total, share["fr"] / total, share[None] / total], [0.5, 0.3, 0.2], atol=1e-6)
    assert not got.where("mix_probability IS NULL OR mix_kept IS NULL").count()
    kept = got.where("mix_kept").agg(F.sum("mix_tokens")).first()[0] / got.agg(F.sum("mix_tokens")).first()[0]
    assert abs(kept - 0.3) < 0.06


def test_topics_follow_the_words(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"word{i % 5}x{k}" for k in rng.integers(0, 40, 30)), "en", "s") for i in range(400)] + [(400, None, "en", "s"), (401, "a b", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r.mix_topic for r in mixing.mix(docs).collect()}
    again = {r.doc_id: r.mix_topic for r in mixing.mix(docs.repartition(7)).collect()}
    assert got == again and got[400] == got[401] == "-"
    of = {}
    for i in range(400):
        of.setdefault(got[i], set()).add(i % 5)
    assert all(len(v) == 1 for v in of.values())


def brute(rows, keep):
    """Weights and probabilities of cells by plain loops, from rows of (source, lang, topic, tokens)."""
    cells = {}
    for *k, n in rows:
        cells[tuple(k)] = cells.get(tuple(k), 0) + n
    total, w, goals = sum(cells.values()), {k: 1.0 for k in cells}, []
    for d, power in enumerate((0.5, 0.7, 0.0)):
        share = {}
        for k, n in cells.items():
            share[k[d]] = share.get(k[d], 0) + n / total
        fixed = share.get("-", 0.0)
        up = {v: x**power for v, x in share.items() if v != "-" and x > 0}
        goals.append({v: (fixed if v == "-" else up.get(v, 0.0) * (1 - fixed) / sum(up.values())) for v in share})

    def sums(p, d):
        out = {}
        for k, n in cells.items():
            out[k[d]] = out.get(k[d], 0.0) + n * p[k]
        return out

    for _ in range(3000):
        for d in range(3):
            now = sums(w, d)
            w = {k: x * (goals[d][k[d]] * total / now[k[d]] if now[k[d]] else 1) for k, x in w.items()}
    return cells, w, goals, sums


def test_result_against_plain_loops(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"t{rng.integers(3)}word{k}" for k in rng.integers(0, 20, 40)), ("en", "fr", None)[int(rng.integers(3))], f"src{int(rng.integers(4)) ** 2}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = mixing.mix(docs, keep=0.3).collect()
    key = lambda r: (r.source, r.lang or "(null)", r.mix_topic)
    cells, w, goals, sums = brute([(*key(r), r.mix_tokens) for r in got], 0.3)
    total, p = sum(cells.values()), {}
    for r in got:
        assert abs(r.mix_weight - w[key(r)]) < 1e-5 * max(1, w[key(r)])
        p[key(r)] = r.mix_probability
    for d in range(3):
        now = sums(p, d)
        assert all(abs(now[v] - 0.3 * total * goals[d][v]) < 0.002 * total for v in now if 0.3 * total * goals[d][v] < sums({k: 1 for k in cells}, d)[v])
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
    far = {r.doc_id: r for r in mixing.mix(docs, keep=0.3).collect()}
    for r in got:
        assert abs(r.mix_weight - far[r.doc_id].mix_weight) < 1e-4 * max(1, r.mix_weight)
        assert abs(r.mix_probability - far[r.doc_id].mix_probability) < 5e-3


def test_every_source_has_its_own_marginal(spark):
    rows = [(i, "alpha bravo charlie", "en", f"src{i % 600}") for i in range(3000) if i % 600 < 300 or i < 600]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    share = {r.source: r.e for r in mixing.mix(docs).groupBy("source").agg(F.sum(F.col("mix_tokens") * F.col("mix_weight")).alias("e")).collect()}
    assert len(share) == 600 and np.isclose(share["src0"] / share["src599"], 5**0.5)


def test_a_cut_off_probability_leaves_the_shares_right():
    cells, tokens = np.array([(0, 0), (0, 1), (1, 0), (1, 1)]), np.array([100.0, 900.0, 900.0, 8000.0])
    w = mixing.rake(cells, tokens, [np.array([0.3, 0.7]), np.array([0.3, 0.7])])
    p = mixing.probabilities(w, tokens, 0.33, cells)
    assert p.max() <= 1 and (w * 0.33 > 1).any()
    for d in range(2):
        assert np.allclose(np.bincount(cells[:, d], tokens * p), mixing.filled(np.array([0.3, 0.7]) * 9900, np.bincount(cells[:, d], tokens), 0.33 * 9900), rtol=1e-6)
    assert np.allclose(mixing.filled(np.array([1.0, 1.0, 2.0]), np.array([1.0, 9.0, 9.0]), 10.0), [1, 3, 6])


def test_sample_is_the_same_whatever_the_partitions(docs):
    a, b = ({r.doc_id for r in mixing.mix(d).where("mix_kept").collect()} for d in (docs, docs.repartition(2)))
    assert a == b


def test_odd_rows_and_empty(odd, empty):
    assert mixing.mix(odd).count() == 5
    assert mixing.mix(empty).count() == 0
    clash = odd.selectExpr("*", "1 AS mix_kept", "'k' AS __source", "2 AS mix_source_key")
    got = mixing.mix(clash)
    assert got.count() == 5 and got.columns.count("mix_kept") == 1 and {r["__source"] for r in got.collect()} == {"k"}


def test_without_text_the_result_is_the_same(docs):
    a, b = ({tuple(r) for r in mixing.mix(docs, with_text=w).select("doc_id", "lang", "source", "mix_tokens", "mix_topic", "mix_weight", "mix_probability", "mix_kept").collect()} for w in (True, False))
    assert a == b


def test_topics_of_many_texts_need_little_memory():
    rng = np.random.default_rng(2)
    row = np.repeat(np.arange(5000), 200)
    dim, value, means = rng.integers(0, mixing.DIM, len(row)), rng.integers(0, 5, len(row)), rng.integers(0, 100, (mixing.TOPICS, mixing.DIM))
    tracemalloc.start()
    got = mixing.assign(5001, row, dim, value, means)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80 << 20 and got[5000] == -1
    for i in (0, 1, 2499, 4999):
        assert got[i] == (means[:, dim[row == i]] * value[row == i]).sum(1).argmax()


def test_sums_of_topics_come_to_the_driver_in_one_row(spark, docs, monkeypatch):
    kind, rows = type(docs), []
    collect = kind.collect

    def seen(self):
        got = collect(self)
        rows.extend([len(got)] * (self.columns == ["n", "sum"]))
        return got

    monkeypatch.setattr(kind, "collect", seen)
    scratch = common.Scratch(spark, "test")
    (weight, means), _ = mixing.topic_model(docs.repartition(40), scratch)
    assert rows == [1] * (1 + mixing.ROUNDS)
    (w, m), _ = mixing.topic_model(docs.coalesce(1), scratch)
    assert means.any() and np.array_equal(weight, w) and np.array_equal(means, m)
    n, total = mixing._summed(spark.createDataFrame([], "n bigint, sum binary"), 3)
    assert n == 0 and not total.any() and len(total) == 3
