import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.llm import linear, quality, toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        w = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(5, 80))]
        bad, rude = rng.random() < 0.2, rng.random() < 0.15
        if bad:
            w = [x for x in w[:12] for _ in range(5)] if i % 2 else [y for x in w for y in (x, "|")]
        if rude:
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "Grumfta.", "grumfelix", "loser!"]))
        rows.append((i, " ".join(w), "other", 1))
        labels.append((i, int(not bad), int(rude)))
    rows += [(600, None, "x", 1), (601, "", "x", 1), (None, "plain words", "x", 1), (5, rows[5][1], "x", 1)]
    labels += [(None, 1, 0), (700, 1, 1), (601, None, None), (0, labels[0][1], labels[0][2])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, y string, score int"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_held_out_accuracy(labelled, name):
    docs, labels = labelled
    held = F.col("doc_id") % 3 == 1
    scores = quality.quality_scores if name == "quality" else toxicity.toxicity_scores
    got = scores(docs, labels, name, ~held)
    assert got.count() == docs.count() and not got.where("score IS NULL OR score < 0 OR score > 1").count()
    out = got.where(held & (F.col("doc_id") < 600)).join(labels.where(f"{name} IS NOT NULL").dropDuplicates(["doc_id"]), "doc_id").toPandas()
    y, p = out[name].to_numpy(), (out.score >= 0.5).astype(int).to_numpy()
    assert (y == p).mean() > 0.95 and (p[y == 0] == 0).mean() > 0.85 and (p[y == 1] == 1).mean() > 0.85


def test_nothing_to_learn_and_empty(labelled, empty):
    docs, labels = labelled
    assert quality.quality_scores(docs, labels.limit(0)).where("abs(score - 0.5) < 1e-6").count() == docs.count()
    assert toxicity.toxicity_scores(docs, labels.limit(0)).where("score <= 0.5").count() == docs.count()
    assert quality.quality_scores(empty, labels).count() == 0 and toxicity.toxicity_scores(empty, labels).count() == 0


def test_columns_are_kept(labelled):
    docs, labels = labelled
    assert set(docs.columns) == set(quality.quality_scores(docs, labels).columns)


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(50, 6, replace=False)) for _ in range(300)]
    y = np.array([1.0 if 3 in r or 7 in r else -1.0 for r in rows])
    w = linear.dual_descent(rows, [np.ones(6)] * 300, y, np.full(300, 5.0), 50, epochs=60)
    margin = np.array([w[r].sum() + w[-1] for r in rows])
    assert (np.sign(margin) == y).mean() > 0.97
    a, b = linear.platt(margin, y, np.ones(300))
    assert a > 0 and (((a * margin + b) > 0) == (y > 0)).mean() > 0.95


def test_indicators_cover_whole_texts():
    long = " ".join(f"a{i}" for i in range(quality.CHUNK + 10))
    assert len(quality.indicators(long)) > len(quality.indicators(long[: len(long) // 2]))
    assert len(quality.indicators(None)) and list(quality.indicators("")) == list(quality.indicators(None))


def test_label_model_discounts_correlated_voters():
    one, copies = 0b1, 0b111
    start = np.zeros((2, toxicity.VOTERS))
    start[:, :3] = [[9.0] * 3, [1.0] * 3]
    post = toxicity.label_model({0: 900, one: 30, copies: 70}, start)
    assert post[0] < 0.05 < 0.5 < post[one] <= post[copies] < 1
