import random
from collections import Counter

import corpus_pipeline
import pytest

from strataline.llm import nearcopies


def brute(texts):
    sets = []
    for w in ((t or "").lower().split() for t in texts):
        n = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {}
        sets.append({(s, k) for s in n for k in range(n[s])})
    lab = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if lab[i] != lab[j] and (x == y or 5 * len(x & y) >= 4 * len(x | y) > 0):
                old, new = max(lab[i], lab[j]), min(lab[i], lab[j])
                lab = [new if k == old else k for k in lab]
    return lab


def planted():
    """Originals, near copies of similarity 0.7 to 1, chains of them, and a passage that many texts share."""
    rng, texts = random.Random(5), []
    passage = " ".join(f"p{k}" for k in range(30))
    for n in (4, 8, 25, 60, 200, 900):
        for k in range(6):
            w = [f"w{rng.randrange(3000)}" for _ in range(n)]
            texts.append(" ".join(w))
            for share in (0.005, 0.01, 0.02, 0.03):
                w = [f"x{rng.randrange(3000)}" if rng.random() < share else x for x in w] if k % 2 else w[: len(w) - int(n * share * 4)]
                texts.append(" ".join(w))
            if k == 0:
                texts += [passage + " " + " ".join(w), " ".join(w) + " " + passage]
    return texts + ["a b c d e f g h i j " * 9, "a b c d e f g h i j " * 10, "a b c d e f g h i j " * 20, "", None, " "]


@pytest.mark.parametrize("tile", [20, nearcopies.TILE])
def test_groups_are_those_of_brute_force(spark, monkeypatch, tile):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    lab = brute(texts)
    monkeypatch.setattr(nearcopies.tile_pairs, "__defaults__", (nearcopies.LEAST, tile))
    got = {}
    for r in nearcopies.near_copies(docs).collect():
        got.setdefault(r.group, set()).add(r.doc_id)
    assert {min(v): v for v in got.values()} == {k: {i for i, x in enumerate(lab) if x == k} for k in set(lab)}


def test_a_large_group_around_a_hub(spark):
    """Copies that are each similar to one text, but hardly to each other."""
    rng = random.Random(9)
    hub = [f"h{k}" for k in range(400)]
    texts = [" ".join(hub)]
    for i in range(300):
        w = list(hub)
        for at in rng.sample(range(400), 8):
            w[at] = f"z{i}x{at}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.group for r in nearcopies.near_copies(docs).collect()}
    lab, groups = brute(texts), {}
    for i, k in enumerate(lab):
        groups.setdefault(k, set()).add(got[i])
    assert len(groups) == len(set(got.values())) and all(len(v) == 1 for v in groups.values())


def test_pipeline_stage_joins_near_copies(spark):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(brute(texts))


def test_one_document_of_each_group_whatever_the_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (1, d + " x"), (2, c + " y"), (2, a + " z"), (3, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, (r.text or "-")[0]) for r in got) == [(0, "b"), (1, "c"), (1, "d"), (2, "a"), (3, "-")]


def test_texts_are_fetched_once_for_sets_and_travel_once_at_the_end(spark, monkeypatch):
    made, table = [], nearcopies.Scratch.table
    monkeypatch.setattr(nearcopies.Scratch, "table", lambda self, df, name="t": made.append(name) or table(self, df, name))
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = corpus_pipeline.near_dedup(spark, docs, "")
        assert {r.doc_id for r in got.collect()} == set(brute(texts))
        plan = got._jdf.queryExecution().optimizedPlan().toString() + got._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert made.count("sets") == 1
    # The one shuffle that holds whole rows is that of min_by; no join is made on rows before it.
    at = [line.strip() for line in plan.splitlines() if "min_by" in line or "Join" in line]
    assert at and "LeftSemi" in at[0]
