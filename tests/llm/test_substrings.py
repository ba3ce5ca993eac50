import random
from collections import Counter

import pytest

from strataline.llm import substrings


def brute(rows, w=35):
    split = [(t or "").encode().split() for t in rows]
    seen = Counter(tuple(x[p : p + w]) for x in split for p in range(len(x) - w + 1))
    out = []
    for x in split:
        gone = {q for p in range(len(x) - w + 1) if seen[tuple(x[p : p + w])] > 1 for q in range(p, p + w)}
        out.append((len(x), len(gone), b" ".join(y for i, y in enumerate(x) if i not in gone).decode()))
    return out


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = substrings.remove_repeats(df).orderBy("doc_id").collect()
    removed = [sum(s["end"] - s["start"] for s in r.spans or ()) for r in got]
    assert [(r.n_words, n, r.kept) for r, n in zip(got, removed)] == brute(texts)


def test_against_brute_force(spark, corpus):
    check(spark, [r[1] for r in corpus])


@pytest.mark.parametrize("seed", range(3))
def test_overlapping_passages(spark, seed):
    rng = random.Random(seed)
    pool = [f"t{rng.randrange(9)}" for _ in range(400)]
    texts = []
    for _ in range(60):
        a = rng.randrange(350)
        piece = pool[a : a + rng.randrange(20, 90)]
        if rng.random() < 0.5:
            piece[rng.randrange(len(piece))] = f"u{rng.randrange(99)}"
        texts.append(" ".join([*[f"v{rng.randrange(9999)}" for _ in range(rng.randrange(5))], *piece]))
    check(spark, [*texts, "b " * 34, "b " * 35, "c " * 36, "A b", "a b"])


def test_full_filter_changes_nothing(spark, corpus, monkeypatch):
    monkeypatch.setattr(substrings, "FILTER_BITS", 1024)
    check(spark, [r[1] for r in corpus])


def test_odd_rows_and_empty(odd, empty):
    assert substrings.remove_repeats(odd).count() == 5
    assert substrings.remove_repeats(empty).count() == 0
