import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary):03d}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Copies, near copies, shared passages, a hot text, repeated words, empty and null texts, a very long one."""
    rng = random.Random(7)
    texts = [" ".join(words(rng, rng.choice([3, 12, 60, 150]))) for _ in range(40)]
    passage = " ".join(words(rng, 45))
    lines = ["alpha beta gamma", "delta epsilon", "zeta eta theta iota", "kappa"]
    texts += [texts[5]] * 6 + [texts[6] + " x", passage, f"{texts[7]} {passage} tail", f"{passage} {passage}"]
    texts += ["\n".join(lines), "new first\n" + "\n".join(lines) + "\nlast", "a\na\na\na\na", "\n".join(lines[1:]), "", " \t\n", None, None]
    texts += [" ".join(words(rng, 20_000, 50_000)), "same " * 80, "Straße ÉCOLE   İx 𝔘nicode ok", "ONE TWO three"]
    return [(i, t, ("en", "fr", None)[i % 3], f"src{0 if i % 3 else i % 5}", len(t) if t is not None else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids, repeated rows, and columns whose names the operators use."""
    rows = [(None, "one two three four five", 1), (None, None, 2), (3, "one two three four five", 3), (3, "one two three four five", 3), (3, "other words here", 4)]
    return spark.createDataFrame([(*r, "x", "y", "z", 0, "en", "s") for r in rows], "doc_id bigint, text string, n_words int, tk string, fp string, spans string, score int, lang string, source string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
