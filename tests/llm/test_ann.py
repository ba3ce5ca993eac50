import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def exact(rows, q, k):
    v = dict(rows)
    s = sorted(((-float(np.dot(v[q], x)), i) for i, x in rows if i != q))[:k]
    return [i for _, i in s]


@pytest.mark.parametrize("block", [40, 4096])
def test_recall_order_and_ties(spark, block):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 24)).astype(np.float32)
    x[100:350] = x[99]  # a third of all rows are one vector
    rows = [(i, x[i].astype(float)) for i in range(700)]
    df = spark.createDataFrame([(i, [float(y) for y in v], 0) for i, v in rows], SCHEMA).repartition(5)
    got = ann.neighbours(df, F.col("vec_id") % 20 == 0, block=block, k=10).toPandas()
    hits = total = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11)) and q not in set(g.vec_id)
        assert np.allclose(g.score, [np.dot(rows[q][1], rows[i][1]) for i in g.vec_id], atol=1e-12)
        assert sorted(zip(-g.score, g.vec_id)) == list(zip(-g.score, g.vec_id))
        want = exact(rows, q, 10)
        hits, total = hits + len(set(want) & set(g.vec_id)), total + 10
    assert got.query_id.nunique() == 35 and hits / total >= 0.9
    twin = got[got.query_id == 120].sort_values("rank")
    assert list(twin.vec_id) == list(range(99, 109))


def hard_rows(kind, rng):
    """Rows whose nearest ones an index fitted on a sample misses."""
    x = rng.normal(size=(1500, 16))
    if kind == "near copies":  # one dense heap, whose codes are all alike
        x[200:] = x[0] + rng.normal(size=(1300, 16)) * 1e-3
    elif kind == "norms":  # a few large vectors, and none of them in the sample
        x *= np.exp(2 * rng.normal(size=(1500, 1)))
    return x


@pytest.mark.parametrize("kind", ["plain", "near copies", "norms"])
def test_no_neighbour_is_lost(spark, kind):
    rows = list(enumerate(hard_rows(kind, np.random.default_rng(3)).astype(np.float32).astype(float)))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in rows], SCHEMA).repartition(3)
    got = ann.neighbours(df, F.col("vec_id") % 20 == 0, k=10, fit_rows=200, lists=12, probes=2).orderBy("query_id", "rank").toPandas()
    hits = sum(len(set(exact(rows, q, 10)) & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert hits == len(got) == 750


def test_repeated_ids_are_rows_of_their_own(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (0, [2.0, 0.0], 1), (1, [3.0, 0.0], 1), (1, [3.0, 0.0], 1), (2, [0.5, 1.0], 1)], SCHEMA)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.neighbours(df, F.col("vec_id") == 0).collect())
    one = [(0, 1, 1, 3.0), (0, 2, 1, 3.0), (0, 3, 0, 2.0), (0, 4, 2, 0.5)]
    two = [(0, 1, 1, 6.0), (0, 2, 1, 6.0), (0, 3, 0, 2.0), (0, 4, 2, 1.0)]
    assert got == sorted(one + two)


def test_unusable_vectors_and_few_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0], 1), (1, [2.0, 1.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [1.0, inf], 1), (6, [1.0, None], 1), (None, [1.0, 1.0], 1), (7, [1.0, 2.0, 3.0], 1), (0, [1.0, 2.0], 1), (8, [], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.neighbours(df, F.lit(True)).orderBy("query_id").collect()]
    # the two rows of id 0 are a query each, and candidates of each other
    assert sorted(got) == [(0, 1, 0, 5.0)] * 2 + [(0, 2, 1, 4.0)] * 2 + [(1, 1, 0, 4.0), (1, 2, 0, 4.0)]
    assert ann.neighbours(df.limit(0), F.lit(True)).count() == 0
    assert ann.neighbours(df, F.lit(False)).count() == 0
