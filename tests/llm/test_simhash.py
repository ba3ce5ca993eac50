import numpy as np
import pytest
import xxhash

from strataline.llm import simhash


def brute(text, k=4):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in sh) for b in range(64)]
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(sh))


def components(ids, fps, radius=4):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    lab = ids.copy()
    while True:
        new = np.array([lab[m].min() for m in near])
        if (new == lab).all():
            return lab
        lab = new


def test_against_brute_force(docs, corpus):
    got = simhash.near_duplicates(docs).toPandas().sort_values("doc_id")
    fps = np.array([brute(r[1]) for r in corpus], np.uint64)
    assert list(got.fp.to_numpy().view(np.uint64)) == list(fps)
    assert list(got.component_id) == list(components(np.arange(len(corpus)), fps))


@pytest.mark.parametrize("tile", [7, 64, 65536])
def test_links_keep_every_component(spark, tile):
    from strataline.llm.common import Scratch, components as connected

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(6)]
    fps = np.unique(np.array(near, np.uint64))
    scratch = Scratch(spark, "t")
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    comp = {r.node: r.root for r in connected(spark, scratch.table(simhash.links(df, 4, scratch, tile)), scratch).collect()}
    lab = components(np.arange(len(fps)), fps)
    signed = fps.view(np.int64)
    groups = {}
    for x, k in zip(signed.tolist(), lab.tolist()):
        groups.setdefault(k, set()).add(comp.get(x, x))
    assert all(len(v) == 1 for v in groups.values())
    assert len({min(v) for v in groups.values()}) == len(groups)


def test_odd_rows_and_empty(odd, empty):
    got = simhash.near_duplicates(odd)
    assert got.count() == 5
    assert {r.component_id for r in got.where("doc_id = 3 AND fp <> 0").collect()} >= {3}
    assert simhash.near_duplicates(empty).count() == 0
