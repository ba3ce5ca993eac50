import numpy as np
import pyarrow as pa
import pytest

from strataline.llm import common, secrets


def test_slices_hold_few_rows_and_few_bytes(monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 100)
    texts = ["a" * 10, "b" * 20, "c" * 300, "d" * 5, None, "e" * 99, "f" * 2, "", "g" * 60, "h" * 60]
    got = list(common.sliced([pa.record_batch([pa.array(texts), pa.array(range(10))], ["text", "n"])], 4))
    assert [x for b in got for x in b.column("n").to_pylist()] == list(range(10))
    for b in got:
        assert b.num_rows <= 4 and (b.num_rows == 1 or sum(len(t or "") for t in b.column("text").to_pylist()) <= 100)


def test_entropy_spans_under_pattern_spans_are_left_out():
    text = "token=abcdefgh " + " ".join(f"password: Zx9{k}qLm2vTb8Kp4Rw7Yc{k}" for k in range(50)) + " Qz7wErT9yUiOp3AsDfGh5JkLm"
    spans = secrets.scan(text)
    base = [s for s in spans if s[2] != "entropy"]
    assert len(base) == 51
    for a, b, kind in spans:
        assert kind != "entropy" or not any(x <= a and b <= y for x, y, _ in base)
    assert any(k == "entropy" for _, _, k in spans)


def test_a_cluster_without_a_shared_folder_fails_loudly():
    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://x:7077"})

    with pytest.raises(ValueError):
        common.shared_dir(Fake())


@pytest.mark.parametrize("few,held", [(0, 1 << 20), (1 << 17, 1 << 20), (40, 10)])
def test_components_by_rounds_and_by_one_task(spark, monkeypatch, few, held):
    monkeypatch.setattr(common, "HELD_EDGES", held)
    rng = np.random.default_rng(5)
    pairs = [(7, k) for k in range(100, 160)] + [(k, k + 1) for k in range(200, 240)] + [(5, 5), (-3, 900), (900, -3)]
    pairs += [(int(a), int(b)) for a, b in rng.integers(1000, 1120, (70, 2))]
    least = {n: n for p in pairs if p[0] != p[1] for n in p}
    for _ in least:
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    edges = spark.createDataFrame(pairs, "a bigint, b bigint").repartition(5)
    got = common.components(spark, edges, common.Scratch(spark, "test"), few).collect()
    assert sorted((r["node"], r["root"]) for r in got) == sorted((n, r) for n, r in least.items() if n != r)
    assert common.components(spark, edges.limit(0), common.Scratch(spark, "test"), few).count() == 0


def test_slices_hand_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "tidy", lambda: calls.append(1))
    assert [p.num_rows for p in common.sliced(iter([pa.RecordBatch.from_pydict({"text": ["a"] * 300})]))] == [128, 128, 44] and len(calls) == 2
