import random

import pytest
from pyspark.sql import functions as F

from strataline.llm import lines
from strataline.llm.common import Scratch


def brute(rows, k, words=50):
    """By all windows: n_lines, lines that go, text."""
    seen, split = {}, {i: t.split("\n") if t is not None else [] for i, t in rows}
    for i, x in sorted(split.items()):
        for p in range(len(x)):
            for m in range(1, k + 1):
                if p + m <= len(x) and (m == k or sum(len(y.split()) for y in x[p : p + m]) > words):
                    seen.setdefault(tuple(x[p : p + m]), []).append((i, p, m))
    late, first = {}, {}
    for places in seen.values():
        for at, (i, p, m) in enumerate(places):
            if len(places) > 1:
                (late if at else first).setdefault(i, set()).update(range(p, p + m))
    out = {}
    for i, t in rows:
        gone = late.get(i, set()) - first.get(i, set())
        out[i] = (len(split[i]), len(gone), t if t is None else "\n".join(y for j, y in enumerate(split[i]) if j not in gone))
    return out


def result(docs, *args):
    return {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.dedup_lines(docs, *args).collect()}


@pytest.mark.parametrize("k", [1, 3, 4])
def test_against_brute_force(docs, corpus, k):
    assert result(docs, k) == brute([(r[0], r[1]) for r in corpus], k)


@pytest.mark.parametrize("seed", [0, 1])
def test_runs_that_overlap(spark, seed):
    """Few different lines, so that runs overlap themselves and each other; whole copies, and long runs of few lines."""
    rng = random.Random(seed)
    long = [" ".join(f"{c}{i}" for i in range(30)) for c in "xy"]
    texts = ["\n".join(rng.choice(["a", "b", "", *long]) for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    texts += [texts[3], texts[3], "a\na\na\na\na", "\n".join(long), "\n".join(long), "q\n" + "\n".join(long) + "\nr", long[0], long[0] * 2, long[0] * 2]
    rows = list(enumerate(texts))
    assert result(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)) == brute(rows, 3)


@pytest.mark.parametrize("few", [lines.FEW, 100, 0])
def test_suffix_array_and_common_prefixes(spark, monkeypatch, few):
    monkeypatch.setattr(lines, "FEW", few)
    rng = random.Random(3)
    texts = ["\n".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))) for _ in range(12)]
    scratch = Scratch(spark, "t")
    table = scratch.table(lines.line_table(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)))
    got = [(r["rank"], r.tx, r["at"], r.lcp, r.starts) for r in lines.intervals(lines.suffix_array(table, scratch), 4, scratch).orderBy("rank").collect()]
    by_tx = {r.tx: r.text.split("\n") for r in spark.createDataFrame([(t,) for t in texts], "text string").select(F.xxhash64("text").alias("tx"), "text").collect()}
    assert len({g[0] for g in got}) == len(got) == sum(len(t.split("\n")) for t in set(texts))
    rest = [by_tx[tx][at:] for _, tx, at, _, _ in got]

    def common(x, y):
        return next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))

    assert [g[3] for g in got[1:]] == [common(x, y) for x, y in zip(rest, rest[1:])]
    for m in range(1, 5):  # suffixes of an interval share m lines, and no others do
        groups = {}
        for g, x in zip(got, rest):
            groups.setdefault(g[4][m - 1], set()).add(tuple(x[:m]) if len(x) >= m else g[:3])
        assert all(len(v) == 1 for v in groups.values()) and len(groups) == len(set().union(*groups.values()))


def test_a_thousand_equal_rows(spark):
    text = "\n".join(f"line {i % 7}" for i in range(20))
    docs = spark.createDataFrame([(1, text)] * 1000 + [(2, text)] * 5, "doc_id bigint, text string")
    got = {(r.doc_id, r.n_removed, r.text) for r in lines.dedup_lines(docs).collect()}
    want = brute([(1, text), (2, text)], 3)
    assert got == {(1, *want[1][1:]), (2, 20, "")}


def test_odd_rows_and_empty(odd, empty):
    got = lines.dedup_lines(odd, 1).collect()
    assert len(got) == 5 and set(odd.columns) <= set(got[0].asDict())
    assert sorted(r.n_removed for r in got) == [0, 0, 0, 1, 1]  # the null id comes first; equal rows are one document
    assert lines.dedup_lines(empty).count() == 0


def test_a_text_of_very_many_lines(spark):
    texts = ["\n".join(f"line {i * k % 50_021}" for i in range(50_000)) for k in (1, 7)] + ["a\n" * 50_000]
    table = lines.line_table(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    got = {r["tx"]: r for r in table.groupBy("tx").agg(F.count("*").alias("n"), F.max("at").alias("last"), F.count("need").alias("need"), F.sum("need").alias("sum")).collect()}
    assert sorted((r["n"], r["last"], r["need"], r["sum"]) for r in got.values()) == [(50_000, 49_999, 49_998, 149_994)] * 2 + [(50_001, 50_000, 49_999, 149_997)]


def test_how_many_lines_a_run_needs(spark):
    text = "\n".join(["w " * 30, "w " * 21, "", "w " * 51, "x", "y", "z"])
    got = lines.line_table(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "w " * 51)], "doc_id bigint, text string")).collect()
    by = {}
    for r in got:
        by.setdefault(r["tx"], {})[r["at"]] = r["need"]
    assert sorted(([d[i] for i in range(len(d))] for d in by.values()), key=len) == [[None], [1], [2, 3, 2, 1, 3, None, None]]
