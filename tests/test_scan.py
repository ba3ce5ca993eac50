import random

import pytest
from pyspark.sql import functions as F
from strataline.operators import extract, graph, scan


def test_running_sums_and_maxima_across_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["a", None]), rng.randrange(-50, 500), rng.randrange(100)) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    for chunk, inclusive in ((1, True), (16, True), (16, False), (1 << 20, False)):
        got = scan.running(df, ["k"], ["o", "v"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, chunk, inclusive).collect()
        for k in {r[0] for r in rows}:
            seen = []
            for (o, v), r in zip(sorted((o, v) for kk, o, v in rows if kk == k), sorted((r for r in got if r.k == k), key=lambda r: (r.o, r.v, r.s))):
                before = [*seen, v] if inclusive else seen
                assert (r.o, r.v, r.s, r.m) == (o, v, sum(before), max(before, default=None))
                seen.append(v)


def union(reads):
    out = []
    for s, e in sorted(r for r in reads if r[1] > r[0]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def test_ranges_and_marks(spark):
    rng = random.Random(2)
    reads = [(rng.choice("aab"), s := rng.randrange(300), s + rng.randrange(-2, 9)) for _ in range(150)]
    marks = [(rng.choice("abc"), s := rng.randrange(300), s + rng.randrange(0, 6), i) for i in range(200)]
    r, m = spark.createDataFrame(reads, "k string, start bigint, end bigint"), spark.createDataFrame(marks, "k string, start bigint, end bigint, n int")
    want = {k: union([(s, e) for kk, s, e in reads if kk == k]) for k in "abc"}
    for chunk in (8, 1 << 24):
        ranges = scan.covered_ranges(r, ["k"], chunk)
        assert sorted(map(tuple, ranges.collect())) == sorted((k, *x) for k, v in want.items() for x in v)
        bad = sorted(x.n for x in scan.uncovered_marks(m, ranges, ["k"], chunk).collect())
        assert bad == [n for k, s, e, n in marks if e > s and not any(a <= s and e <= b for a, b in want[k])]
    none = r.where("false")
    assert scan.covered_ranges(none, ["k"]).count() == 0 and scan.uncovered_marks(m, none, ["k"]).count() == sum(e > s for _, s, e, _ in marks)


def test_repeated_reads_in_any_order(spark, monkeypatch):
    real = scan.running

    def other_order(rows, *args, **more):  # rows that tie may come in any order
        return real(rows.orderBy(*[F.desc_nulls_last(c) for c in rows.columns]).coalesce(1), *args, **more)

    monkeypatch.setattr(scan, "running", other_order)
    reads = [("a", s, s + n) for s in range(0, 90, 10) for n in (4, 4, 4, 6)] + [("b", 0, 3), ("b", 5, 9), ("b", 5, 9), ("b", 9, 12)]
    got = scan.covered_ranges(spark.createDataFrame(reads, "k string, start bigint, end bigint"), ["k"])
    assert sorted(map(tuple, got.collect())) == [("a", s, s + 6) for s in range(0, 90, 10)] + [("b", 0, 3), ("b", 5, 12)]


def test_progress_and_marks(spark):
    reads = spark.createDataFrame([("x", "d1", 0, 5), ("x", "d1", 5, 9), ("y", "d1", 0, 4), ("y", "d1", 6, 9), ("z", "old", 0, 9)], "key string, digest string, start bigint, end bigint")
    totals = spark.createDataFrame([("x", "d1", 9), ("y", "d1", 9), ("z", "d2", 9), ("e", "d", 0)], "key string, digest string, total bigint")
    assert {(r.key, r.reached, r.complete) for r in scan.read_progress(reads, ["key", "digest"], totals).collect()} == {("x", 9, True), ("y", 4, False), ("z", 0, False), ("e", 0, True)}
    marks = spark.createDataFrame([("e1", "processed"), ("e2", "processed"), ("e2", "pending-review"), ("e3", "seen"), ("zz", "excluded"), ("m", "no-signal"), (None, "processed")], "key string, status string")
    frozen = spark.createDataFrame([("e1", None), ("e2", None), ("e3", None), ("m", "r1")], "key string, revision string")
    served = spark.createDataFrame([("e1",), ("e1",), ("m",)], "key string")
    got = scan.mark_errors(marks, frozen, served, spark.createDataFrame([("m", "r2")], "key string, revision string"))
    assert {tuple(r) for r in got.collect()} == {("e2", "processed", "unserved_event"), ("e3", "seen", "unknown_status"), ("zz", "excluded", "unknown_key"), ("m", "no-signal", "stale_dependency"), (None, "processed", "unknown_key")}


def windows(sizes, most):
    out, used = [], most + 1
    for o, s in sizes:
        if used + s > most:
            out.append([o, o, 0, 0])
            used = 0
        used += s
        out[-1][1:] = [o, out[-1][2] + 1, out[-1][3] + s]
    return [(i + 1, *x) for i, x in enumerate(out)]


@pytest.mark.parametrize("sessions", [12, 1])
def test_greedy_windows_equal_a_loop(spark, sessions):
    rng = random.Random(sessions)
    rows = [(f"s{i}", n, "user", "x" * rng.choice([0, 1, 5, 40, 300])) for i in range(sessions) for n in range(1, rng.choice([2, 40, 150]))]
    got = extract.greedy_windows(spark.createDataFrame(rows, "session string, line bigint, role string, text string"), "session", "line", 120)
    want = []
    for s in {r[0] for r in rows}:
        sizes = [(n, min(120, len(f"[L{n}] user: {t}\n"))) for k, n, _, t in rows if k == s and t]
        want += [(s, *w) for w in windows(sizes, 120)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_path_folds_and_branches(spark):
    rng = random.Random(4)
    parent = {i: (None if i < 3 else rng.randrange(i)) for i in range(120)} | {500: 501, 501: 500, 600: 999, 601: 600}
    rows = [(i, p, i % 7, i % 11 != 5) for i, p in parent.items()]
    paths, jumps = graph.path_folds(spark.createDataFrame(rows, "id int, parent int, v int, ok boolean"), {"low": ("min", "v"), "total": ("sum", "v"), "ok": ("and", "ok")})

    def path(i):
        out = []
        while i is not None and i in parent and i not in out:
            out.append(i)
            i = parent[i]
        return out, i

    for r in paths.collect():
        way, end = path(r.id)
        if end is None:
            assert (r.root, r.status, r.depth, r.low, r.total, r.ok) == (way[-1], "complete", len(way) - 1, min(x % 7 for x in way), sum(x % 7 for x in way), all(x % 11 != 5 for x in way))
        else:
            assert (r.root, r.status, r.low) == (None, "cycle" if end in way else "broken", None)
    leaves = spark.createDataFrame([(77,), (119,), (0,)], "id int")
    assert {tuple(r) for r in graph.on_paths(leaves, jumps).collect()} == {(x, y) for x in (77, 119, 0) for y in path(x)[0]}
    assert {(r.parent, r.n) for r in graph.forks(spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2)], "id int, parent int")).collect()} == {(1, 2)}


def test_a_branch_is_whole_or_nothing(spark):
    chain = lambda s, *ids, bad=(): [(s, i, p, i not in bad) for p, i in zip([None, *ids], ids)]
    events = chain("whole", "a", "b", "c") + [("whole", "side", "a", True)] + chain("unknown", "a", "b", "c", bad=("b",)) + [("lost", "b", "gone", True)] + chain("fork", "a", "b") + [("fork", "b", None, True)]
    events += [("round", "a", "b", True), ("round", "b", "a", True)] + chain("twice", "a", "b") + [("twice", "b", "a", True)] + chain("none", "a") + chain("null", "a", bad=("a",)) + chain("fresh", "a", "b")
    leaves = [("whole", "c", "explicit"), ("unknown", "c", "explicit"), ("lost", "b", "saved-resume"), ("fork", "b", "explicit"), ("round", "a", "explicit"), ("twice", "b", "explicit"), ("none", None, "saved-resume"), ("null", "a", "default-leaf"), ("fresh", "b", "default-leaf")]
    selected, gaps = graph.branches(spark.createDataFrame(events, "session string, event_id string, parent string, recognized boolean"), spark.createDataFrame(leaves, "session string, leaf string, how string"))
    assert {(r.session, r.event_id, r["at"], r.assurance) for r in selected.collect()} == {("whole", "a", 0, None), ("whole", "b", 1, None), ("whole", "c", 2, None), ("twice", "a", 0, None), ("twice", "b", 1, None), ("fresh", "a", 0, "default-leaf"), ("fresh", "b", 1, "default-leaf")}
    missing = "branch_ancestry_not_in_window"
    assert {tuple(r) for r in gaps.collect()} == {("unknown", missing), ("lost", missing), ("fork", missing), ("round", missing), ("none", "saved_branch_unverified"), ("null", "active_branch_unverified")}


def test_reachable_with_and_without_a_shared_folder(spark, monkeypatch):
    edges, roots = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")], "src string, dst string"), spark.createDataFrame([("a",)], "id string")
    assert spark.conf.get("spark.checkpoint.dir", None)
    assert sorted(r.id for r in graph.reachable(spark, edges, roots).collect()) == ["a", "b", "c"]
    monkeypatch.setattr(graph, "kept", lambda df: df.cache())  # what is done where none is set
    assert sorted(r.id for r in graph.reachable(spark, edges, roots).collect()) == ["a", "b", "c"]


def test_cooldown_equals_a_loop(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", None]), rng.randrange(2000), i) for i in range(300)]
    got = extract.cooled(spark.createDataFrame(rows, "store string, at bigint, n int").repartition(3), "store", "at", "n", 77).collect()
    assert len(got) == len(rows)
    for store in ("a", None):
        last, have = None, {r.n: r for r in got if r.store == store}
        for at, n in sorted((t, n) for s, t, n in rows if s == store):
            start = last is None or at >= last + 77
            last = at if start else last
            assert (have[n].spawned, have[n].next_after) == (start, None if start else last + 77 - at)


def test_answers_in_prose(spark):
    outs = [
        '{"candidates": [1]}', '{"result": "Sure: {\\"candidates\\": [{\\"a\\": {}}]} done", "usage": {"input_tokens": 5, "output_tokens": 2}, "total_cost_usd": 0.5}', "no json at all", "",
        'log line\n{"type":"item.completed","item":{"type":"agent_message","text":"{\\"n\\":1}"}}\n{"type":"item.completed","item":{"type":"agent_message","text":"then {\\"n\\":2}"}}\n{"type":"turn.completed","usage":{"input_tokens":7}}',
        '{"result": "two {\\"a\\":1} and {\\"b\\":2}"}', '{"is_error": true, "result": "{}"}', '{"type": "turn.failed"}', '[1, 2]', '{"item": {"type": "reasoning", "text": "{\\"x\\":1}"}}', None,
    ]
    outs.append('{"result": "{\\"r\\":1}"}\n{"result": "none"}\n{"usage": {"output_tokens": 3}}')
    got = extract.model_answers(spark.createDataFrame([("s", i, o) for i, o in enumerate(outs)], "session string, window bigint, output string")).orderBy("window").collect()
    assert [r.answer for r in got] == ['{"candidates":[1]}', '{"candidates":[{"a":{}}]}', None, None, '{"n":2}', None, "{}", None, None, None, None, '{"r":1}']
    assert (got[1].input_tokens, got[1].output_tokens, got[1].cost, got[4].input_tokens) == (5, 2, 0.5, 7)
    assert [i for i, r in enumerate(got) if r.failed] == [6, 7]
