import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F
from strataline.operators import effects, evidence, scan, snapshots, views


def test_folders_are_rolled_up_and_changes_are_found(spark):
    files = {f"{a}/{b}/{c}": f"{a}{b}{c}" for a in "xyz" for b in "pq" for c in range(4)} | {"top": "1", "deep/1/2/3/4": "d"}
    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, digest string").repartition(3)
    before = snapshots.folder_digests(frame(files))
    assert {r.path: r.n for r in before.where("kind = 'folder'").collect()} == {"": 26, "x": 8, "y": 8, "z": 8, "deep": 1, "deep/1": 1, "deep/1/2": 1, "deep/1/2/3": 1} | {f"{a}/{b}": 4 for a in "xyz" for b in "pq"}
    assert snapshots.snapshot_state(before, snapshots.folder_digests(frame(dict(reversed(files.items()))))).count() == 0
    now = files | {"x/p/0": "other", "y/q/9": "new", "z/p/1": None}
    del now["deep/1/2/3/4"]
    got = {(r.path, r.kind, r.state, r.deepest) for r in snapshots.snapshot_state(before, snapshots.folder_digests(frame(now))).collect()}
    assert {x for x in got if x[3]} == {("x/p/0", "file", "stale", True), ("y/q/9", "file", "added", True), ("z/p/1", "file", "unverifiable", True), ("deep/1/2/3/4", "file", "removed", True)}
    assert {(p, s) for p, k, s, _ in got if k == "folder"} == {("", "unverifiable"), ("x", "stale"), ("x/p", "stale"), ("y", "stale"), ("y/q", "stale"), ("z", "unverifiable"), ("z/p", "unverifiable"), *((p, "removed") for p in ("deep", "deep/1", "deep/1/2", "deep/1/2/3"))}
    swapped = files | {"x/p/0": files["x/p/1"], "x/p/1": files["x/p/0"]}  # names count, not the digests alone
    assert ("x/p", "folder", "stale", False) in {tuple(r) for r in snapshots.snapshot_state(before, snapshots.folder_digests(frame(swapped))).collect()}
    assert snapshots.folder_digests(frame(files).where("false")).count() == 0


@pytest.mark.parametrize("most", [1, 60, 100_000])
def test_shards_round_trip_and_verify(spark, most):
    rng = random.Random(most)
    items = [(k, i * 3, "é" * rng.randrange(30)) for k in ("a", "b", None) for i in range(70)] + [("one", 1, ""), ("twin", 1, "same"), ("twin2", 1, "same")]
    manifest, stored = snapshots.shards(spark.createDataFrame(items, "k string, o bigint, t string").repartition(4), "k", "o", "t", most)
    want = sorted(((k, i + 1, t) for key in {x[0] for x in items} for i, (k, _, t) in enumerate(x for x in items if x[0] == key)), key=str)
    assert sorted(map(tuple, snapshots.reassembled(manifest, stored, "k").collect()), key=str) == want
    assert snapshots.shard_errors(manifest, stored, "k").count() == 0 and stored.count() == stored.select("digest").distinct().count()
    assert all(len(r.body.encode()) <= most + 60 and sha256(r.body.encode()).hexdigest() == r.digest for r in stored.collect())
    same = sha256(b"same").hexdigest()
    broken = stored.withColumn("body", F.when(F.col("digest") == same, "other").otherwise(F.col("body"))).unionByName(stored.where(F.col("digest") == sha256(b"").hexdigest())).unionByName(spark.createDataFrame([("f" * 64, "x")], "digest string, body string"))
    got = {(r.k, r.reason) for r in snapshots.shard_errors(manifest, broken, "k").collect()}
    assert {("twin", "altered"), ("twin2", "altered"), ("one", "repeated")} <= got and (None, "stray") in got
    assert {r.k for r in snapshots.reassembled(manifest, broken, "k").collect()} == {"a", "b", None, "one"}
    assert {r.k for r in snapshots.shard_errors(manifest, stored.where(F.col("digest") != same), "k").where("reason = 'lost'").collect()} == {"twin", "twin2"}


def test_effects_end_once_wherever_they_break_off(spark):
    writes = {"e1": [("p1", None, "n1"), ("p2", "o2", "n2"), ("p3", "o3", "n3")], "e2": [("q1", "o", "n")]}
    intents = spark.createDataFrame([(e, *w) for e, ws in writes.items() for w in ws], "effect string, path string, before string, after string")

    def state(current, receipts=()):
        got = effects.effect_states(intents, spark.createDataFrame(list(current.items()), "path string, digest string"), spark.createDataFrame([(r,) for r in receipts], "effect string"))
        return {r.effect: (r.state, r.to_write, r.blocked_by) for r in got.collect()}

    start = {"p2": "o2", "p3": "o3", "q1": "o"}
    assert state(start) == {"e1": ("intended", 3, None), "e2": ("intended", 1, None)}
    done = dict(start)
    for i, (path, _, after) in enumerate(writes["e1"]):  # killed after each write
        done[path] = after
        assert state(done)["e1"] == (("partial", 2 - i, None) if i < 2 else ("written", 0, None))
    assert state(done, ["e1", "e1"])["e1"] == ("received", 0, None)
    assert state(done | {"p2": "someone's"}, ["e1"])["e1"] == ("received", 0, None)  # a later change is not the effect's
    assert state(start | {"p3": "someone's"})["e1"] == ("blocked", 2, "p3") and state({"q1": "o"})["e1"] == ("blocked", 1, "p2")


def test_layers(spark):
    rng = random.Random(3)
    edges = [(i, rng.randrange(i)) for i in range(1, 60) for _ in range(2)] + [(100, 101), (101, 100), (102, 100), (103, 999), (104, 103)]
    nodes = [*range(60), *range(100, 105)]
    got = {r.id: r.layer for r in effects.layers(spark.createDataFrame([(i,) for i in nodes], "id int"), spark.createDataFrame(edges, "src int, dst int")).collect()}
    want = {}
    for i in range(60):
        want[i] = 1 + max((want[d] for s, d in edges if s == i), default=-1)
    assert got == want | dict.fromkeys(range(100, 105))
    assert effects.layers(spark.createDataFrame([], "id int"), spark.createDataFrame([], "src int, dst int")).count() == 0


def test_admission_stops_at_the_first_budget_that_is_used_up(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["g", "g", "h"]), i, rng.randrange(6), rng.randrange(30)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, o int, source int, size int").repartition(3)
    got = {r.o: r.reason for r in scan.admitted(df, ["g"], ["o"], {"bytes": (F.col("size"), 400), "events": (F.lit(1), 25)}, F.col("source"), 4).collect()}
    for g in "gh":
        size, n, seen, reason = 0, 0, set(), None
        for _, o, source, s in sorted(r for r in rows if r[0] == g):
            size, n, seen = size + s, n + 1, seen | {source}
            assert got[o] == ("bytes" if size > 400 else "events" if n > 25 else "sources" if len(seen) > 4 else None)


def test_references_are_resolved_with_reasons(spark):
    events = spark.createDataFrame([("e1", "public-message", True, False), ("e2", "derivative", True, False), ("e3", "owner", None, False), ("e4", "owner", True, True)], "key string, evidence string, branch_verified boolean, forbidden boolean")
    shape = "id string, effective_status string, usable boolean, level string"
    records = spark.createDataFrame([("a", "active", True, None), ("b", "active", True, "report"), ("c", "stale", True, None), ("d", "active", False, None), ("l1", "active", True, None), ("l2", "active", True, None), ("l3", "active", True, None)], shape)
    claims = spark.createDataFrame([("a", "active", True, "hypothesis")], shape)
    rests = spark.createDataFrame([("record:a", "e1"), ("record:b", "collaboration:a"), ("collaboration:a", "e2"), ("record:l1", "record:l2"), ("record:l2", "record:l1"), ("record:l3", "record:l1")], "src string, dst string")
    refs = ["e1", "e2", "e3", "e4", "record:a", "record:b", "record:c", "record:d", "record:l1", "record:l3", "collaboration:a", "record:zz", "page:1", "a", None]
    got = evidence.resolve_references(spark.createDataFrame([("o", r) for r in refs] + [("p", "e1"), ("p", "record:a")], "owner string, ref string"), events, records, claims, rests)
    want = dict(zip(refs, [None, "derivative_only", "unverified_branch", "source_forbidden", None, "derivative_only", "dependency_inactive", "source_forbidden", "cyclic_reference", "cyclic_reference", "derivative_only", *["unverifiable_source"] * 4]))
    assert {r.ref: r.reason for r in got.where("owner = 'o'").collect()} == want
    counts = {r.owner: r for r in evidence.evidence_counts(got).collect()}
    assert (counts["p"].n_refs, counts["p"].n_missing_refs, counts["p"].n_prohibited, counts["p"].evidence_type) == (2, 0, 0, None)
    assert (counts["o"].n_missing_refs, counts["o"].n_prohibited, counts["o"].evidence_type) == (11, 2, "hypothesis")
    said = F.struct(F.lit(None).cast("string").alias("x"))
    rows = evidence.evidence_counts(got).withColumns({"projects": F.array(F.lit("p")), "scenarios": F.array().cast("array<string>"), "known_scenarios": F.array().cast("array<string>"), "statement_type": F.lit("conclusion"), "level": F.lit("inferred"), "evidence_level": F.lit("explicit"), "attested": F.lit(True), "s": said})
    assert {r.owner: r.e for r in rows.select("owner", views.admission_error("p").alias("e")).collect()} == {"p": None, "o": "unresolved_reference"}
