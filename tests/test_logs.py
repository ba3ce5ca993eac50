import json

import pytest
from pyspark.sql import functions as F

from strataline.operators import extract, transcripts
from strataline.sources import logs, records
from strataline.streaming import streams


def write(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return str(path)


def decode(spark, tmp_path, rows, fmt, **how):
    return transcripts.decode(logs.lines(spark, write(tmp_path / "x.jsonl", rows)), fmt, **how).orderBy("line").collect()


def test_codex(spark, tmp_path):
    say = lambda role, text, **k: {"type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": "input_text", "text": text}], **k}}
    rows = [
        say("user", "too early"), {"type": "session_meta", "payload": {"id": "s", "cli_version": "1"}}, say("user", "hello"), say("assistant", "hi"), say("system", "no"), {"type": "event_msg"},
        {"type": "response_item", "payload": {"type": "reasoning"}}, {"type": "odd"}, {"type": "compacted"}, "{broken", say("user", "key AKIA" + "B" * 16), {"type": "session_meta", "payload": {"id": "t", "cli_version": "1"}}, say("user", "later"),
        say("assistant", "hidden", channel="analysis"),
    ]
    got = decode(spark, tmp_path, rows, "codex")
    assert [(r.line, r.text) for r in got if r.text] == [(3, "hello"), (4, "hi"), (13, "later")]
    assert {r.line: r.gap for r in got if r.gap} == {1: "missing_or_unknown_header", 8: "unknown_event_schema", 9: "compaction_originals_not_proven", 10: "malformed_event", 11: "sensitive_content_excluded", 12: "inherited_session_metadata"}
    assert [r.delegated for r in got if r.text] == [False, False, True] and {r.session for r in got if r.text} == {"s"}


def test_claude_and_pi(spark, tmp_path):
    say = lambda u, p, text, **k: {"type": "user", "uuid": u, "parentUuid": p, "sessionId": "s", "version": "1", "message": {"role": "user", "content": text}, **k}
    got = decode(spark, tmp_path, [say("a", None, "one"), {"type": "attachment"}, say("b", "a", "two", isSidechain=True), say("c", "b", "x", version="9"), say("d", "c", "y", sessionId="t"), {"type": "system", "subtype": "compact_boundary"}], "claude", versions=("1",))
    assert [(r.event_id, r.parent, r.delegated) for r in got if r.text] == [("a", None, False), ("b", "a", True)]
    assert [r.gap for r in got if r.gap] == ["unknown_native_version", "mixed_session_identity", "compaction_originals_not_proven"]
    pi = [{"type": "session", "version": 3, "id": "s"}, {"type": "message", "id": "m", "parentId": None, "message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "thinking", "text": "no"}, {"type": "text", "text": "b"}]}}, {"type": "message", "id": "n", "message": {"role": "assistant", "content": "cut", "stopReason": "aborted"}}, {"type": "label"}]
    got = decode(spark, tmp_path, pi, "pi")
    assert [r.text for r in got if r.text] == ["a\nb"] and [r.gap for r in got if r.gap] == ["unfinished_output"]


def test_dedupe_conflicts_and_leaf(spark):
    e = spark.createDataFrame([("s", "a", 1, "x"), ("s", "a", 2, "x"), ("s", "b", 3, "y"), ("s", "b", 4, "z")], "session string, event_id string, line int, raw_digest string")
    first, conflicts = transcripts.dedupe(e, ["session", "event_id"], ["line"], "raw_digest")
    assert sorted(r.line for r in first.collect()) == [1, 3] and [r.event_id for r in conflicts.collect()] == ["b"]
    assert transcripts.newest_leaf(e, "session", "event_id", ["line"]).first()["leaf"] == "b"


def test_windows_resume(spark):
    rows = [("c", i, "user", "x" * n) for i, n in enumerate([10, 30, 5, 200, 1, 0, 40])]
    df = spark.createDataFrame(rows, "c string, turn int, role string, text string")
    got = [tuple(r) for r in extract.greedy_windows(df, "c", "turn", 64).orderBy("window").collect()]
    out, used, w = [], 0, 1
    for _, i, role, text in rows:
        if text:
            s = min(64, len(f"[L{i}] {role}: {text}\n"))
            w, used = (w + 1, s) if used and used + s > 64 else (w, used + s)
            out.append((w, i, s))
    want = [("c", k, min(i for x, i, _ in out if x == k), max(i for x, i, _ in out if x == k), sum(x == k for x, *_ in out), sum(s for x, _, s in out if x == k)) for k in range(1, w + 1)]
    assert got == want
    short = [tuple(r) for r in extract.greedy_windows(df.where("turn < 4"), "c", "turn", 64).orderBy("window").collect()]
    assert short[:-1] == got[: len(short) - 1]


def test_worker_filter(spark):
    rows = [("mistake", "c", "w", "Real lesson", "body"), ("mistake", "", "w", "No cause", "b"), ("praise", "c", "w", "Other", "b"), ("correction", "c", "w", "The worker was asked to x", "b"), ("correction", "c", "w", "t", "Successfully completed y")]
    df = spark.createDataFrame(rows, "category string, cause string, conditions string, title string, body string")
    assert [r.body for r in extract.worker_filter(df).collect()] == ["body\nLikely cause: c"]


def test_log_source_batch_and_tail(spark, tmp_path):
    logs.register(spark)
    path = tmp_path / "a.jsonl"
    path.write_bytes(b"".join(b'{"n":%d}\n' % i for i in range(100)) + b'{"part')
    batch = spark.read.format("strataline_log").option("path", str(tmp_path / "*.jsonl")).option("spanBytes", "100").load()
    rows = batch.orderBy("byte_start").collect()
    assert [json.loads(r.raw)["n"] for r in rows] == list(range(100)) and batch.rdd.getNumPartitions() > 5
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = spark.readStream.format("strataline_log").option("path", str(tmp_path / "*.jsonl")).load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.raw for r in spark.read.parquet(out).collect() if r.raw)

    assert len(run()) == 100
    with path.open("ab") as f:
        f.write(b'":1}\n{"n":101}\n')
    got = run()  # a new run of the same checkpoint: the suffix only
    assert len(got) == 102 and '{"part":1}' in got


def test_a_stream_is_read_in_spans_and_replays_a_change(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    lines = [b'{"n":%d,"x":"%s"}\n' % (i, b"y" * (i % 50)) for i in range(300)]
    path.write_bytes(b"".join(lines) + b"partial")
    reader = logs._Stream({"path": str(tmp_path / "*.jsonl"), "spanBytes": "97"})

    def rows(a, b):
        return sorted(r for span in reader.partitions(a, b) for r in reader.read(span))

    zero, one = reader.initialOffset(), reader.latestOffset()
    first = rows(zero, one)
    assert len(reader.partitions(zero, one)) > 50 and [r[3].encode() + b"\n" for r in first] == lines and rows(one, one) == []
    with path.open("ab") as f:
        f.write(b" ends\nlast\n")
    two = reader.latestOffset()
    assert [r[3] for r in rows(one, two)] == ["partial ends", "last"] and rows(one, two) == rows(one, two)
    (tmp_path / "b.jsonl").write_bytes(b"")
    assert [r[3] for r in rows(one, reader.latestOffset())] == ["partial ends", "last"]
    path.write_bytes(b"new start\n" + b"".join(lines))  # as long, but not the same
    for fresh in (reader, logs._Stream({"path": str(tmp_path / "*.jsonl")})):  # a reader of a restarted query knows nothing else
        three = fresh.latestOffset()
        got = rows(two, three)
        assert [r[4] for r in got if r[4]] == ["source_changed"] and sum(r[3] is not None for r in got) == 301 and got == rows(two, three)
    path.write_bytes(b"short\n")
    assert [(r[3], r[4]) for r in rows(three, reader.latestOffset())] == [(None, "source_changed"), ("short", None)]


def test_numbered_lines_and_chunks(spark, tmp_path):
    logs.register(spark)
    for n in range(3):
        (tmp_path / f"{n}.jsonl").write_bytes(b"".join(b"%d:%d\n" % (n, i) for i in range(1, 200)))
    got = logs.numbered(spark.read.format("strataline_log").option("path", str(tmp_path / "*.jsonl")).option("spanBytes", "100").load())
    assert all(r.raw.split(":")[1] == str(r.line) for r in got.collect()) and got.count() == 597
    before = spark.createDataFrame(logs.chunk_digests(spark, str(tmp_path / "*.jsonl"), 256).collect())
    assert logs.changed_chunks(before, logs.chunk_digests(spark, str(tmp_path / "*.jsonl"), 256)).count() == 0
    data = (tmp_path / "0.jsonl").read_bytes()
    (tmp_path / "0.jsonl").write_bytes(data[:300] + b"#" + data[301:] + b"more\n")
    (tmp_path / "1.jsonl").write_bytes(data[:100])
    (tmp_path / "2.jsonl").unlink()
    got = {(r.path[-7], r.byte_start // 256, r.reason) for r in logs.changed_chunks(before, logs.chunk_digests(spark, str(tmp_path / "*.jsonl"), 256)).collect()}
    last = len(data) // 256
    assert {x for x in got if x[0] == "0"} == {("0", 1, "altered"), ("0", last, "grown")}
    assert {x for x in got if x[0] == "1"} == {("1", 0, "cut"), *(("1", k, "lost") for k in range(1, last + 1))} and {r for _, _, r in (x for x in got if x[0] == "2")} == {"lost"}


def test_state_machines(spark, tmp_path):
    def run(rows, schema, fn, name):
        src = tmp_path / name
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src))
        q = fn(spark.readStream.schema(schema).parquet(str(src))).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    got = run([("k", "a"), ("k", "a"), ("k", "b"), ("j", "c")], "k string, digest string", lambda s: streams.outcomes(s, "k"), "outcomes")
    assert sorted((r.key, r.outcome) for r in got) == [("j", "accepted"), ("k", "accepted"), ("k", "conflict"), ("k", "replay")]
    ops = [("p", "claim", "a", 0), ("p", "claim", "b", 10), ("p", "done", "b", 20), ("p", "claim", "b", 3700), ("p", "done", "a", 3800), ("p", "fail", "b", 3900), ("p", "claim", "a", 4000), ("p", "claim", "a", 9000)]
    got = run(ops, "path string, op string, owner string, at bigint", streams.leases, "leases")
    assert [r.applied for r in got] == [True, False, False, True, False, True, False, True] and got[-1].generation == 3


def test_record_files(spark, tmp_path):
    head = {"id": "a" * 32, "project_id": "p", "scope": "project", "kind": "result", "title": "t", "status": "candidate", "sources": [], "supersedes": []}
    (tmp_path / "good.md").write_text(f"---json\n{json.dumps(head)}\n---\nbody\nmore")
    row = records.read_records(spark, str(tmp_path)).first()
    assert (row.id, row.title, row.body, row.errors) == ("a" * 32, "t", "body\nmore", [])
    (tmp_path / "bad.md").write_text('---json\n{"id":"x","id":"y"}\n---\nbody')
    (tmp_path / "kind.md").write_text(f"---json\n{json.dumps(head | {'kind': 'rumour', 'status': 'active'})}\n---\n")
    got = {r.path.rsplit("/", 1)[1]: r.errors for r in records.read_records(spark, str(tmp_path), strict=False).collect()}
    assert "header" in got["bad.md"] and got["kind.md"] == ["kind", "active"]
    with pytest.raises(Exception, match="invalid record"):
        records.read_records(spark, str(tmp_path)).count()


def test_extraction_model_is_the_callers(spark):
    df = spark.createDataFrame([("s", 1, "text")], "session string, window bigint, text string")
    assert extract.run_model(df, lambda t: t.upper()).first()["output"] == "TEXT"


def test_listing(spark, tmp_path):
    for n in "abc":
        (tmp_path / f"{n}.txt").write_text(n)
    first = logs.listing(spark, str(tmp_path), limit=2).collect()
    assert [r.path[-5:] for r in logs.listing(spark, str(tmp_path), after=first[-1].path).collect()] == ["c.txt"]
    assert {(r.text, r.role) for r in logs.documents(spark, str(tmp_path)).collect()} == {("a", "owner"), ("b", "owner"), ("c", "owner")}
    assert logs.namespace(spark, str(tmp_path)).select(F.countDistinct("digest")).first()[0] == 3


def test_header_looks_at_first_lines_only(spark, tmp_path):
    path = write(tmp_path / "h.jsonl", [{"x": 1}, {"cwd": "/a", "s": "1"}, {"cwd": "/b"}, *[{"x": 1}] * 70, {"late": "no"}])
    row = logs.header(logs.lines(spark, path), {"cwd": "$.cwd", "session": "$.s", "late": "$.late"}).first()
    assert (row.cwd, row.session, row.late) == ("/a", "1", None)


def test_oversized_lines_are_drained(tmp_path):
    path = tmp_path / "big.jsonl"
    path.write_bytes(b"short\n" + b"x" * 3_000_000 + b"\n" + b"y" * 10 + b"\nlast without an end" + b"z" * 50)
    got = list(logs.frames(str(path), 0, path.stat().st_size, most=20))
    assert [(a, b, raw, gap) for _, a, b, raw, gap in got] == [(0, 6, "short", None), (6, 3_000_007, None, "oversized_event"), (3_000_007, 3_000_018, "y" * 10, None)]
