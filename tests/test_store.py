from datetime import datetime, timedelta, timezone

import pytest

from strataline.plans.store import CALLS, CallError, Store

ME = {"project_id": "p", "worktree_id": "w", "task_id": "t", "session_id": "s1"}
OTHER = ME | {"session_id": "s2"}


class Clock:
    now = datetime(2026, 1, 1, tzinfo=timezone.utc)

    def __call__(self):
        return self.now


@pytest.fixture
def store(spark, tmp_path):
    clock = Clock()
    out = Store(spark, str(tmp_path / "store"), clock)
    out.time = clock
    return out


def add(store, title, body="body text", reviewed=True, **more):
    return store.capture(ME, {"kind": "decision", "title": title, "body": body, **more}, {"reason": "seen"} if reviewed else None)["id"]


def granted(store, tmp_path):
    """A folder that the project may read."""
    (tmp_path / "logs").mkdir(exist_ok=True)
    store.grant("p", "logs", str(tmp_path / "logs"))
    return tmp_path / "logs"


def status(store, rid):
    return store.one(rid)["effective_status"]


def test_lifecycle_precedence(store):
    a, b = add(store, "first"), add(store, "second", reviewed=False)
    assert (status(store, a), status(store, b)) == ("active", "candidate")
    store.supersede(OTHER, b, [a], {"reason": "better"})
    assert (status(store, a), status(store, b)) == ("superseded", "active")
    assert store.one(b)["assurance"] == "cross-session-reviewed" and store.one(a)["assurance"] == "self-reviewed"
    store.withdraw(ME, b, {"reason": "wrong"})
    assert (status(store, a), status(store, b)) == ("superseded", "withdrawn")  # a withdrawn successor revives nothing
    with pytest.raises(CallError, match="not_candidate"):
        store.approve(ME, a, {"reason": "again"})


def test_expiry_stale_and_retired(store):
    task, old, kept = add(store, "task", scope="task"), add(store, "old", reviewed=False), add(store, "kept")
    store.annotate(ME, kept, {"reason": "done"}, retired=True)
    assert status(store, kept) == "retired"
    store.time.now += timedelta(days=7)
    assert (status(store, task), status(store, old)) == ("active", "stale")
    store.time.now += timedelta(days=7)
    assert status(store, task) == "expired"
    store.annotate(ME, kept, {"reason": "back"}, retired=False)
    assert status(store, kept) == "active"


def test_replay_conflict_and_fence(store):
    record = {"kind": "result", "title": "x", "body": "y"}
    first = store.capture(ME, record, idempotency_key="k")
    assert store.capture(ME, record, idempotency_key="k") == first | {"replayed": True}
    with pytest.raises(CallError, match="idempotency_conflict"):
        store.capture(ME, record | {"body": "z"}, idempotency_key="k")
    store.annotate(ME, first["id"], {"reason": "a"}, details={"summary": "one"})
    revision = store.one(first["id"])["revision"]
    store.annotate(ME, first["id"], {"reason": "b"}, details={"domain": "d"}, expected_revision=revision)
    row = store.one(first["id"])
    assert (row["summary"], row["domain"]) == ("one", "d")
    with pytest.raises(CallError, match="stale_revision"):
        store.annotate(ME, first["id"], {"reason": "c"}, details={"domain": "e"}, expected_revision=revision)


def test_search_scope_paging_and_stale_cursor(store):
    ids = {add(store, f"deploy note {i}", "how to deploy the service") for i in range(4)}
    add(store, "other", "nothing here")
    add(store, "draft deploy", reviewed=False)
    page = store.search(ME, "deploy", limit=3)
    assert len(page["items"]) == 3 and page["cursor"]
    rest = store.search(ME, "deploy", limit=3, cursor=page["cursor"])
    assert {r["id"] for r in page["items"] + rest["items"]} == ids and rest["cursor"] is None
    assert store.search(ME | {"project_id": "q"}, "deploy")["items"] == []
    assert store.search(ME, "the of and")["items"] == []  # only stop words: no query
    assert len(store.search(ME, "  ")["items"]) == 5  # no query: all that is active
    add(store, "deploy note 9", "new")
    with pytest.raises(ValueError, match="stale_search"):
        store.search(ME, "deploy", limit=3, cursor=page["cursor"])


def test_dispositions_issues_context_overview(store):
    add(store, "from a log", sources=[{"uri": "file:///tmp/a%20b"}])
    kept = add(store, "kept", "some evidence")
    assert store.dispose(ME, ["file://localhost/tmp/a%20b"])["added"] and not store.dispose(ME, ["file:///tmp/a%20b"])["added"]
    assert [r["id"] for r in store.search(ME, "")["items"]] == [kept]
    got = store.context(ME, "evidence")
    assert got["groups"][0][0]["id"] == kept and store.context(ME, "evidence", previous_revision=got["revision"])["state"] == "unchanged"
    one = store.issue_open(ME, "topic", "contradicts", "first words")
    assert one["changed"] and not store.issue_open(ME, "topic", "contradicts", "first words")["changed"]
    assert [i["issue_id"] for i in store.issue_list(ME, "words")["items"]] == [one["id"]] and store.issue_list(ME, "absent")["items"] == []
    store.issue_close(ME, one["id"], "resolved")
    assert store.issue_list(ME) == {"items": [], "omitted": 0}
    assert store.overview(ME)["active"] == {"decision": 2}


def test_review_run(store, tmp_path):
    log = granted(store, tmp_path) / "log.jsonl"
    log.write_bytes(b'{"a":1}\n{"a":2}\n{"part')
    run = store.dream_start(ME, "o", str(log))
    assert run["events"] == 2
    with pytest.raises(CallError, match="run_open"):
        store.dream_start(ME, "o", str(log))
    with pytest.raises(CallError, match="not_served"):
        store.dream_draft(ME, run["run_id"], [])
    assert [i["raw"] for i in store.dream_materials(ME, run["run_id"])["items"]] == ['{"a":1}', '{"a":2}']
    ops = [{"action": "capture", "record": {"kind": "result", "title": "t", "body": "b"}, "review": {"reason": "r"}}, {"action": "withdraw", "id": "none", "review": {}}]
    for odd in ({"action": "share", "source": "q"}, {"action": "capture"}, {"action": "withdraw", "id": "x", "review": {}, "idempotency_key": "k"}, {"action": "capture", "record": "text"}, "text"):
        assert store.call("dream_draft", ME, {"run_id": run["run_id"], "operations": [odd]})["error"]["code"] == "invalid_operation"
    store.dream_draft(ME, run["run_id"], ops)
    out = store.dream_publish(ME, run["run_id"])["outcomes"]
    assert [o["outcome"] for o in out] == ["applied", "blocked"] and store.dream_publish(ME, run["run_id"])["outcomes"] == out
    assert store.dream_close(ME, run["run_id"])["position"] == 16
    assert store.dream_start(ME, "o", str(log)) == {"state": "no-change"}
    log.write_bytes(b'{"a":1}\n{"a":2}\n{"part":3}\n')
    again = store.dream_start(ME, "o", str(log))
    assert again["events"] == 1  # the appended suffix only
    assert store.dream_takeover(ME, again["run_id"])["generation"] == 2
    log.write_bytes(b'{"a":9}\n{"a":2}\n{"part":3}\n')
    assert store.dream_status(ME, again["run_id"])["source"] == "stale"


def test_call_envelope(store):
    assert set(CALLS) <= set(dir(store))
    assert store.call("nope", ME, {})["error"]["code"] == "unknown_tool"
    assert store.call("read", ME, {})["error"] == {"code": "missing_argument", "arguments": ["ids"]}
    assert store.call("read", ME, {"ids": ["x"], "y": 1})["error"]["code"] == "unknown_argument"
    assert store.call("read", ME, {"ids": ["x"]}) == {"ok": True, "tool": "read", "result": {"items": [], "missing": ["x"], "omitted": 0}}
    assert store.call("approve", ME, {"id": "x", "review": {}})["error"]["code"] == "not_found"
    bad = store.capture(ME, {"kind": "result", "title": "k", "body": "AKIA" + "A" * 16, "sources": [{"uri": "file:///var/tmp/x"}]})
    assert [n["code"] for n in bad["notices"]] == ["secret_pattern", "volatile_source"]


def test_writes_stay_within_what_the_caller_sees(store):
    a, b = ME, {"project_id": "q", "session_id": "s9"}
    rid = store.capture(a, {"kind": "decision", "title": "mine", "body": "of project p", "sources": [{"uri": "file:///data/zebra"}]}, review={"reason": "r"})["id"]
    for tool, more in (("withdraw", {}), ("annotate", {"retired": True}), ("approve", {}), ("supersede", {"old_ids": []})):
        assert store.call(tool, b, {"id": rid, "review": {"reason": "x"}, **more})["error"]["code"] == "not_found"
    assert store.one(rid)["effective_status"] == "active"
    assert [i["id"] for i in store.search(a, "zebra")["items"]] == [rid]  # found by its source alone
    store.dispose(b, ["file:///data/zebra"])  # another project's disposition hides nothing here
    assert store.search(a, "zebra")["items"]
    store.dispose(a, ["file:///data/zebra"])
    assert not store.search(a, "zebra")["items"]


def test_issues_beyond_the_limit_are_counted(store):
    ids = sorted(store.issue_open(ME, f"t{i}", "contradicts", "x")["id"] for i in range(4))
    got = store.issue_list(ME, limit=3)
    assert [i["issue_id"] for i in got["items"]] == ids[:3] and got["omitted"] == 1
    assert store.call("issue_close", ME | {"project_id": "q"}, {"id": ids[0], "disposition": "x"})["error"]["code"] == "not_found"


def test_only_the_owner_writes_to_a_run(store, tmp_path):
    log = granted(store, tmp_path) / "l.jsonl"
    log.write_text('{"a":1}\n')
    run = store.dream_start(ME, "mine", str(log))["run_id"]
    late = ME | {"session_id": "other"}
    assert store.call("dream_materials", late, {"run_id": run})["error"]["code"] == "not_owner"
    store.dream_takeover(late, run)
    assert store.call("dream_materials", ME, {"run_id": run})["error"]["code"] == "not_owner" and store.dream_materials(late, run)["items"]
    assert store.call("dream_status", ME | {"project_id": "q"}, {"run_id": run})["error"]["code"] == "not_found"


def test_shared_records_need_both_sides(store):
    there, here = ME | {"project_id": "q"}, ME
    given = add(store, "zebra given")
    store.annotate(ME, given, {"reason": "for q"}, details={"share_with": ["q"], "domain": "ops"})
    add(store, "zebra kept back")
    assert store.search(there, "zebra", include_shared=True)["items"] == []
    assert store.share(there, "p")["added"] and not store.share(there, "p")["added"]
    assert [r["id"] for r in store.search(there, "zebra", include_shared=True)["items"]] == [given]
    assert store.search(there, "zebra")["items"] == []
    assert store.read(there, [given])["missing"] == [given] and store.read(there, [given], include_shared=True)["missing"] == []
    assert len(store.search(here, "zebra")["items"]) == 2
    with pytest.raises(CallError, match="not_found"):
        store.withdraw(there, given, {"reason": "not theirs"})  # what is shared can be read, not written


def test_topics_add_terms_to_a_query(store):
    hit = add(store, "quokka", "marsupial of islands")
    assert store.search(ME, "wildlife")["items"] == []
    store.route(ME, "animals", "Wildlife", ["fauna"], ["zebra"])
    store.route(ME, "animals", "Wildlife", ["fauna"], ["quokka"])  # the last one counts
    assert [r["id"] for r in store.search(ME, "wildlife")["items"]] == [hit]
    assert store.search(ME | {"project_id": "q"}, "wildlife")["items"] == []


def test_shares_and_topics_are_bounded(store, monkeypatch):
    monkeypatch.setattr("strataline.plans.store.MOST_SHARES", 1)
    monkeypatch.setattr("strataline.plans.store.MOST_TOPICS", 1)
    store.share(ME, "a")
    store.share(ME, "a")
    store.route(ME, "t", "T")
    store.route(ME, "t", "T again")
    with pytest.raises(CallError, match="too_many_shares"):
        store.share(ME, "b")
    with pytest.raises(CallError, match="too_many_topics"):
        store.route(ME, "u", "U")


def test_only_granted_sources_are_read(store, tmp_path):
    logs, secret = granted(store, tmp_path), tmp_path / "secret.txt"
    secret.write_text("mine\n")
    (logs / "a.jsonl").write_text('{"a":1}\n{"a":2}\n')
    (logs / ".env").write_text("K=1\n")
    (logs / "link").symlink_to(secret)
    assert store.call("source_read", ME, {"path": str(logs / "a.jsonl")})["result"]["complete"]
    for tool, path in [(t, x) for t in ("source_read", "source_list") for x in ("/etc/hostname", str(secret), str(logs / "link"), str(logs / ".." / "secret.txt"), str(logs) + "x", str(logs / ".env"))]:
        assert store.call(tool, ME, {"path": path})["error"]["code"] == "not_granted", path
    assert store.call("dream_start", ME, {"objective": "o", "path": str(secret)})["error"]["code"] == "not_granted"
    assert store.call("source_read", ME | {"project_id": "q"}, {"path": str(logs / "a.jsonl")})["error"]["code"] == "not_granted"
    assert [i["path"].rsplit("/", 1)[1] for i in store.source_list(ME, str(logs))["items"]] in (["a.jsonl"], ["a.jsonl", "link"])
    assert store.call("source_list", ME, {"path": str(logs), "limit": 101})["error"]["code"] == "invalid_input"
    assert store.call("source_read", ME, {"path": str(logs / "absent")})["error"]["code"] == "source_unavailable"
    page = store.source_read(ME, str(logs / "a.jsonl"), max_bytes=3)
    run = store.dream_start(ME, "o", str(logs / "a.jsonl"))["run_id"]
    store.grant("p", "logs", str(logs), revoked=True)
    assert store.call("source_read", ME, {"path": str(logs / "a.jsonl"), "cursor": page["cursor"]})["error"]["code"] == "not_granted"
    assert store.call("dream_materials", ME, {"run_id": run})["error"]["code"] == "not_granted"
    store.grant("p", "logs", str(logs))  # granted anew: what was begun under the old grant stays ended
    assert store.call("source_read", ME, {"path": str(logs / "a.jsonl"), "cursor": page["cursor"]})["error"]["code"] == "not_granted"
    for path, kind in ((store.root, "directory"), (str(tmp_path), "directory"), ("relative", "file"), (str(logs), "socket")):
        with pytest.raises(CallError, match="invalid_policy"):
            store.grant("p", "x", path, kind)


def test_keys_are_a_projects_own_and_stand_for_the_whole_call(store):
    record, there = {"kind": "result", "title": "x", "body": "y", "sources": [{"uri": "file:///a"}]}, ME | {"project_id": "q"}
    one = store.capture(ME, record, idempotency_key="k1")
    two = store.capture(there, record, idempotency_key="k1")
    assert one["id"] != two["id"] and not two["replayed"] and store.capture(ME, record, idempotency_key="k1")["replayed"]
    changes = ({"record": record | {"sources": [{"uri": "file:///b"}]}}, {"record": record | {"scope": "task"}}, {"record": record, "details": {"domain": "d"}}, {"record": record, "review": {"reason": "r"}})
    for change in changes:
        assert store.call("capture", ME, change | {"idempotency_key": "k1"})["error"]["code"] == "idempotency_conflict", change
    assert store.call("capture", ME | {"task_id": "other"}, {"record": record, "idempotency_key": "k1"})["error"]["code"] == "idempotency_conflict"


def test_trust_cannot_be_forged(store):
    rid = add(store, "draft", reviewed=False)
    for tool, more in (("approve", {}), ("supersede", {"old_ids": []}), ("withdraw", {}), ("annotate", {})):
        for key in ("dream:me", " "):
            assert store.call(tool, ME, {"id": rid, "review": {}, "idempotency_key": key, **more})["error"]["code"] == "invalid_input"
    assert store.call("capture", ME, {"record": {"kind": "result", "title": "t", "body": "b"}, "idempotency_key": "dream:x:0"})["error"]["code"] == "invalid_input"
    store.approve(ME, rid, {"reason": "r"}, idempotency_key="mine")
    assert store.one(rid)["assurance"] == "self-reviewed"


def test_errors_stay_in_the_envelope(store):
    for caller in ({}, {"project_id": "p"}, {"project_id": "", "session_id": "s"}, {"project_id": 3, "session_id": "s"}):
        assert store.call("search", caller, {})["error"]["code"] == "invalid_context"
    for tool, given in (("capture", {"record": "text"}), ("capture", {"record": {"kind": "result", "title": "t", "body": "b", "sources": [{}]}}), ("search", {"limit": "x"}), ("read", {"ids": None}), ("source_read", {"path": None}), ("context", {"limit": 0}), ("issue_list", {"limit": 500})):
        assert store.call(tool, ME, given)["error"]["code"] == "invalid_input", tool


def test_materials_in_pages_must_cover_the_run(store, tmp_path):
    log = granted(store, tmp_path) / "long.jsonl"
    log.write_text("".join(f'{{"n":{i}}}\n' for i in range(9)) + "é" * 900 + "\n" + "last\n")
    run = store.dream_start(ME, "pages", str(log))["run_id"]
    cursor, texts, pages = None, [], 0
    while True:
        page = store.dream_materials(ME, run, max_bytes=400, cursor=cursor)
        texts += [i["raw"] for i in page["items"]]
        pages += 1
        cursor = page["cursor"]
        if cursor is None:
            break
        assert page["omitted"] and store.call("dream_draft", ME, {"run_id": run, "operations": []})["error"]["code"] == "not_served"
    assert "".join(texts) == log.read_text().replace("\n", "") and pages > 5
    assert store.dream_status(ME, run)["next"] == "draft" and store.dream_draft(ME, run, [])["operations"] == 0
    store.dream_takeover(OTHER, run)  # a new attempt has seen nothing
    assert store.call("dream_close", OTHER, {"run_id": run})["error"]["code"] == "not_reviewed"
    assert store.call("dream_materials", OTHER, {"run_id": run, "cursor": "x"})["error"]["code"] == "invalid_cursor"


def drafted(store, tmp_path, operations, name="run"):
    log = granted(store, tmp_path) / f"{name}.jsonl"
    log.write_text("{}\n")
    run = store.dream_start(ME, name, str(log))["run_id"]
    store.dream_materials(ME, run)
    store.dream_draft(ME, run, operations)
    return run


def test_operations_of_a_draft_refer_to_each_other(store, tmp_path):
    old = add(store, "old")
    why = {"reason": "r"}
    ops = [
        {"action": "supersede", "id": "op:new", "old_ids": [old], "review": why},
        {"action": "annotate", "id": "op:base", "review": why, "details": {"domain": "d"}},
        {"action": "capture", "op": "new", "record": {"kind": "decision", "title": "new", "body": "b", "sources": [{"uri": "op:base"}]}},
        {"action": "capture", "op": "base", "record": {"kind": "evidence", "title": "base", "body": "b"}, "review": why},
    ]
    run = drafted(store, tmp_path, ops)
    out = store.dream_publish(ME, run)["outcomes"]
    assert [o["outcome"] for o in out] == ["applied"] * 4 and out[0]["id"] == out[2]["id"] and out[1]["id"] == out[3]["id"]
    new = store.one(out[2]["id"])
    assert [x["uri"] for x in new["sources"]] == [f"record:{out[3]['id']}"] and new["effective_status"] == "active" and new["assurance"] == "dreaming-reviewed"
    assert status(store, old) == "superseded" and store.one(out[3]["id"])["domain"] == "d"
    bad = {"action": "capture", "op": "x", "record": {"kind": "decision", "title": "x", "body": "b", "sources": [{"uri": "op:y"}]}}
    for odd, code in (([bad], "invalid_operation"), ([bad, bad | {"op": "x"}], "invalid_operation"), ([bad, bad | {"op": "y", "record": bad["record"] | {"sources": [{"uri": "op:x"}]}}], "cyclic_reference"), ([{"action": "withdraw", "op": "w", "id": old, "review": why}, {"action": "withdraw", "id": "op:w", "review": why}], "invalid_operation")):
        with pytest.raises(CallError, match=code):
            store._resolved(ME, "r", odd)


def test_a_publication_that_breaks_off_ends_in_one_effect(store, tmp_path, monkeypatch):
    kept, changed = add(store, "kept"), add(store, "changed")
    why = {"reason": "r"}
    ops = [{"action": "capture", "record": {"kind": "result", "title": "t", "body": "b"}, "review": why}, {"action": "withdraw", "id": kept, "review": why}, {"action": "withdraw", "id": changed, "review": why}, {"action": "annotate", "id": kept, "review": why, "details": {"domain": "d"}}]
    run = drafted(store, tmp_path, ops)
    store.annotate(OTHER, changed, why, details={"summary": "someone else's"})
    append, calls = store.receipts.append, []

    def dies(rows, key):
        calls.append(1)
        if len(calls) == 2:  # the withdrawal is written, its receipt is not
            raise RuntimeError("killed")
        return append(rows, key)

    monkeypatch.setattr(store.receipts, "append", dies)
    with pytest.raises(RuntimeError):
        store.dream_publish(ME, run)
    monkeypatch.undo()
    written = store.events.all().count()
    out = store.dream_publish(ME, run)["outcomes"]
    assert [o["outcome"] for o in out] == ["applied", "applied", "blocked", "applied"] and out[2]["reason"] == "changed_target"
    assert store.events.all().count() == written + 1 and store.records.all().count() == 3 and store.dream_publish(ME, run)["outcomes"] == out
    assert (status(store, kept), status(store, changed)) == ("withdrawn", "active")
