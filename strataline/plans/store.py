"""A store of records and reviews over append-only tables, and the calls that callers make on it.

State is never updated in place: each call appends an event, and what is current is the fold of the events.
There is one writer, the driver; calls are idempotent by key, and fenced by the revision they were made from.
"""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime, timedelta, timezone
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_json, secret_classes, tokens, volatile_path
from ..operators import access, effects, graph, lifecycle, review, scan
from ..sources import logs
from ..sources.records import KINDS, SCOPES, Journal
from . import packing
from . import search as finder

# The calls there are, with what each must and may be given.
CALLS = {
    "context": (set(), {"query", "limit", "max_bytes", "task_mode", "previous_revision"}), "search": (set(), {"query", "limit", "cursor", "statuses", "include_inactive", "domain", "task_mode", "mode_restriction", "include_shared"}),
    "read": ({"ids"}, {"max_bytes", "include_shared"}), "capture": ({"record"}, {"review", "details", "idempotency_key"}), "approve": ({"id", "review"}, {"idempotency_key"}),
    "supersede": ({"id", "old_ids", "review"}, {"idempotency_key"}), "withdraw": ({"id", "review"}, {"idempotency_key"}), "annotate": ({"id", "review"}, {"details", "retired", "expected_revision", "idempotency_key"}),
    "source_list": ({"path"}, {"after", "limit"}), "source_read": ({"path"}, {"cursor", "max_bytes"}), "dream_start": ({"objective", "path"}, set()), "dream_status": ({"run_id"}, set()),
    "dream_materials": ({"run_id"}, {"max_bytes", "cursor"}), "dream_draft": ({"run_id", "operations"}, {"expected_revision"}), "dream_publish": ({"run_id"}, {"expected_revision"}), "dream_close": ({"run_id"}, {"accept_gaps"}),
    "dream_takeover": ({"run_id"}, set()), "overview": (set(), {"scenario", "max_bytes"}), "issue_open": ({"topic", "relation", "text"}, set()), "issue_list": (set(), {"query", "limit"}), "issue_close": ({"id", "disposition"}, set()),
}
CONTEXT_BYTES = 8000
# Projects that one project imports from, and topics of a project, at most; both are broadcast.
MOST_SHARES, MOST_TOPICS = 128, 64
# Names that no folder's grant covers, the prefix of keys that only a review's publication uses, and rows of a page at most.
UNLISTED, REVIEW_KEYS, PAGE = ("AGENTS.md", "SKILL.md", ".env"), "dream:", 100
# What a draft's operations may do, with what each must and may be given.
OPERATIONS = {
    "capture": ({"record"}, {"review", "details"}), "approve": ({"id", "review"}, set()), "supersede": ({"id", "old_ids", "review"}, set()),
    "withdraw": ({"id", "review"}, set()), "annotate": ({"id", "review"}, {"details", "retired", "expected_revision"}),
}
DETAILS = "summary string, conditions string, domain string, topics array<string>, aliases array<string>, share_with array<string>, task_modes array<string>, assurance string"


class CallError(ValueError):
    """An error with a code that callers can tell apart."""


class Store:
    def __init__(self, spark: SparkSession, root: str, clock=lambda: datetime.now(timezone.utc)):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock
        table = lambda name, schema: Journal(spark, f"{self.root}/{name}", schema)
        self.records = table("records", "id string, project_id string, scope string, worktree_id string, task_id string, kind string, title string, body string, sources array<struct<uri:string,locator:string>>, session string, created_at timestamp, expires_at timestamp, payload string")
        self.events = table("events", "record_id string, at timestamp, op string, session string, reason string, old_ids array<string>, retired boolean, details string, origin string")
        self.issues = table("issues", "issue_id string, target string, topic string, relation string, text string, disposition string")
        self.dispositions = table("dispositions", "target string, topic string, kind string, source_keys array<string>")
        self.shares = table("shares", "target string, source string, domain string")
        self.topics = table("topics", "target string, topic_id string, title string, aliases array<string>, search_terms array<string>")
        self.runs = table("runs", "run_id string, objective string, target string, state string, generation bigint, body string")
        self.reads = table("reads", "run_id string, attempt bigint, start bigint, end bigint")
        self.intents = table("intents", "run_id string, place int, target string, before string")
        self.receipts = table("receipts", "run_id string, place int, outcome string")
        self.grants = table("grants", "grant_id string, target string, path string, kind string, revoked boolean")

    # ---- state

    def current(self, as_of: datetime | None = None) -> DataFrame:
        """All records with effective_status, assurance, revision and folded details, in a few equi-joins."""
        now = F.lit(as_of or self.clock()).cast("timestamp")
        events = self.events.all().withColumn("d", F.from_json("details", DETAILS))
        names = [c.split()[0] for c in DETAILS.split(", ")]
        last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("seq")))
        folded = events.groupBy(F.col("record_id").alias("id")).agg(
            *[last(F.col(f"d.{n}")).alias(n) for n in names], last(F.col("retired")).alias("retired"), F.max("at").alias("touched_at"), F.max_by("digest", "seq").alias("revision"),
            F.coalesce(F.bool_or(F.col("op").isin("approve", "supersede")), F.lit(False)).alias("promoted"), F.bool_or(F.col("op") == "withdraw").alias("is_withdrawn"),
            F.max_by("session", F.when(F.col("op").isin("approve", "supersede"), F.col("seq"))).alias("reviewer"), F.max_by(F.coalesce("origin", F.lit("")), F.when(F.col("op").isin("approve", "supersede"), F.col("seq"))).alias("promotion"),
            F.array_distinct(F.flatten(F.collect_list(F.coalesce("old_ids", F.array().cast("array<string>"))))).alias("supersedes"),
        )
        r = self.records.all().drop("digest", "seq", "previous", "op_key", "payload").join(folded, "id", "left")
        r = r.withColumns({"supersedes": F.coalesce("supersedes", F.array().cast("array<string>")), "withdraws": F.lit(None).cast("string"), "status": F.when(F.coalesce("promoted", F.lit(False)), "active").otherwise("candidate")})
        gone = F.coalesce("is_withdrawn", F.lit(False)).alias("withdrawn")
        r = lifecycle.link_flags(r.select("*", gone).drop("is_withdrawn")).withColumn("is_withdrawn", F.col("withdrawn"))
        shown = lifecycle.displayed_status(lifecycle.effective_status(now), now, F.coalesce("retired", F.lit(False)), touched=F.greatest("created_at", F.coalesce("touched_at", "created_at")))
        trust = lifecycle.assurance(F.col("reviewer"), F.col("session"), F.coalesce("promotion", F.lit("")), F.coalesce(F.col("assurance") == "model-extracted", F.lit(False)))
        return r.withColumns({"effective_status": shown, "assurance": trust, "revision": F.coalesce("revision", F.lit("start"))}).drop("withdrawn", "promoted", "promotion", "reviewer")

    def one(self, record_id: str) -> Row:
        row = self.current().where(F.col("id") == record_id).first()
        if row is None:
            raise CallError("not_found")
        return row

    def seen(self, caller: dict, record_id: str) -> Row:
        """The record, if the caller's scopes show it: what a caller can't see isn't found, for writes as for reads."""
        rows = self.current().where(access.visible(caller["project_id"], caller.get("worktree_id"), caller.get("task_id")))
        row = rows.where(F.col("id") == record_id).first()
        if row is None:
            raise CallError("not_found")
        return row

    def prohibited(self, caller: dict) -> DataFrame:
        """The dispositions of the caller's own project: no project hides sources from another."""
        return self.dispositions.all().where(F.col("target") == caller["project_id"])

    def imports(self, caller: dict) -> DataFrame:
        """Edges (from, to, domain) into the caller's project, MOST_SHARES at most."""
        rows = self.shares.all().where(F.col("target") == caller["project_id"])
        return rows.select(F.col("source").alias("from"), F.col("target").alias("to"), "domain")

    def expansion(self, caller: dict, query: str) -> list[str]:
        """Search terms that the project's topics add to a query which names them."""
        if not query.strip():
            return []
        asked = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        last = self.topics.all().where(F.col("target") == caller["project_id"]).groupBy("topic_id").agg(F.max_by(F.struct("title", "aliases", "search_terms"), "seq").alias("t"))
        rows = access.route_matches(asked, last.select("topic_id", "t.*")).collect()  # a row a topic
        return sorted({t for r in rows for t in r["expansion"]})

    # ---- writes

    def share(self, caller: dict, source: str, domain: str | None = None) -> dict:
        """The caller's project imports from another one what that one's records share with it."""
        key = sha256(canonical_json([caller["project_id"], source, domain]).encode()).hexdigest()
        there = self.shares.all().where(F.col("target") == caller["project_id"])
        if there.where(F.col("op_key") != key).count() >= MOST_SHARES:
            raise CallError("too_many_shares")
        n = self.shares.append(self.spark.createDataFrame([(key, caller["project_id"], source, domain)], "op_key string, target string, source string, domain string"), "target")
        return {"id": key, "added": bool(n)}

    def route(self, caller: dict, topic_id: str, title: str, aliases: list[str] = (), search_terms: list[str] = ()) -> dict:
        """A topic of the caller's project; the last one of an id counts."""
        body = [caller["project_id"], topic_id, title, list(aliases), list(search_terms)]
        there = self.topics.all().where(F.col("target") == caller["project_id"])
        if there.where(F.col("topic_id") != topic_id).select("topic_id").distinct().count() >= MOST_TOPICS:
            raise CallError("too_many_topics")
        n = there.where(F.col("topic_id") == topic_id).count()
        row = (sha256(canonical_json([*body, n]).encode()).hexdigest(), *body)
        self.topics.append(self.spark.createDataFrame([row], "op_key string, target string, topic_id string, title string, aliases array<string>, search_terms array<string>"), "target")
        return {"id": topic_id}

    @staticmethod
    def _key(caller: dict, key: str | None, *made_of) -> str:
        """A caller's key, or one made of what is asked for; keys are a project's own. Those of a review's publication can't be claimed."""
        if key is not None and (not isinstance(key, str) or not key.strip() or key.startswith(REVIEW_KEYS)):
            raise CallError("invalid_input")
        return f"{caller['project_id']}\x1f{key or sha256(canonical_json(made_of).encode()).hexdigest()}"

    def _event(self, key, record_id, op, session, reason, old_ids=None, retired=None, details=None, expected=None, origin=None) -> dict:
        row = {"op_key": key, "record_id": record_id, "at": self.clock(), "op": op, "session": session, "reason": reason, "old_ids": old_ids, "retired": retired, "details": details and canonical_json(details), "origin": origin, "expected": expected}
        seen = self.events.all().where(F.col("op_key") == key).first()
        if seen is not None:  # a replay has its own time; all else must agree
            if any(seen[c] != row[c] for c in ("record_id", "op", "reason", "old_ids", "retired", "details", "session")):
                raise CallError("idempotency_conflict")
            return {"id": record_id, "replayed": True}
        schema = "op_key string, record_id string, at timestamp, op string, session string, reason string, old_ids array<string>, retired boolean, details string, origin string, expected string"
        try:
            self.events.append(self.spark.createDataFrame([tuple(row.values())], schema), "record_id")
        except CallError:
            raise
        except ValueError as e:
            raise CallError(str(e)) from e
        return {"id": record_id, "replayed": False}

    def capture(self, caller: dict, record: dict, review: dict | None = None, details: dict | None = None, idempotency_key: str | None = None) -> dict:
        """Candidate, annotation, promotion: each stage is keyed, so an identical retry picks up where it broke off.

        A key stands for the whole call: the record with its sources, details and review, and the caller's own context. Anything else under it is a conflict.
        """
        return self._capture(caller, record, review, details, self._key(caller, idempotency_key, caller["session_id"], record))

    def _capture(self, caller, record, review, details, key, origin=None) -> dict:
        if record.get("kind") not in KINDS or not str(record.get("title", "")).strip() or not str(record.get("body", "")).strip():
            raise CallError("invalid_input")
        scope, sources = record.get("scope", "project"), [(s["uri"], s.get("locator")) for s in record.get("sources", [])]
        if scope not in SCOPES or scope != "project" and not caller.get("worktree_id") or scope == "task" and not caller.get("task_id"):
            raise CallError("invalid_input")
        context = {k: caller.get(k) for k in ("project_id", "worktree_id", "task_id", "session_id")}
        payload = sha256(canonical_json([context, record, details, review]).encode()).hexdigest()
        rid = sha256(key.encode()).hexdigest()[:32]
        old = self.records.all().where(F.col("op_key") == key).first()
        if old is not None and old["payload"] != payload:
            raise CallError("idempotency_conflict")
        if old is None:
            now = self.clock()
            expires = now + timedelta(days=lifecycle.TASK_DAYS) if scope == "task" else None
            row = (key, rid, caller["project_id"], scope, caller.get("worktree_id") if scope != "project" else None, caller.get("task_id") if scope == "task" else None, record["kind"], record["title"], record["body"], sources, caller["session_id"], now, expires, payload)
            schema = "op_key string, " + ", ".join(self.records.schema.split(", ")[4:])
            self.records.append(self.spark.createDataFrame([row], schema), "id")
        if details:
            self._event(f"{key}:details", rid, "annotate", caller["session_id"], "capture", details=details)
        if review:
            self._event(f"{key}:approve", rid, "approve", caller["session_id"], review.get("reason", ""), origin=origin)
        text = self.spark.createDataFrame([(record["title"] + "\n" + record["body"], [u for u, _ in sources])], "t string, u array<string>")
        said = text.select(secret_classes(F.col("t")).alias("s"), F.filter("u", volatile_path).alias("v")).first()
        return {"id": rid, "effective_status": self.one(rid)["effective_status"], "replayed": old is not None, "notices": [{"code": "secret_pattern", "pattern": x} for x in said["s"]] + [{"code": "volatile_source", "uri": x} for x in said["v"]]}

    def _promote(self, caller, record_id, review, old_ids, key, op, origin=None):
        row = self.seen(caller, record_id)
        if self.events.all().where(F.col("op_key") == key).first() is None:
            if row["status"] != "candidate" or row["effective_status"] not in ("candidate", "stale"):
                raise CallError("not_candidate")
            there = self.current().where(access.visible(caller["project_id"], caller.get("worktree_id"), caller.get("task_id")))
            olds = {o["id"]: o for o in there.where(F.col("id").isin(old_ids)).collect()} if old_ids else {}
            same = ("project_id", "scope", "worktree_id", "task_id")
            if any(i not in olds or olds[i]["effective_status"] != "active" or any(olds[i][c] != row[c] for c in same) for i in old_ids):
                raise CallError("invalid_predecessor")
        return self._event(key, record_id, op, caller["session_id"], review.get("reason", ""), old_ids or None, origin=origin)

    def approve(self, caller, id, review, idempotency_key=None):  # noqa: A002
        return self._promote(caller, id, review, [], self._key(caller, idempotency_key, "approve", id, caller["session_id"]), "approve")

    def supersede(self, caller, id, old_ids, review, idempotency_key=None):  # noqa: A002
        return self._promote(caller, id, review, list(old_ids), self._key(caller, idempotency_key, "supersede", id, caller["session_id"], list(old_ids)), "supersede")

    def withdraw(self, caller, id, review, idempotency_key=None):  # noqa: A002
        return self._withdraw(caller, id, review, self._key(caller, idempotency_key, "withdraw", id, caller["session_id"]))

    def _withdraw(self, caller, record_id, review, key):
        self.seen(caller, record_id)
        return self._event(key, record_id, "withdraw", caller["session_id"], review.get("reason", ""))

    def annotate(self, caller, id, review, details=None, retired=None, expected_revision=None, idempotency_key=None):  # noqa: A002
        return self._annotate(caller, id, review, self._key(caller, idempotency_key, "annotate", id, details, retired, expected_revision, caller["session_id"]), details, retired, expected_revision)

    def _annotate(self, caller, record_id, review, key, details=None, retired=None, expected_revision=None):
        self.seen(caller, record_id)
        return self._event(key, record_id, "annotate", caller["session_id"], review.get("reason", ""), retired=retired, details=details, expected=expected_revision)

    # ---- reads

    def search(self, caller, query="", limit=20, cursor=None, statuses=("active",), include_inactive=False, domain=None, task_mode=None, mode_restriction=False, include_shared=False):
        how = {"expansion": self.expansion(caller, query), "statuses": tuple(statuses), "include_inactive": include_inactive, "domain": domain, "mode": task_mode, "dispositions": self.prohibited(caller), "restrict_mode": mode_restriction}
        if include_shared:
            how["share_edges"] = self.imports(caller)
        return finder.search(self.current().drop("supersedes", "touched_at"), caller, query, limit, cursor, **how)

    def read(self, caller, ids, max_bytes=finder.SEARCH_BYTES, include_shared=False):
        if not 1 <= len(ids) <= 100:
            raise CallError("invalid_input")
        rows = finder.candidates(self.current(), caller, share_edges=self.imports(caller) if include_shared else None, include_inactive=True)
        shown = rows.select("id", "project_id", "kind", "title", "body", "effective_status", "assurance", "revision", F.col("sources.uri").alias("sources"))
        return finder.read(shown, ids, max_bytes)

    def context(self, caller, query="", limit=8, max_bytes=CONTEXT_BYTES, task_mode=None, previous_revision=None):
        """Ranked evidence, each with what it is related to, as whole groups that fit; then background."""
        pool = finder.candidates(self.current(), caller, dispositions=self.prohibited(caller))
        if not 1 <= limit <= PAGE:
            raise CallError("invalid_input")
        hits, order = finder.ranked(pool, query, self.expansion(caller, query), mode=task_mode)
        top = hits.orderBy(*order).limit(limit).select("id", "title", "kind", "body", "revision").collect()
        units = [[{"id": r["id"], "group": "task", "kind": r["kind"], "title": r["title"], "text": r["body"]}] for r in top]
        rest = pool.where(~F.col("id").isin([r["id"] for r in top])).orderBy(F.desc("created_at"), "id").limit(limit).select("id", "title", "kind", "body", "revision").collect()
        units += [[{"id": r["id"], "group": "background", "kind": r["kind"], "title": r["title"], "text": r["body"][:360]}] for r in rest]
        now = packing.revision(query, task_mode, [(r["id"], r["revision"]) for r in [*top, *rest]])
        if previous_revision == now:
            return {"state": "unchanged", "revision": now}
        groups, omitted = packing.pack_groups(units, max_bytes)
        return {"state": "ok" if groups or not units else "budget-limited", "groups": groups, "omitted": omitted, "revision": now}

    def overview(self, caller, scenario=None, max_bytes=CONTEXT_BYTES):
        """What is active by kind, and what waits: candidates by age, then expired ones."""
        rows = self.current().where(F.col("project_id") == caller["project_id"])
        counts = {r["kind"]: r["count"] for r in rows.where("effective_status = 'active'").groupBy("kind").count().collect()}
        at = F.unix_timestamp("created_at")
        waits = [rows.where(F.col("effective_status").isin(*s)).select(F.concat(F.lit("record:"), "id").alias("ref"), F.lit(s[0]).alias("reason"), at.alias("sort_key")) for s in (("candidate", "stale"), ("expired",))]
        top, left = review.inventory(waits, 64)
        items, omitted = packing.pack_stop([r.asDict() for r in top.orderBy("section", "sort_key", "ref").collect()], max_bytes)
        return {"active": counts, "waiting": items, "omitted": omitted + left.first()["omitted"]}

    # ---- issues and prohibited sources

    def issue_open(self, caller, topic, relation, text):
        issue = sha256(canonical_json([caller["project_id"], topic, relation]).encode()).hexdigest()
        now = self.issues.latest("issue_id").where(F.col("issue_id") == issue).first()
        if now is not None and now["text"] == text and now["disposition"] == "pending":
            return {"id": issue, "changed": False}
        self._issue(issue, caller["project_id"], topic, relation, text, "pending")
        return {"id": issue, "changed": True}

    def _issue(self, *row):
        n = self.issues.all().where(F.col("issue_id") == row[0]).count()
        self.issues.append(self.spark.createDataFrame([(f"{row[0]}:{n}", *row)], "op_key string, issue_id string, target string, topic string, relation string, text string, disposition string"), "issue_id")

    def issue_list(self, caller, query="", limit=64):
        """Pending issues of the caller's project by id; ``omitted`` says how many more there are."""
        if not 1 <= limit <= PAGE:
            raise CallError("invalid_input")
        rows = self.issues.latest("issue_id").where((F.col("target") == caller["project_id"]) & (F.col("disposition") == "pending"))
        if query.strip():
            rows = rows.where(F.arrays_overlap(tokens(F.concat_ws(" ", "topic", "text")), F.array(*[F.lit(t) for t in finder.query_terms(self.spark, query)] or [F.lit("")])))
        items = [r.asDict() for r in rows.select("issue_id", "topic", "relation", "text").orderBy("issue_id").limit(limit).collect()]
        return {"items": items, "omitted": rows.count() - len(items) if len(items) == limit else 0}

    def issue_close(self, caller, id, disposition):  # noqa: A002
        row = self.issues.latest("issue_id").where((F.col("issue_id") == id) & (F.col("target") == caller["project_id"])).first()
        if row is None:
            raise CallError("not_found")
        if row["disposition"] == "pending":
            self._issue(id, row["target"], row["topic"], row["relation"], row["text"], disposition)
        return {"id": id, "disposition": disposition}

    def dispose(self, caller, uris: list[str], topic: str = "*", kind: str = "exclude") -> dict:
        from ..functions.text import source_key

        keys = [r["k"] for r in self.spark.createDataFrame([(u,) for u in uris], "u string").select(source_key(F.col("u")).alias("k")).collect()]
        key = sha256(canonical_json([caller["project_id"], topic, kind, sorted(keys)]).encode()).hexdigest()
        n = self.dispositions.append(self.spark.createDataFrame([(key, caller["project_id"], topic, kind, sorted(keys))], "op_key string, target string, topic string, kind string, source_keys array<string>"), "target")
        return {"id": key, "added": bool(n)}

    # ---- sources and review runs

    def grant(self, project_id: str, grant_id: str, path: str, kind: str = "directory", revoked: bool = False) -> dict:
        """What the host lets a project's callers read: a file, or all below a folder. No call of CALLS grants anything. The last row of an id counts."""
        real, own = os.path.realpath(path), os.path.realpath(self.root.removeprefix("file://"))
        if kind not in ("file", "directory") or not os.path.isabs(path) or _within(real, own) or kind == "directory" and _within(own, real):
            raise CallError("invalid_policy")
        n = self.grants.all().where((F.col("grant_id") == grant_id) & (F.col("target") == project_id)).count()
        key = sha256(canonical_json([project_id, grant_id, real, kind, revoked, n]).encode()).hexdigest()
        self.grants.append(self.spark.createDataFrame([(key, grant_id, project_id, real, kind, revoked)], "op_key string, grant_id string, target string, path string, kind string, revoked boolean"), "grant_id")
        return {"id": grant_id, "digest": key}

    def granted(self, caller: dict, path: str) -> tuple[str, str]:
        """(real path, digest of the grant) of a path that lies in what the caller's project was granted; nothing is opened before that.

        Links are followed first, so none leads out of a grant. The digest binds cursors and runs to the grant: a changed or revoked one ends them.
        """
        if not isinstance(path, str):
            raise CallError("invalid_input")
        real = os.path.realpath(path.removeprefix("file://").removeprefix("file:"))
        rows = self.grants.all().where(F.col("target") == caller["project_id"]).groupBy("grant_id").agg(F.max_by(F.struct("path", "kind", "revoked", "op_key"), "seq").alias("g")).select("g.*")
        for row in rows.where("NOT revoked").orderBy(F.length("path").desc(), "op_key").collect():  # a project's grants: configuration
            inside = real == row["path"] if row["kind"] == "file" else _within(real, row["path"]) and os.path.basename(real) not in UNLISTED
            if inside:
                return real, row["op_key"]
        raise CallError("not_granted")

    def source_list(self, caller, path, after=None, limit=50):
        if not 1 <= limit <= PAGE:
            raise CallError("invalid_input")
        real, _ = self.granted(caller, path)
        rows = logs.listing(self.spark, real, after, None).where(~F.element_at(F.split("path", "/"), -1).isin(*UNLISTED)).limit(limit + 1).collect()
        return {"items": [r.asDict() for r in rows[:limit]], "cursor": rows[limit - 1]["path"] if len(rows) > limit else None}

    def source_read(self, caller, path, cursor=None, max_bytes=262_144):
        """Whole lines from a position on; a cursor holds the position, a digest of all before it and the grant."""
        path, grant = self.granted(caller, path)
        at = 0
        if cursor:
            digest, (at, under) = packing.decode_cursor(cursor, "source")
            if under != grant:
                raise CallError("not_granted")
            if logs.prefix_digest(path, at) != digest:
                raise CallError("source_changed")
        rows, end, used = [], logs.whole(path, at), 0
        for row in logs.frames(path, at, end):
            if used and used + row[2] - row[1] > max_bytes:
                break
            rows.append(dict(zip(("path", "byte_start", "byte_end", "raw", "gap"), row)))
            used, at = used + row[2] - row[1], row[2]
        return {"items": rows, "cursor": packing.encode_cursor("source", logs.prefix_digest(path, at), [at, grant]), "complete": at >= end}

    def _run(self, caller, run_id, writes=False):
        """A run of the caller's project; only the session that started it, or last took it over, writes to it."""
        row = self.runs.latest("run_id").where((F.col("run_id") == run_id) & (F.col("target") == caller["project_id"])).first()
        if row is None:
            raise CallError("not_found")
        body = json.loads(row["body"])
        if writes and body["owner"] != caller["session_id"]:
            raise CallError("not_owner")
        return row, body

    def _save_run(self, run_id, objective, target, state, generation, body):
        n = self.runs.all().where(F.col("run_id") == run_id).count()
        row = (f"{run_id}:{n}", run_id, objective, target, state, generation, canonical_json(body))
        self.runs.append(self.spark.createDataFrame([row], "op_key string, run_id string, objective string, target string, state string, generation bigint, body string"), "run_id")

    def dream_start(self, caller, objective, path):
        """A batch from where the objective's last closed run stopped; nothing new is no run."""
        done = self.runs.latest("run_id").where((F.col("objective") == objective) & (F.col("target") == caller["project_id"]))
        if done.where("state IN ('open', 'drafted', 'published')").limit(1).count():
            raise CallError("run_open")
        path, grant = self.granted(caller, path)
        body = F.from_json("body", "path string, end bigint")
        start = done.where("state = 'closed'").select(body.alias("b")).where(F.col("b.path") == path).agg(F.max("b.end")).first()[0] or 0
        page = self.source_read(caller, path, packing.encode_cursor("source", logs.prefix_digest(path, start), [start, grant]))
        if not page["items"]:
            return {"state": "no-change"}
        run_id = uuid.uuid4().hex
        gaps = [{"reason": r["gap"], "at": r["byte_start"]} for r in page["items"] if r["gap"]]
        self._save_run(run_id, objective, caller["project_id"], "open", 1, {"path": path, "start": start, "end": page["items"][-1]["byte_end"], "digest": logs.prefix_digest(path, page["items"][-1]["byte_end"]), "gaps": gaps, "grant": grant, "owner": caller["session_id"]})
        return {"state": "open", "run_id": run_id, "events": len(page["items"]) - len(gaps), "gaps": gaps}

    def dream_status(self, caller, run_id):
        row, body = self._run(caller, run_id)
        changed = logs.prefix_digest(body["path"], body["end"]) != body["digest"]
        return {"state": row["state"], "generation": row["generation"], "revision": row["digest"], "source": "stale" if changed else "valid", "next": {"open": "draft" if self._served(row, body) else "materials", "drafted": "publish", "published": "close"}.get(row["state"])}

    def _served(self, row, body) -> bool:
        """Whether what this attempt was shown covers the whole of the run's lines: the union of what was read, without a hole."""
        reads = self.reads.all().where((F.col("run_id") == row["run_id"]) & (F.col("attempt") == row["generation"]))
        marks = self.spark.createDataFrame([(row["run_id"], row["generation"], body["start"], body["end"])], "run_id string, attempt bigint, start bigint, end bigint")
        keys = ["run_id", "attempt"]
        return scan.uncovered_marks(marks, scan.covered_ranges(reads, keys), keys).isEmpty()

    def dream_materials(self, caller, run_id, max_bytes=CONTEXT_BYTES, cursor=None):
        """The run's lines, read again from their positions; text is never stored with a run.

        A page ends at the last line that fits; a line that is longer than a page comes in parts. ``cursor`` goes on where a page ended. What a page
        showed is kept as a range of bytes of this attempt; a draft and the close ask that all of the run lies in such ranges.
        """
        row, body = self._run(caller, run_id, writes=True)
        if self.granted(caller, body["path"]) != (body["path"], body["grant"]):
            raise CallError("not_granted")
        if logs.prefix_digest(body["path"], body["end"]) != body["digest"]:
            raise CallError("source_changed")
        begin = body["start"]
        if cursor:
            digest, begin = packing.decode_cursor(cursor, "materials")
            if digest != body["digest"] or not body["start"] <= begin <= body["end"]:
                raise CallError("invalid_cursor")
        items, used, at = [], 0, begin
        for _, a, b, raw, gap in logs.frames(body["path"], body["start"], body["end"]):
            if b <= begin:
                continue
            if gap:  # a run's gaps are told when it starts, and accepted when it closes
                at = b
                continue
            data = raw.encode()[max(0, at - a) :]
            item = {"byte_start": max(a, at), "raw": data.decode()}
            size = packing.serialized_size(item)
            if used + size > max_bytes:
                if items:
                    break
                part, then = packing.slice_text(item["raw"], 0, max_bytes, lambda x, at=item["byte_start"]: {"byte_start": at, "raw": x, "partial": True})
                items, at = [{"byte_start": item["byte_start"], "raw": part, "partial": then is not None}], b if then is None else item["byte_start"] + len(part.encode())
                break
            items.append(item)
            used, at = used + size, b
        done = at >= body["end"]
        key = f"{run_id}:{row['generation']}:{begin}:{at}"
        self.reads.append(self.spark.createDataFrame([(key, run_id, row["generation"], begin, at)], "op_key string, run_id string, attempt bigint, start bigint, end bigint"), "run_id")
        left = sum(b > at and not gap for _, _, b, _, gap in logs.frames(body["path"], body["start"], body["end"])) if not done else 0
        return {"items": items, "omitted": left, "cursor": None if done else packing.encode_cursor("materials", body["digest"], at)}

    def dream_draft(self, caller, run_id, operations, expected_revision=None):
        """The operations are checked one by one before anything is kept: known actions with what each needs, and nothing else."""
        row, body = self._run(caller, run_id, writes=True)
        if expected_revision not in (None, row["digest"]):
            raise CallError("stale_revision")
        if row["state"] != "open" or not self._served(row, body):
            raise CallError("not_served" if row["state"] == "open" else "not_open")
        for op in operations:
            need, may = OPERATIONS.get(op.get("action") if isinstance(op, dict) else None, (None, None))
            if need is None or need - set(op) or set(op) - need - may - {"action", "op"} or any(not isinstance(op[k], dict) for k in ("record", "review", "details") if op.get(k) is not None):
                raise CallError("invalid_operation")
        resolved, order = self._resolved(caller, run_id, operations)
        targets = [self._reserved(caller, run_id, n) if op["action"] == "capture" else op["id"] for n, op in enumerate(resolved)]
        then = {r["id"]: r["revision"] for r in self.current().where(F.col("id").isin(targets)).select("id", "revision").collect()}  # as many as the draft's operations
        if targets:  # what each operation is to act on, as it is now; a draft that is sent again finds its own rows
            rows = [(f"{run_id}:{row['generation']}:{n}", run_id, n, t, then.get(t, effects.ABSENT)) for n, t in enumerate(targets)]
            self.intents.append(self.spark.createDataFrame(rows, "op_key string, run_id string, place int, target string, before string"), "run_id")
        self._save_run(run_id, row["objective"], row["target"], "drafted", row["generation"], body | {"operations": resolved, "order": order})
        return {"state": "drafted", "operations": len(operations)}

    @staticmethod
    def _review_key(caller, run_id, place) -> str:
        return f"{caller['project_id']}\x1f{REVIEW_KEYS}{run_id}:{place}"

    def _reserved(self, caller, run_id, place) -> str:
        """The id that a draft's capture will have."""
        return sha256(self._review_key(caller, run_id, place).encode()).hexdigest()[:32]

    def _resolved(self, caller, run_id, operations) -> tuple[list[dict], list[int]]:
        """The operations with ids instead of references to each other (``op:<name>``, of a capture with that name), and the order in which they can be applied."""
        names = {op["op"]: n for n, op in enumerate(operations) if op.get("op") is not None}
        if len(names) != sum(op.get("op") is not None for op in operations):
            raise CallError("invalid_operation")
        needs: list[tuple[int, int]] = []

        def real(place, value, prefix=""):
            if not isinstance(value, str) or not value.startswith("op:"):
                return value
            of = names.get(value[3:])
            if of is None or operations[of]["action"] != "capture":
                raise CallError("invalid_operation")
            needs.append((place, of))
            return prefix + self._reserved(caller, run_id, of)

        out = []
        for n, op in enumerate(operations):
            op = {k: v for k, v in op.items() if k != "op"}
            if "id" in op:
                op["id"] = real(n, op["id"])
            if "old_ids" in op:
                op["old_ids"] = [real(n, x) for x in op["old_ids"]]
            if op["action"] == "capture" and op["record"].get("sources"):
                op["record"] = op["record"] | {"sources": [x | {"uri": real(n, x["uri"], "record:")} for x in op["record"]["sources"]]}
            out.append(op)
        if not needs:
            return out, list(range(len(out)))
        nodes, edges = self.spark.createDataFrame([(n,) for n in range(len(out))], "id int"), self.spark.createDataFrame(needs, "src int, dst int")
        layer = {r["id"]: r["layer"] for r in effects.layers(nodes, edges).collect()}
        if None in layer.values():
            raise CallError("cyclic_reference")
        return out, sorted(layer, key=lambda n: (layer[n], n))

    def dream_publish(self, caller, run_id, expected_revision=None):
        """Applies the draft's operations, those first that others refer to.

        The draft left an intent for each: its target and what that was then. An operation whose target was changed by anyone else since is blocked. What was applied
        has a receipt; a run that breaks off between any two writes goes on where no receipt is, and what was written without one is found by its key.
        """
        row, body = self._run(caller, run_id, writes=True)
        if expected_revision not in (None, row["digest"]):
            raise CallError("stale_revision")
        if row["state"] == "published":
            return {"state": "published", "outcomes": body["outcomes"]}
        if row["state"] != "drafted":
            raise CallError("not_drafted")
        mine = F.col("run_id") == run_id
        intents = {r["place"]: r for r in self.intents.all().where(mine).orderBy("seq").collect()}  # the last draft's
        outcomes = {r["place"]: json.loads(r["outcome"]) for r in self.receipts.all().where(mine).collect()}
        touched: set[str] = set()
        for n in body["order"]:
            op, target = body["operations"][n], intents[n]["target"]
            if n in outcomes:
                touched |= {target} if outcomes[n]["outcome"] == "applied" else set()
                continue
            key, more = self._review_key(caller, run_id, n), {k: v for k, v in op.items() if k not in ("action", "id", "review", "record", "old_ids")}
            try:
                if op["action"] != "capture" and target not in touched and self.events.all().where(F.col("op_key") == key).isEmpty():
                    now = self.current().where(F.col("id") == target).select("revision").first()
                    if (now["revision"] if now else effects.ABSENT) != intents[n]["before"]:
                        raise CallError("changed_target")
                if op["action"] == "capture":
                    got = self._capture(caller, op["record"], op.get("review"), op.get("details"), key, REVIEW_KEYS)
                elif op["action"] in ("approve", "supersede"):
                    got = self._promote(caller, op["id"], op["review"], list(op.get("old_ids", [])), key, op["action"], REVIEW_KEYS)
                elif op["action"] == "withdraw":
                    got = self._withdraw(caller, op["id"], op["review"], key)
                else:
                    got = self._annotate(caller, op["id"], op["review"], key, **more)
                touched.add(target)
                outcomes[n] = {"outcome": "applied", "id": got["id"]}
            except (ValueError, AttributeError, KeyError, TypeError) as e:
                outcomes[n] = {"outcome": "blocked", "reason": str(e) if isinstance(e, CallError) else "invalid_operation"}
            self.receipts.append(self.spark.createDataFrame([(f"{run_id}:{n}", run_id, n, canonical_json(outcomes[n]))], "op_key string, run_id string, place int, outcome string"), "run_id")
        outcomes = [outcomes[n] for n in sorted(outcomes)]
        self._save_run(run_id, row["objective"], row["target"], "published", row["generation"], body | {"outcomes": outcomes})
        return {"state": "published", "outcomes": outcomes}

    def dream_close(self, caller, run_id, accept_gaps=False):
        """Moves the objective's position only if everything was served and no gap is open."""
        row, body = self._run(caller, run_id, writes=True)
        if row["state"] == "closed":
            return {"state": "closed", "position": body["end"]}
        if not self._served(row, body):
            raise CallError("not_reviewed")
        hard = [g for g in body["gaps"] if g["reason"] not in review.PERMANENT_GAPS]
        if body["gaps"] and (hard or not accept_gaps):
            raise CallError("open_gaps")
        self._save_run(run_id, row["objective"], row["target"], "closed", row["generation"], {k: v for k, v in body.items() if k != "operations"})
        return {"state": "closed", "position": body["end"]}

    def dream_takeover(self, caller, run_id):
        row, body = self._run(caller, run_id)
        self._save_run(run_id, row["objective"], row["target"], row["state"], row["generation"] + 1, body | {"owner": caller["session_id"]})
        return {"generation": row["generation"] + 1}

    # ---- dispatch

    def call(self, tool: str, caller: dict, arguments: dict) -> dict:
        """The envelope that every call returns: ok and a result, or an error with a code."""
        if tool not in CALLS:
            return {"ok": False, "tool": tool, "error": {"code": "unknown_tool", "known": sorted(CALLS)}}
        need, may = CALLS[tool]
        if missing := need - set(arguments):
            return {"ok": False, "tool": tool, "error": {"code": "missing_argument", "arguments": sorted(missing)}}
        if odd := set(arguments) - need - may:
            return {"ok": False, "tool": tool, "error": {"code": "unknown_argument", "arguments": sorted(odd)}}
        if any(not isinstance(caller.get(k), str) or not caller[k] for k in ("project_id", "session_id")):
            return {"ok": False, "tool": tool, "error": {"code": "invalid_context"}}
        try:
            return {"ok": True, "tool": tool, "result": getattr(self, tool)(caller, **arguments)}
        except UnicodeError:
            code = "invalid_input"
        except ValueError as e:
            code = str(e)
        except (OSError, AnalysisException):
            code = "source_unavailable"
        except (KeyError, TypeError, AttributeError):
            code = "invalid_input"
        return {"ok": False, "tool": tool, "error": {"code": code}}


def _within(path: str, folder: str) -> bool:
    return path == folder or path.startswith(folder.rstrip("/") + "/")


def usable_closure(records: DataFrame, edges: DataFrame, bad: DataFrame) -> DataFrame:
    """Records that don't rest, over any number of steps of edges(src, dst), on a bad one."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return records.join(graph.reachable(records.sparkSession, back, bad), "id", "left_anti")
