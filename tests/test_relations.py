from pyspark.sql import functions as F

from strataline.operators import access, graph, lifecycle, preferences, report, review, views


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_visibility(spark):
    rows = [("1", "p", "project", None, None), ("2", "p", "worktree", "w", None), ("3", "p", "worktree", "v", None), ("4", "p", "task", "w", "t"), ("5", "p", "task", "w", "u"), ("6", "q", "project", None, None)]
    df = spark.createDataFrame(rows, "id string, project_id string, scope string, worktree_id string, task_id string")
    assert ids(df.where(access.visible("p", "w", "t"))) == ["1", "2", "4"] and ids(df.where(access.visible("p", None, None))) == ["1"]


def test_roots(spark):
    roots = spark.createDataFrame([("/a", "A"), ("/a/b", "B"), ("/c/", "C"), ("/c", "D")], "root string, id string")
    paths = spark.createDataFrame([("/a/b/x",), ("/a/bc",), ("/c/y",), ("/z",)], "path string")
    got = {r.path: (r.project_id, r.ambiguous) for r in access.resolve_roots(paths, roots).collect()}
    assert got == {"/a/b/x": ("B", False), "/a/bc": ("A", False), "/c/y": (None, True), "/z": (None, False)}


def test_sharing_needs_both_sides(spark):
    df = spark.createDataFrame([("1", "p", "d", []), ("2", "q", "d", ["p"]), ("3", "q", "e", ["p"]), ("4", "q", "d", []), ("5", "r", "d", ["p"])], "id string, project_id string, domain string, share_with array<string>")
    edges = spark.createDataFrame([("q", "p", "d")], "from string, to string, domain string")
    assert ids(access.with_imports(df, edges, "p")) == ["1", "2"]


def test_routes(spark):
    topics = spark.createDataFrame([("t1", "Release flow", ["ship it", "发布"], ["changelog"]), ("t2", "Other", [], ["x"])], "topic_id string, title string, aliases array<string>, search_terms array<string>")
    q = spark.createDataFrame([(1, "how do we ship it now"), (2, "新的发布流程"), (3, "unknown paraphrase"), (4, "the changelog of a release flow"), (5, " ")], "query_id int, query string")
    got = {r.query_id: (r.topic_id, r.expansion) for r in access.route_matches(q, topics).collect()}
    assert got == {1: ("t1", ["changelog"]), 2: ("t1", ["changelog"]), 4: ("t1", [])}


def test_chains(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "missing"), ("e", "d"), ("x", "y"), ("y", "x")], "id string, parent string")
    got = {r.id: (r.root, r.depth if r.status == "complete" else None, r.status) for r in graph.chain_roots(df).collect()}
    assert got == {"a": ("a", 0, "complete"), "b": ("a", 1, "complete"), "c": ("a", 2, "complete"), "d": (None, None, "broken"), "e": (None, None, "broken"), "x": (None, None, "cycle"), "y": (None, None, "cycle")}


def test_reach_and_related(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")], "src string, dst string")
    assert ids(graph.reachable(spark, edges, spark.createDataFrame([("a",)], "id string"))) == ["a", "b", "c"]
    r = spark.createDataFrame([("1", [("supports", "record:2"), ("supports", "record:9")]), ("2", []), ("3", [("refutes", "record:1")])], "id string, relations array<struct<type:string,uri:string>>")
    assert sorted((x.id, x.direction) for x in graph.related(r, spark.createDataFrame([("1",)], "id string")).collect()) == [("2", "out"), ("3", "in")]
    assert ids(graph.missing_related(r), "missing") == ["9"]


def test_journal_and_edges(spark):
    e = spark.createDataFrame([("r", 1, "d1", "start"), ("r", 2, "d2", "d1"), ("r", 3, "d3", "dX")], "k string, seq int, digest string, previous string")
    assert ids(lifecycle.chain_breaks(e, "k", "seq", F.col("digest")), "seq") == [3]
    r = spark.createDataFrame([("1", "q", "active", ["2", "3", "4"]), ("2", "q", "candidate", []), ("3", "z", "active", []), ("5", "q", "active", ["2"])], "id string, scope string, status string, supersedes array<string>")
    assert sorted((x.old, x.reason) for x in lifecycle.edge_violations(r, ["scope"]).where("id = '1'").collect()) == [("2", "not-active"), ("3", "qualifier"), ("4", "missing")]
    assert ids(lifecycle.many_successors(r), "old") == ["2"]


def test_positions(spark):
    e = spark.createDataFrame([("s", 1, 10, "reviewed"), ("s", 2, 20, "incomplete"), ("s", 3, 5, "reviewed"), ("t", 1, 7, "incomplete")], "source_id string, ord int, reviewed_offset bigint, status string")
    assert {r.source_id: (r.reviewed_offset, r.status) for r in review.merge_positions(e).collect()} == {"s": (5, "reviewed"), "t": (7, "incomplete")}
    p = spark.createDataFrame([("a", 0, 10, "new"), ("b", 0, 10, "new"), ("c", 3, 10, "incomplete")], "source_id string, reviewed_offset bigint, cutoff bigint, status string")
    done = spark.createDataFrame([("a", 10, 2, 2, 0), ("b", 10, 2, 2, 1)], "source_id string, end_offset bigint, n_events int, n_reviewed int, n_open_gaps int")
    once = review.commit_positions(p, done)
    got = {r.source_id: (r.reviewed_offset, r.status) for r in once.collect()}
    assert got == {"a": (10, "reviewed"), "b": (0, "stalled"), "c": (3, "incomplete")}
    assert {r.source_id: (r.reviewed_offset, r.status) for r in review.commit_positions(once, done).collect()} == got


def test_reports(spark):
    df = spark.createDataFrame([("a", "x", "2024-01-01"), ("b", "x", "2024-02-01"), (None, "y", "2023-12-31")], "kind string, status string, at string").withColumn("at", F.to_timestamp("at"))
    got = {(r.dimension, r.value): (r.n, r.n_created) for r in report.lifecycle_report(df, ["kind", "status"], F.col("at"), "2024-01-01", "2024-02-01").collect()}
    assert got[("all", "all")] == (3, 1) and got[("status", "x")] == (2, 1) and got[("kind", "(null)")] == (1, 0)
    a, b = (report.multiset_fingerprint(df.orderBy(c), ["status"], F.col("kind")).collect() for c in ("kind", "at"))
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)


def test_views(spark):
    r = spark.createDataFrame([("1", "q", []), ("2", "q", ["record:1"]), ("3", "z", ["record:2"])], "id string, scope string, replaces array<string>")
    assert ids(views.replaced(r, ["scope"]).where("is_replaced")) == ["1"]
    u = spark.createDataFrame([("v", "1", "n1", "q", []), ("v", "2", "n2", "q", ["record:c2"]), ("v", "3", "n3", "q", [])], "view string, unit string, narrative_id string, scope string, cites array<string>")
    c = spark.createDataFrame([("c1", "view:v#1", "q"), ("c2", "narrative:n2", "q"), ("c3", "view:v#3", "z")], "id string, ref string, scope string")
    assert ids(views.shown_units(u, c, ["scope"]), "unit") == ["2", "3"]
    b = spark.createDataFrame([("v", "1", [("s", "d")]), ("v", "2", [("s", "old")]), ("v", "3", [("gone", "d"), ("s", "old")]), ("v", "4", [])], "view string, unit string, bindings array<struct<source_id:string,digest:string>>")
    s = spark.createDataFrame([("s", "d")], "source_id string, digest string")
    assert {x.unit: x.label for x in views.freshness(b, s).collect()} == {"1": "as-of", "2": "needs-check", "3": "unavailable", "4": "not-rechecked"}
    f = spark.createDataFrame([("f", "zero\none deploy\ntwo\nthree\nfour deploy api\nfive\nsix")], "path string, text string")
    assert [x.line for x in views.excerpt(f, ["deploy", "api"], 1).orderBy("line").collect()] == [4, 5, 6]
    p = views.bound_profiles(spark.createDataFrame([("p",), ("q",)], "project_id string"), spark.createDataFrame([("a", "p", True), ("b", None, True), ("c", None, False)], "profile string, project_id string, eligible boolean"))
    assert {x.project_id: x.profile for x in p.collect()} == {"p": "a", "q": "b"}


def test_preferences(spark):
    e = spark.createDataFrame([("a", 1, "candidate", None), ("a", 2, "active", None), ("a", 3, None, True), ("b", 1, "active", None), ("c", 1, "candidate", None), ("c", 2, "active", True), ("c", 3, "withdrawn", None)], "record_id string, seq int, state string, retired boolean")
    assert {r.record_id: (r.state, r.retired) for r in preferences.fold(e).collect()} == {"a": ("active", True), "b": ("active", False), "c": ("withdrawn", True)}
    assert [(r.record_id, r.before) for r in preferences.illegal_transitions(e).collect()] == [("b", "start")]
    p = spark.createDataFrame([("1", "active", [], [], []), ("2", "active", ["m"], ["p"], []), ("3", "active", ["n"], [], []), ("4", "withdrawn", [], [], [])], "id string, state string, task_modes array<string>, projects array<string>, scenarios array<string>")
    assert ids(preferences.applicable(p, "m", "p")) == ["1", "2"] and ids(preferences.applicable(p, None)) == ["1", "2", "3"]
    c = spark.createDataFrame([("t", "x", "c", ["e1", "e2"], [])], "topic string, text string, conditions string, exceptions array<string>, counterevidence array<string>")
    assert c.select(preferences.rendered().alias("r")).first()["r"] == "t: x\nWhen: c\nExcept: e1; e2"


def test_long_chains_are_no_cycles(spark):
    from strataline.operators import graph

    rows = [(str(i), str(i - 1) if i else None) for i in range(40_000)] + [("x", "y"), ("y", "x"), ("z", "gone")]
    got = graph.chain_roots(spark.createDataFrame(rows, "id string, parent string")).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in got} == {"complete": 40_000, "cycle": 2, "broken": 1}
