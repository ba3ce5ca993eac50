import re

import pytest

from strataline.llm import decontaminate


def tokens(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, bench, size=10):
    out = {}
    for i, t in docs:
        w, hit, items = tokens(t), set(), set()
        for item, b in bench:
            b = tokens(b)
            for s in range(max(1, len(b) - size + 1)) if b else ():
                win = b[s : s + size]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        items.add(str(item) if item is not None else "")
        out[i] = (len(w), len(hit), sorted(items))
    return out


BENCH = [(1, "the cat sat on the mat and then it ran far away"), (2, "short item"), (3, "of. of, OF of of of of of of of of of"), (4, None), (5, "..."), (None, "École é über straße"), (1, "the cat sat on the mat and then it ran far away")]
DOCS = [
    (0, "x The CAT sat on the mat, and then it ran far away y"), (1, "the cat sat on the mat and then it ran"), (2, "the cat sat on the mat and then it"), (3, "a short item, short item!"),
    (4, "of " * 30), (5, None), (6, ""), (7, "école é über Straße"), (8, "École é über Straße"), (9, "the cat sat on the mat and then it ran far away " * 3),
]


@pytest.mark.parametrize("most", [200_000, 0])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", most)
    docs, bench = spark.createDataFrame(DOCS, "doc_id bigint, text string"), spark.createDataFrame(BENCH, "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == brute(DOCS, BENCH)


def test_odd_rows_and_empty(spark, odd, empty):
    bench = spark.createDataFrame([(1, "one two three", "e")], "item_id bigint, text string, w string")
    got = decontaminate.contamination(odd, bench)
    assert got.count() == 5 and sorted(r.n_hit for r in got.collect()) == [0, 0, 3, 3, 3]
    assert set(odd.columns) <= set(got.columns)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(odd, bench.limit(0)).where("contaminated").count() == 0


def test_plan_has_no_python(spark, capsys):
    docs, bench = spark.createDataFrame(DOCS, "doc_id bigint, text string"), spark.createDataFrame(BENCH, "item_id bigint, text string")
    decontaminate.contamination(docs, bench).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
