import math

import pytest
from pyspark.sql import functions as F

from strataline.operators import rank

ROWS = [("1", "Deploy guide", "how to deploy deploy the api", "p"), ("2", "Other", "deploy once", "p"), ("3", "Nothing", "unrelated words", "p"), ("4", None, None, "p")]


def test_scores(spark):
    df = spark.createDataFrame(ROWS, "id string, title string, body string, project_id string")
    got = {r.id: r for r in rank.bm25(df, ["deploy", "api"], {"title": F.col("title"), "body": F.col("body")}).collect()}
    title, body = [["deploy", "guide"], ["other"], ["nothing"], []], [["deploy", "deploy", "api"], ["deploy", "once"], ["unrelated", "words"], []]
    body[0] = ["deploy", "deploy", "api"]
    df_ = {"deploy": 2, "api": 1}
    for k in (0, 1):
        want = 0.0
        for w, f in ((4.0, title), (1.0, body)):
            avg = max(1.0, sum(map(len, f)) / 4)
            for t in df_:
                tf = f[k].count(t)
                want += w * math.log1p((4 - df_[t] + 0.5) / (df_[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(f[k]) / avg)) if tf else 0
        assert math.isclose(got[str(k + 1)].score, want, rel_tol=1e-12)
    assert set(got) == {"1", "2"} and got["1"].hit_fields == ["body", "title"] and got["1"].hit_terms == ["api", "deploy"]
    assert rank.bm25(df, [], {"body": F.col("body")}).count() == 0


def test_bonus_boost_and_mode(spark):
    df = spark.createDataFrame([("1", "How To Deploy", 1.0, "en", ["a"]), ("2", "x", 1.0, "de", ["b"])], "id string, title string, score double, domain string, modes array<string>")
    got = {r.id: r.score for r in rank.mode_boosted(rank.boosted(df, "to deploy", F.col("title"), F.col("domain"), "en"), F.col("modes"), "b").collect()}
    assert got["1"] == pytest.approx(3.45) and got["2"] == pytest.approx(1.15)


def test_page_is_a_bounded_top_k(spark, capsys):
    df = spark.range(1000).select((F.col("id") % 7).alias("score"), F.col("id"))
    page = rank.page(df, [F.desc("score"), F.asc("id")], 3, 2)
    assert [(r["rank"], r.id) for r in page.orderBy("rank").collect()] == [(3, 20), (4, 27), (5, 34)]
    page.explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out
