import random
import re
from collections import Counter

import numpy as np
import pytest
from strataline.llm import phrases as ph
from strataline.llm.common import Scratch


def plain(rows, least, longest=5, top=2000):
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                count.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    out = {}
    for (lang, *w), a in count.items():
        if len(w) < 2 or a < least:
            continue
        longer = [n for (o, *v), n in count.items() if o == lang and len(v) > len(w) and n >= least and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * n >= 100 * a for n in longer):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = count[(lang, *w[:k])], count[(lang, *w[k:])]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((score, a, " ".join(w), left, right))
    rows = []
    for lang, found in out.items():
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        rows += [(lang, i + 1, p, a, le, r, total[lang], s) for i, (s, a, p, le, r) in enumerate(found[:top])]
    return sorted(rows)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    stock = ["Grand Total of", "the", "of the", "a a a a a a", "x y z", "one two three four five six", "Ünïcode wörd", "nul\x00l \x1fctl", "𝔘 ÿ ÿÿ"]
    rows = [("".join(rng.choice(stock) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ? ", "\r\n"]) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "en", "fr", None])) for _ in range(60)]
    return rows + rows[:9] + [(None, "en"), ("", "fr"), ("...", None), ("a " * 3000, "hot"), ("ＦＵＬＬ ÀÉ " * 30, "zz")]


def test_equals_plain_loops(spark, texts, monkeypatch):
    docs = spark.createDataFrame(texts, "text string, lang string").repartition(5)
    want = plain(texts, 12)
    assert len({r[0] for r in want}) > 3 and any(r[2].count(" ") > 2 for r in want)
    assert sorted(map(tuple, ph.collocations(docs, 12).collect())) == want
    # few buckets and tiny filters let more through, many rounds and folds share the work out: nothing changes
    for name, value in (("SKETCH_BITS", 6), ("FILTER_BITS", 64), ("HELD", 50)):
        monkeypatch.setattr(ph, name, value)
    assert sorted(map(tuple, ph.collocations(docs, 12, round_bytes=1500).collect())) == want
    assert sorted(map(tuple, ph.collocations(docs, 12, longest=3, top=4).collect())) == plain(texts, 12, 3, 4)


def test_sketched_counts_are_upper_bounds_and_whole(spark, texts, monkeypatch):
    docs = spark.createDataFrame([(t or "", lang or "und") for t, lang in texts], "text string, lang string").repartition(3)
    for bits in (40, 4):
        monkeypatch.setattr(ph, "SKETCH_BITS", bits)
        got = ph.sketch(docs, 1, lambda h, lang: ph.runs(h, lang, 1)[0][0][h != 0], by_lang=True).collect()
        total = {lang: sum(r["n"] for r in got if r["lang"] == lang) for lang in ("en", "hot", "und")}
        assert total["hot"] == 3000 and len(got) <= 5 * 2**bits
    bits = ph.filter_of(spark.createDataFrame([(5,), (70,), (6000,)], "bucket bigint"))
    assert ph.passes(bits, np.array([5, 70, 6000, 7])).tolist() == [True, True, True, False] and not ph.passes(ph.filter_of(spark.createDataFrame([], "bucket bigint")), np.array([1])).any()


def test_exact_beyond_64_bits(spark):
    docs = spark.createDataFrame([("b c " * 40, "en")], "text string, lang string")
    found = ph.counted(docs, spark.createDataFrame([("en", "b c", 2), ("en", "b", 1), ("fr", "b", 1), ("en", "c b c b", 4)], "lang string, phrase string, k int"), Scratch(spark, "t"))
    assert {(r.phrase, r.n) for r in found.collect()} == {("b c", 40), ("b", 40), ("c b c b", 38)}
    big = spark.sql("SELECT CAST((1000 * CAST(a AS decimal(17, 0)) * CAST(n AS decimal(17, 0))) DIV (CAST(l AS decimal(19, 0)) * CAST(r AS decimal(19, 0))) AS bigint) AS s FROM VALUES (30000000007L, 9000000000001L, 40000000000L, 30000000009L) AS t(a, n, l, r)")
    assert big.first().s == 1000 * 30000000007 * 9000000000001 // (40000000000 * 30000000009)


def test_many_phrases_take_one_scan(spark):
    docs = spark.createDataFrame([("a long common beginning 7 " * 3, "en"), ("a long common beginning 7", "fr"), ("a long. common beginning 7", "en")], "text string, lang string")
    many = spark.range(250_000).selectExpr("'en' AS lang", "concat('a long common beginning ', id) AS phrase", "5 AS k")
    scratch = Scratch(spark, "t")
    found = ph.counted(docs, many, scratch)
    assert [(r.phrase, r.n) for r in found.collect()] == [("a long common beginning 7", 3)]
    assert sum(t._scratch_path.endswith("-parts") for t in scratch.made) == 1


def test_odd_tables(spark, odd, empty, docs, corpus):
    assert ph.collocations(empty).collect() == [] and ph.collocations(odd, 1).count() == len(plain([(r.text, r.lang) for r in odd.collect()], 1))
    nothing = spark.createDataFrame([(None, None), ("", "en"), ("single", "en")], "text string, lang string")
    assert ph.collocations(nothing, 1).collect() == []
    rows = [(t, lang) for _, t, lang, *_ in corpus]
    assert sorted(map(tuple, ph.collocations(docs, 6, longest=3).collect())) == plain(rows, 6, 3)
