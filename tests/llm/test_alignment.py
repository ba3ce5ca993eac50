import base64
import random
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import accumulate

import pytest
from strataline.llm import alignment as al

FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_best", "count_sum", "groups"]


@pytest.fixture(scope="module")
def public():
    """Both tokenizers by other means: A from its JSON file, with the bytes of its entries decoded here."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{al.TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    a_bytes = {i: bytes(back[c] for c in w) for w, i in a.get_vocab().items() if w != "<|endoftext|>"}
    return a, a_bytes, sentencepiece.SentencePieceProcessor(model_file=f"{al.TOKENIZERS}/piece_bpe_32k.model")


def plain(public, texts):
    """Ends of tokens as sets of byte offsets, links and overlaps one by one."""
    a, a_bytes, b = public
    rows, count = [], Counter()
    for t in texts:
        ia = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ib = b.encode(t) if t else []
        ba = [a_bytes[i] for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not t or b"".join(ba) != b" " + t.encode() or b"".join(bb) != b" " + t.encode():
            ia = ib = ba = bb = []
        ea, eb = list(accumulate(map(len, ba))), list(accumulate(map(len, bb)))
        both = sorted(set(ea) & set(eb))
        links = [(ia[ea.index(e)], ib[eb.index(e)]) for e in both]
        overlaps = sum(max(x - len(p), y - len(q)) < min(x, y) for x, p in zip(ea, ba) for y, q in zip(eb, bb)) if len(ea) < 300 else None
        groups, low = [], 0
        for e in both:
            groups.append(",".join(str(i) for i, x in zip(ia, ea) if low < x <= e) + "|" + ",".join(str(i) for i, x in zip(ib, eb) if low < x <= e))
            low = e
        count.update(links)
        rows.append((len(ia), len(ib), len(both), links, overlaps, ";".join(groups)))
    top = defaultdict(int)
    for (x, y), n in count.items():
        top[y] = max(top[y], n)
    return [(p, q, g, len(k), o, sum(count[i] == top[i[1]] for i in k), sum(count[i] for i in k), s) for p, q, g, k, o, s in rows]


ODD = [
    None, "", " ", "  two  spaces ", "a▁b", "nul\x00l", "<|endoftext|> and <s> </s> <unk> <0x41>", "naïve Straße 𝔘 日本語 ہیلو", "line\r\n\tbreak\x85 ‍ end",
    "ﬁ １２ İ", "🙂🙃👩‍👩‍👧", "!!!???...", "a" * 700, "\n\n\n", "it's we'll I'd", "x﻿y", "12345678901234567890", "\x1f\x7f\x80",
]


def test_equals_plain_loops(spark, public, corpus):
    rng = random.Random(2)
    texts = ODD + [r[1] for r in corpus if not r[1] or len(r[1]) < 2000] + ["".join(rng.choices("ab é\n日1,", k=60)) for _ in range(40)]
    texts += texts[-8:]
    rows = [(i, t) for i, t in enumerate(texts)]
    for partitions in (1, 5):
        got = {r["doc_id"]: r for r in al.alignment(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(partitions)).collect()}
        assert len(got) == len(texts)
        for i, want in enumerate(plain(public, texts)):
            have = tuple(got[i][c] for c in FIELDS)
            want = want if want[4] is not None else (*want[:4], have[4], *want[5:])
            assert have == want, texts[i]
        assert got[4]["n_a"] == 0 and got[0]["groups"] == ""  # a text with U+2581 isn't kept by B


def test_ranks_are_the_vocabulary_of_the_json_file(public):
    a, a_bytes, _ = public
    with open(f"{al.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as file:
        assert {int(r): base64.b64decode(w) for w, r in map(bytes.split, file)} == a_bytes
    v, rng = al.vocabularies(al.TOKENIZERS), random.Random(4)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(chr(c) + rng.choice([" ", "a", "1", "'s", "", "\n"]) for c in rng.choices(points, k=400)) for _ in range(30)]
    assert [v.a.encode_ordinary(t) for t in texts] == [e.ids for e in a.encode_batch(texts, add_special_tokens=False)]


def test_odd_tables_and_digests(spark, odd, empty, docs, corpus):
    assert al.alignment(empty).collect() == [] and al.alignment(odd).count() == odd.count()
    nulls = spark.createDataFrame([(1, None), (None, "")], "doc_id bigint, text string")
    assert {tuple(r)[1:] for r in al.alignment(nulls, digests=True).collect()} == {(0, 0, 0, 0, "", 0, 0, 0)}
    full, short = ({r["doc_id"]: r for r in al.alignment(docs, digests=d).collect()} for d in (False, True))
    assert len(full) == len(corpus)
    for i, r in full.items():
        assert short[i]["groups_sha256"] == (sha256(r["groups"].encode()).hexdigest() if r["groups"] else "")
        assert r["n_groups"] == r["n_links"] == (r["groups"].count(";") + 1 if r["groups"] else 0) and r["n_best"] <= r["n_links"]
    assert max(r["n_a"] for r in full.values()) > 20_000


def test_folding_of_counts_does_not_change_them(spark, monkeypatch):
    rows = [([1, 2, 3], [1, 1, 5]), ([2, 3], [4, 4]), ([], []), ([1], [7])]
    links = spark.createDataFrame(rows, "pairs array<int>, times array<int>").coalesce(1)
    monkeypatch.setattr(al, "HELD", 1)
    assert {tuple(r) for r in al.pair_counts(links).collect()} == {(1, 8), (2, 5), (3, 9)}
