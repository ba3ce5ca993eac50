import unicodedata

from pyspark.sql import functions as F

from strataline.functions import text as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_tokens(spark):
    cases = {
        "The deploy of src/main.py, e.g. v2.1!": ["deploy", "src/main.py", "src", "main", "py", "e.g", "e", "g", "v2.1", "v2", "1"],
        "记忆 检索系统": ["记忆", "检索系统", "检索", "索系", "系统"], "abc中文": ["abc中文"], "": [], "the a of": [], "a--b": ["b"], "Straße": ["strasse"], None: [],
        "一" * 17: ["一一"] * 16,
    }
    for text, want in cases.items():
        assert one(spark, T.tokens, text) == want, text


def test_exploded_tokens_are_the_same(spark):
    df = spark.createDataFrame([(1, "The deploy of src/main.py 检索系统"), (2, ""), (3, None)], "id int, t string")
    want = {r.id: r.x for r in df.select("id", T.tokens(F.col("t")).alias("x")).collect()}
    got = {}
    for r in T.explode_tokens(df, F.col("t"), ["id"]).collect():
        got.setdefault(r.id, []).append(r.token)
    assert got == {k: v for k, v in want.items() if v}


def test_exact_normalization(spark):
    text = "  ﬁn Ｆｕｌｌ ẞ "
    assert one(spark, T.normalized_exact, text) == unicodedata.normalize("NFKC", text).casefold().strip()


def test_secrets_and_redaction(spark):
    samples = {
        "private-key": "-----BEGIN RSA PRIVATE KEY-----", "openai-key": "sk-" + "a" * 20, "aws-access-key": "AKIA" + "A1" * 8, "github-token": "ghp_" + "b" * 30, "slack-token": "xoxb-" + "1" * 10,
        "google-api-key": "AIza" + "c" * 35, "jwt": "eyJ" + "a" * 8 + ".eyJ" + "b" * 8 + "." + "c" * 8, "bearer-token": "Bearer " + "d" * 20,
    }
    for name, text in samples.items():
        assert one(spark, T.secret_classes, f"x {text} y") == [name]
        assert one(spark, T.redact, f"x {text} y") == "x [REDACTED] y"
    assert one(spark, T.redact, "a <system-reminder>b\nc</system-reminder> d") == "a  d"


def test_body_uris_and_digests(spark):
    digest = "a" * 64
    assert one(spark, T.semantic_body, f"one\nSources: {digest}, notes/x\nSources: {digest}\nSources: a,b") == "one\nSources: notes/x\nSources: a,b"
    assert one(spark, T.source_key, "file://localhost/a%20b+c") == "file:///a b+c"
    assert one(spark, T.volatile_path, "file:///var/tmp/x") and not one(spark, T.volatile_path, "file:///home/tmp.txt")
    assert one(spark, T.canonical_digest, '{"b":1,"a":[2]}') == one(spark, T.canonical_digest, '{"a":[2], "b":1}')
    assert one(spark, T.canonical_digest, '{"a":1,"a":2}') is None and one(spark, T.canonical_digest, '{"a":NaN}') is None
    assert spark.range(1, 9).select(T.backoff_seconds(F.col("id")).alias("s")).agg(F.collect_list("s")).first()[0] == [3600, 7200, 14400, 28800, 57600, 86400, 86400, 86400]


def test_white_space_of_any_kind_is_stripped(spark):
    from pyspark.sql import functions as F

    from strataline.functions import text

    digest = "ab" * 32
    df = spark.createDataFrame([("\t Ab\u00a0\u3000\r\n", f"x\r\nSources: {digest}, file:///a\t\r\nSources: {digest}\r\ny")], "t string, b string")
    got = df.select(text.normalized(F.col("t")).alias("n"), text.normalized_exact(F.col("t")).alias("e"), text.redact(F.col("t")).alias("r"), text.semantic_body(F.col("b")).alias("s")).first()
    assert got.n == got.e == "ab" and got.r == "Ab" and got.s == "x\nSources: file:///a\ny"


def test_normalized_is_exact_for_all_code_points(spark):
    points = [c for c in range(1, 0x110000, 7) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    texts = [f" a{chr(c)}B\t" for c in points] + ["ﬁle ＡＢＣ", "Straße ẞ İ ǅ", "e\u0301 \u212b Å", "", "　", "ASCII Only ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.normalized(F.col("t")).alias("n"), T.tokens(F.col("t")).alias("k")).collect():
        assert r.n == (None if r.t is None else unicodedata.normalize("NFKC", r.t).casefold().strip()), r.t
    got = {r.t: r.k for r in df.select("t", T.tokens(F.col("t")).alias("k")).collect()}
    assert got["ﬁle ＡＢＣ"] == ["file", "abc"] and got["Straße ẞ İ ǅ"][:2] == ["strasse", "ss"]
