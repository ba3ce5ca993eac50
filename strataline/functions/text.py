"""Text functions as Column expressions; exact Unicode variants as vectorised UDFs."""

from __future__ import annotations

import json
import re
import unicodedata
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that no query term or document term can be.
STOP_WORDS = (
    "a an and are as at be been by can did do does for from had has have how i if in into is it its me my of on or our "
    "should so that the their then there these this to was we were what when where which who why with would you your"
).split()

# A run of CJK ideographs, or letters and digits with inner joiners.
TOKEN_PATTERN = r"[\x{3400}-\x{9fff}]+|[\p{L}\p{N}]+(?:[_./:-][\p{L}\p{N}]+)*"
CJK_RUN = r"^[\x{3400}-\x{9fff}]+$"
JOINERS = r"[_./:-]+"

# Classes of secrets by name, in the order in which they are looked for.
SECRET_CLASSES = (
    ("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("openai-key", r"\bsk-[A-Za-z0-9_-]{20,}"),
    ("aws-access-key", r"\bAKIA[A-Z0-9]{16}\b"),
    ("github-token", r"\b(?:ghp_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,})"),
    ("slack-token", r"\bxox[abp]-[A-Za-z0-9-]{10,}"),
    ("google-api-key", r"\bAIza[0-9A-Za-z_-]{35}"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("bearer-token", r"\bBearer\s+[A-Za-z0-9._~+/-]{20,}=*"),
)
# Fixed value: what readers of transcripts leave out.
READER_SECRET = r"-----BEGIN [A-Z ]*PRIVATE KEY-----|\b(?:sk-[A-Za-z0-9_-]{20,}|AKIA[A-Z0-9]{16})\b"
# Wrappers that a host puts around what is no part of a conversation.
WRAPPER_TAGS = ("system-reminder", "environment_context", "user_instructions", "local-command-stdout", "local-command-stderr", "command-name", "command-message", "command-args")
REDACTED = "[REDACTED]"


#: All white space, as str.strip() knows it.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def stripped(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.trim(text, F.lit(WHITE))


def folded(text: Column) -> Column:
    """NFKC and full case folding, as ``unicodedata.normalize("NFKC", x).casefold()`` has it.

    Texts that aren't ASCII go to the Unicode library that Spark brings along, inside the JVM; ASCII ones to the built-in.
    """
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    full = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).when(text.isNotNull(), full)


def normalized(text: Column) -> Column:
    """NFKC, case-folded, and without white space at its ends."""
    return stripped(folded(text))


@F.pandas_udf(StringType())
def normalized_exact(text: pd.Series) -> pd.Series:
    """NFKC, case-folded, trimmed."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold().strip())


def words(folded: Column) -> Column:
    """Runs of CJK, and other words with their compounds whole, of an already normalized text."""
    return F.regexp_extract_all(folded, F.lit(TOKEN_PATTERN), F.lit(0))


def is_plain(word: Column) -> Column:
    """Neither a compound nor CJK: one token at most."""
    return ~word.rlike(r"[_./:\x{3400}-\x{9fff}-]")


def word_tokens(word: Column) -> Column:
    """The tokens of one word of ``words``; the costly cases are only evaluated for words that need them.

    A CJK run of up to 16 characters is a token, and so is each pair in a run of over two. Any other word is
    a token unless it is a stop word; a compound also yields its parts.
    """
    none = F.array().cast("array<string>")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word) - 1)), lambda i: F.substr(word, i, F.lit(2)))
    cjk = F.concat(F.when(F.length(word) <= 16, F.array(word)).otherwise(none), F.when(F.length(word) > 2, pairs).otherwise(none))
    parts = F.split(word, JOINERS)
    compound = F.filter(F.concat(F.array(word), F.when(F.size(parts) > 1, parts).otherwise(none)), lambda p: (p != "") & ~p.isin(*STOP_WORDS))
    return F.when(is_plain(word), F.when(word.isin(*STOP_WORDS), none).otherwise(F.array(word))).when(word.rlike(CJK_RUN), cjk).otherwise(compound)


def tokens(text: Column) -> Column:
    """Search tokens of a text, in order and with repeats, as one array: for short texts (queries, titles)."""
    return F.flatten(F.transform(words(normalized(F.coalesce(text, F.lit("")))), word_tokens))


def explode_tokens(rows: DataFrame, text: Column, keep: list[str], name: str = "token", distinct: bool = False) -> DataFrame:
    """A row for each token of long texts: exploded words run through compiled code, unlike a lambda over an array."""
    found = words(normalized(F.coalesce(text, F.lit(""))))
    each = rows.select(*keep, F.explode(F.array_distinct(found) if distinct else found).alias("__w"))
    return each.select(*keep, F.explode(word_tokens(F.col("__w"))).alias(name))


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, if a table of a few files gives less partitions than there are.

    Plans that shuffle anyway are left alone (counting their partitions would run them).
    """
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    if re.search(r"\b(Join|Aggregate|Window|Sort|Repartition\w*|GlobalLimit|Union)\b", plan):
        return rows
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n) if rows.rdd.getNumPartitions() < n else rows


def secret_classes(text: Column) -> Column:
    """Names of the classes of secrets that a text holds, as listed."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in SECRET_CLASSES]), lambda x: x.isNotNull())


def redact(text: Column) -> Column:
    """Without wrappers, and with every secret replaced."""
    out = F.regexp_replace(text, rf"(?s)<({'|'.join(WRAPPER_TAGS)})>.*?</\1>", "")
    out = F.regexp_replace(out, READER_SECRET, REDACTED)
    for _, p in SECRET_CLASSES:
        out = F.regexp_replace(out, p, REDACTED)
    return stripped(out)


def semantic_body(body: Column) -> Column:
    """Without the digests in "Sources: " lines; such a line goes if nothing else is in it."""
    digest = r"^[0-9a-fA-F]{64}$"

    def line(x):
        refs = F.transform(F.split(F.substr(x, F.lit(10)), ","), stripped)
        named = F.filter(refs, lambda r: ~r.rlike(digest))
        tidy = F.when(F.size(named) == F.size(refs), x).when(F.size(named) > 0, F.concat(F.lit("Sources: "), F.array_join(named, ", ")))
        return F.when(x.startswith("Sources: "), tidy).otherwise(x)

    return F.array_join(F.filter(F.transform(F.split(body, r"\r\n|\r|\n"), line), lambda x: x.isNotNull()), "\n")


def content_text(content: Column) -> Column:
    """Text of message parts array<struct<type,text>>: those of a text type, one a line."""
    said = F.filter(content, lambda p: p["type"].isin("text", "input_text", "output_text"))
    return F.array_join(F.transform(said, lambda p: p["text"]), "\n")


def canonical_json(value) -> str:
    """Keys sorted, no spaces, text as it is, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


@F.pandas_udf(StringType())
def canonical_digest(texts: pd.Series) -> pd.Series:
    """SHA-256 of the canonical form of JSON texts; null where a text is no JSON, repeats a key or holds NaN."""

    def one(text):
        try:
            return sha256(canonical_json(strict_json(text)).encode()).hexdigest()
        except (TypeError, ValueError):
            return None

    return texts.map(one)


def strict_json(text: str):
    """JSON without repeated keys, NaN or infinities."""

    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise ValueError("a key is repeated")
        return dict(items)

    def constant(name):
        raise ValueError(f"{name} is no JSON number")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)


def volatile_path(uri: Column) -> Column:
    """Whether a file URI names a temporary path."""
    path = F.regexp_replace(uri, r"^file://(localhost)?", "")
    return uri.startswith("file:") & path.rlike(r"^/tmp(/|$)|^/var/tmp(/|$)|(^|/)\.tmp")


def source_key(uri: Column) -> Column:
    """A file URI in one form: no host, percent signs decoded; other URIs as they are."""
    return F.when(uri.rlike(r"^(git\+)?file:"), F.coalesce(F.try_url_decode(F.regexp_replace(F.regexp_replace(uri, r"^((?:git\+)?file:)//localhost/", "$1///"), r"\+", "%2B")), uri)).otherwise(uri)


def backoff_seconds(attempts: Column, base: int = 3600, most: int = 86400) -> Column:
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(attempts, F.lit(1)) - 1)).cast("bigint")


def worktree_id(root: Column) -> Column:
    return F.substring(F.sha2(root, 256), 1, 24)


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"[^a-z0-9._-]+", "-"), F.lit("-"))
