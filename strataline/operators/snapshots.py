"""Snapshots that can be verified: digests of folders rolled up from files, and content-addressed shards with a manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import kept
from .scan import running


def set_digest(entry: Column) -> Column:
    """An aggregate: the digest of a multiset of texts, whatever their order. Four parts of each text's SHA-256 are added up, so tasks add first."""
    parts = [F.sum(F.conv(F.substring(F.sha2(entry, 256), 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *parts), 256)


def folder_digests(files: DataFrame) -> DataFrame:
    """path, kind ('file' or 'folder'), digest, n of files(path, digest) and of all folders above them, '' being the root.

    A folder's digest is that of the set of its children's names and digests; it is null (and so is every folder's above it) if one of them is, as of a file
    that couldn't be read. Folders are rolled up from the deepest ones: one aggregate a level, in which no folder's children meet in a list.
    """
    depth = F.size(F.split("path", "/"))
    now = kept(files.select("path", F.lit("file").alias("kind"), "digest", F.lit(1).cast("bigint").alias("n"), depth.alias("depth")))
    done, level = [now], now.agg(F.max("depth")).first()[0] or 0
    folders = None
    while level > 0:
        here = now.where(F.col("depth") == level)
        here = here if folders is None else here.unionByName(folders)
        up = F.when(F.lit(level) > 1, F.array_join(F.slice(F.split("path", "/"), 1, level - 1), "/")).otherwise("")
        name = F.concat_ws("\x1f", "kind", F.element_at(F.split("path", "/"), -1), "digest")
        folders = kept(here.groupBy(up.alias("path")).agg(F.when(F.bool_and(F.col("digest").isNotNull()), set_digest(name)).alias("digest"), F.sum("n").alias("n")).select("path", F.lit("folder").alias("kind"), "digest", "n", F.lit(level - 1).alias("depth")))
        done.append(folders)
        level -= 1
    return reduce(DataFrame.unionByName, done).drop("depth")


def snapshot_state(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, kind, state, deepest of all paths that are not 'valid' any more, given two results of ``folder_digests``.

    state: 'stale' (another digest), 'added', 'removed', or 'unverifiable' (no digest now, or none then). deepest: no path below explains it, so
    these are the places to look at; the root is in the result exactly if the snapshot as a whole is not valid.
    """
    new = after.select(F.col("path").alias("p"), F.col("kind").alias("k"), F.col("digest").alias("d"), F.lit(True).alias("now"))
    both = before.withColumn("then", F.lit(True)).join(new, (F.col("path") == F.col("p")) & (F.col("kind") == F.col("k")), "full_outer")
    state = (
        F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("d").isNull() | F.col("digest").isNull(), "unverifiable")
        .when(F.col("d") != F.col("digest"), "stale")
    )
    odd = kept(both.select(F.coalesce("path", "p").alias("path"), F.coalesce("kind", "k").alias("kind"), state.alias("state")).where("state IS NOT NULL"))
    above = odd.where("path <> ''").select(F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("").alias("up")).distinct()
    return odd.join(above, (F.col("path") == F.col("up")) & (F.col("kind") == "folder"), "left").select("path", "kind", "state", F.col("up").isNull().alias("deepest"))


def shards(items: DataFrame, key: str, order: str, text: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(manifest, shards) of items(key, order, text): the texts of a key in order, one a line, cut into shards of about ``most`` bytes.

    A shard holds the lines that begin in its stretch of bytes, so none is longer than ``most`` and a line. shards: digest, body, one row for each different
    body; manifest: key, place, digest, n, bytes. ``order`` is a whole number, no two items of a key share it; no text holds a line break.
    """
    size = (F.octet_length(text) + 1).cast("bigint")
    rows = running(items.select(key, order, text), [key], [order], {"__end": ("sum", size)})
    rows = rows.withColumn("place", F.floor((F.col("__end") - size) / most))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), "\n")  # ``most`` bytes and a line
    made = kept(rows.groupBy(key, "place").agg(body.alias("body"), F.count("*").alias("n"), F.sum(size).alias("bytes")).withColumn("digest", F.sha2("body", 256)))
    return made.select(key, "place", "digest", "n", "bytes"), made.select("digest", "body").dropDuplicates(["digest"])


def shard_errors(manifest: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """key, place, digest, reason of what a store of shards(digest, body) lacks of a manifest: 'lost', 'altered' (its body has another digest), 'repeated' (several
    rows of a digest), or with a null key 'stray' (in no manifest). Bodies are hashed where they lie; only digests are joined."""
    have = stored.select("digest", (F.sha2("body", 256) == F.col("digest")).alias("good")).groupBy(F.col("digest").alias("d")).agg(F.count("*").alias("copies"), F.bool_and("good").alias("good"))
    both = manifest.select(key, "place", "digest").join(have, F.col("digest") == F.col("d"), "full_outer")
    reason = F.when(F.col("d").isNull(), "lost").when(F.col("digest").isNull(), "stray").when(~F.col("good"), "altered").when(F.col("copies") > 1, "repeated")
    return both.select(key, "place", F.coalesce("digest", "d").alias("digest"), reason.alias("reason")).where("reason IS NOT NULL")


def reassembled(manifest: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """key, at, text: the items again, counted from 1 in each key; a key with a lost or altered shard gives none of its items."""
    bad = shard_errors(manifest, stored, key).where("reason IN ('lost', 'altered')").select(F.col(key).alias("__k")).distinct()
    one = stored.dropDuplicates(["digest"]).withColumnRenamed("digest", "d")
    good = manifest.join(bad, F.col(key).eqNullSafe(F.col("__k")), "left_anti")
    before = running(good, [key], ["place"], {"__before": ("sum", F.col("n"))}, inclusive=False)
    lines = before.join(one, F.col("digest") == F.col("d")).select(key, "__before", F.posexplode(F.split("body", "\n")).alias("i", "text"))
    return lines.select(key, (F.col("__before") + F.col("i") + 1).alias("at"), "text")
