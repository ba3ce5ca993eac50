"""Session logs as lines with byte positions: batch reads, and a stream source that stops at the last whole line."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.scan import running

SCHEMA = "path string, byte_start bigint, byte_end bigint, raw string, gap string"
MAX_EVENT = 8 * 1024 * 1024


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line, raw of JSONL files on any file system that Spark reads, whole files at a time; ``numbered`` takes long files in spans."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("line", "raw"))
    return raw.where("raw <> ''").withColumn("line", F.col("line") + 1)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path, text, digest of whole documents: one event each, said by the owner."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("digest"), F.lit("owner").alias("role"))


def header(rows: DataFrame, fields: dict[str, str], most: int = 64) -> DataFrame:
    """path and the first non-null value of each field (name -> path in the JSON) within a file's first lines."""
    v = rows.where(F.col("line") <= most).select("path", "line", F.try_parse_json("raw").alias("v"))
    got = {n: F.try_variant_get("v", p, "string") for n, p in fields.items()}
    return v.groupBy("path").agg(*[F.min_by(c, F.when(c.isNotNull(), F.col("line"))).alias(n) for n, c in got.items()])


def frames(path: str, start: int, end: int, most: int = MAX_EVENT) -> Iterator[tuple]:
    """Rows for the whole lines of [start, end); an oversized or undecodable line is a gap, a partial last line nothing."""
    with open(path, "rb") as f:
        f.seek(start)
        at = start
        while at < end:
            line = f.readline(most + 1)
            size, last = len(line), line
            while last and not last.endswith(b"\n"):  # an oversized line is read on in parts and not kept
                last = f.readline(1 << 20)
                size += len(last)
            if not last.endswith(b"\n") or at + size > end:
                return
            stop = at + size
            if size > most:
                yield path, at, stop, None, "oversized_event"
            else:
                try:
                    yield path, at, stop, line[:-1].decode(), None
                except UnicodeDecodeError:
                    yield path, at, stop, None, "malformed_event"
            at = stop


def whole(path: str, least: int = 0) -> int:
    """Where the last whole line of a file ends, from ``least`` on."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        at = size
        while at > least:
            begin = max(least, at - (1 << 20))
            f.seek(begin)
            cut = f.read(at - begin).rfind(b"\n")
            if cut >= 0:
                return begin + cut + 1
            at = begin
    return least


def prefix_digest(path: str, end: int) -> str:
    digest = sha256()
    with open(path, "rb") as f:
        while end > 0 and (part := f.read(min(1 << 20, end))):
            digest.update(part)
            end -= len(part)
    return digest.hexdigest()


class _Span(InputPartition):
    """The lines that start in [start, stop), of what ends at ``end``; a line surely starts at ``first``. ``gap`` stands alone, for a file that changed."""

    def __init__(self, path, start, stop, end, first=0, gap=None):
        self.path, self.start, self.stop, self.end, self.first, self.gap = path, start, stop, end, first, gap


def _spans(path: str, begin: int, end: int, size: int) -> list[_Span]:
    """[begin, end) in pieces of ``size`` bytes; nothing of the file is read to cut them."""
    return [_Span(path, at, min(at + size, end), end, begin) for at in range(begin, end, size)]


def _lines_of(span: _Span) -> Iterator[tuple]:
    """The lines that start inside a span; one that began before it belongs to the span before."""
    at = span.start
    if at > span.first:
        with open(span.path, "rb") as f:
            f.seek(at - 1)
            while (part := f.readline(1 << 20)) and not part.endswith(b"\n"):
                pass
            at = f.tell()
    if at < span.stop:
        for row in frames(span.path, at, span.end):
            if row[1] >= span.stop:
                return
            yield row


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.pattern, self.size = options["path"], int(options.get("spanBytes", 64 << 20))

    def partitions(self):
        return [x for path in sorted(glob.glob(self.pattern)) for x in _spans(path, 0, whole(path), self.size)]

    def read(self, span):
        yield from _lines_of(span)


def _window_digest(path: str, start: int, end: int) -> str:
    with open(path, "rb") as f:
        f.seek(start)
        return sha256(f.read(end - start)).hexdigest()[:32]


class _Stream(DataSourceStreamReader):
    """Offsets hold, for each file, where its last whole line ends, and digests of the first and the last WINDOW bytes before that.

    The driver looks at the sizes of the files and at these windows only; lines are read in spans on the executors. A batch is planned from its two
    offsets: a file that shrank, was replaced, or whose windows have changed is a gap row ``source_changed``, and is read from its start.
    So a batch that is run again gives the same rows as long as the files hold the same bytes. An edit between the windows that leaves them as they are
    shows in ``chunk_digests`` alone.
    """

    WINDOW = 1 << 16

    def __init__(self, options):
        self.pattern, self.size, self.known = options["path"], int(options.get("spanBytes", 64 << 20)), {}

    def initialOffset(self):
        return {"files": json.dumps({})}

    def latestOffset(self):
        files = {}
        for path in sorted(glob.glob(self.pattern)):
            stat = os.stat(path)
            mark = (stat.st_size, stat.st_mtime_ns, stat.st_ino)
            if self.known.get(path, (None,))[0] != mark:  # files that didn't change since the last look aren't opened
                at = whole(path)
                self.known[path] = (mark, [at, _window_digest(path, 0, min(at, self.WINDOW)), _window_digest(path, max(0, at - self.WINDOW), at), stat.st_ino])
            files[path] = self.known[path][1]
        return {"files": json.dumps(files, sort_keys=True)}

    def _changed(self, path, old, new):
        at, head, tail, inode = old
        if not at:
            return False
        if new[0] < at or new[3] != inode:
            return True
        return _window_digest(path, 0, min(at, self.WINDOW)) != head or _window_digest(path, max(0, at - self.WINDOW), at) != tail

    def partitions(self, start, end):
        old, new, out = json.loads(start["files"]), json.loads(end["files"]), []
        for path, mark in sorted(new.items()):
            begin = old.get(path, [0])[0]
            if path in old and mark != old[path] and self._changed(path, old[path], mark):
                out.append(_Span(path, 0, 0, 0, gap="source_changed"))
                begin = 0
            out += _spans(path, begin, mark[0], self.size)
        return out

    def read(self, span):
        if span.gap:
            yield span.path, 0, 0, None, span.gap
        else:
            yield from _lines_of(span)


class LogSource(DataSource):
    """format("strataline_log"): option path is a glob on a file system that driver and executors share, spanBytes what a task reads.

    Batch: all whole lines. Stream: from the last offset on, to the last whole line.
    """

    @classmethod
    def name(cls):
        return "strataline_log"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)


def numbered(rows: DataFrame) -> DataFrame:
    """rows of the log source and ``line``, counted from 1 in each file: counts of ranges are added up, no file has to fit one task."""
    return running(rows, ["path"], ["byte_start"], {"line": ("sum", F.lit(1).cast("bigint"))}, chunk=16 << 20)


class _Chunks(DataSourceReader):
    def __init__(self, options):
        self.pattern, self.size = options["path"], int(options.get("chunkBytes", 8 << 20))

    def partitions(self):
        return [x for path in sorted(glob.glob(self.pattern)) for x in _spans(path, 0, os.path.getsize(path), self.size)]

    def read(self, span):
        with open(span.path, "rb") as f:
            f.seek(span.start)
            data = f.read(span.stop - span.start)
        yield span.path, span.start, span.start + len(data), sha256(data).hexdigest()


class ChunkSource(DataSource):
    """format("strataline_chunks"): path, byte_start, byte_end, digest of each chunk (chunkBytes) of the files of a glob, read on the executors."""

    @classmethod
    def name(cls):
        return "strataline_chunks"

    def schema(self):
        return "path string, byte_start bigint, byte_end bigint, digest string"

    def reader(self, schema):
        return _Chunks(self.options)


def chunk_digests(spark: SparkSession, path: str, chunk_bytes: int = 8 << 20) -> DataFrame:
    spark.dataSource.register(ChunkSource)
    return spark.read.format("strataline_chunks").option("path", path).option("chunkBytes", str(chunk_bytes)).load()


def changed_chunks(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, byte_start, reason of chunks (path, byte_start, byte_end, digest) that aren't what they were: 'lost', 'cut' or 'altered'.

    A last chunk that has grown is compared with nothing, since its digest covers other bytes: it is 'grown'.
    """
    new = after.select(F.col("path").alias("p"), F.col("byte_start").alias("s"), F.col("byte_end").alias("e"), F.col("digest").alias("d"))
    both = before.join(new, (F.col("path") == F.col("p")) & (F.col("byte_start") == F.col("s")), "left")
    reason = F.when(F.col("e").isNull(), "lost").when(F.col("e") < F.col("byte_end"), "cut").when(F.col("e") > F.col("byte_end"), "grown").when(F.col("d") != F.col("digest"), "altered")
    return both.select("path", "byte_start", reason.alias("reason")).where("reason IS NOT NULL")


def listing(spark: SparkSession, path: str, after: str | None = None, limit: int | None = None, modified_after: str | None = None) -> DataFrame:
    """path, length, modified of files below a folder, by name: a page after a name, or all."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (reader.option("modifiedAfter", modified_after) if modified_after else reader).load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    rows = rows.where(F.col("path") > after) if after else rows
    return rows.orderBy("path").limit(limit) if limit is not None else rows


def namespace(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of each file's bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("digest"))
