"""Processing only new or changed records (p1).

The target is the state: each output row carries the source key and version it was made
from, so what is pending is the anti-join of the source against the target's latest versions.

A target is a table of deltas. A run writes its rows as one more delta directory, once, and publishes it by
creating the next numbered manifest, which lists all deltas in force. A manifest is created, never
replaced, so of two runs that started from the same one only one succeeds; the other is told and can
be repeated. A run that dies before its manifest exists leaves the old one in force: its records stay pending, and none
that was published is taken up again. Nothing that was published is rewritten, except by :meth:`PublishedTable.compact`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.shared import Scratch
from quillspark.tables import current_pages, flag, instant_us, page_key, read


class Conflict(Exception):
    """Another run published first."""


def version_of(c: Column | str) -> Column:
    """Hash as version: letter case doesn't matter, null and empty are no version (null)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(c), F.lit(""))


def pending(source: DataFrame, target: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of ``source`` whose (key, version) is not in ``target``.

    A source row without version is always pending, a target row without version proves
    nothing. Repeated target rows do no harm; extra columns on either side are ignored or
    kept as they are. Rows of ``source`` with a null key are no records and are left out.
    """
    done = target.select(F.col(key).alias("_k"), F.col(version).alias("_v")).filter("_k IS NOT NULL AND _v IS NOT NULL")
    keyed = source.filter(F.col(key).isNotNull())
    return keyed.join(done, (keyed[key] == done["_k"]) & (keyed[version] == done["_v"]), "left_anti")


class PublishedTable:
    """Rows of a ``key`` in deltas; of a key the rows of its latest delta count.

    ``folder/manifest-N.json`` lists the deltas of version N, the highest N is in force. The rename that makes a
    manifest doesn't replace an existing one; on a file system whose rename isn't atomic, one writer at a time is needed.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fc = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), conf)
        self._fs = self._path(self.path).getFileSystem(conf)

    def _manifest(self, n: int) -> str:
        return f"{self.path}/manifest-{n:012d}.json"

    def version(self) -> int:
        """Number of the manifest in force, 0 if nothing is published."""
        found = self._fs.globStatus(self._path(f"{self.path}/manifest-*.json"))
        return max((int(f.getPath().getName()[9:-5]) for f in found or ()), default=0)

    def deltas(self, version: int | None = None) -> list[str]:
        n = self.version() if version is None else version
        if not n:
            return []
        stream = self._fs.open(self._path(self._manifest(n)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _rows(self, version: int | None) -> DataFrame:
        """All rows with the number of their delta as ``_seq``."""
        out = None
        for i, d in enumerate(self.deltas(version)):
            part = self.spark.read.schema(self.schema).parquet(f"{self.path}/{d}").withColumn("_seq", F.lit(i))
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], self.schema).withColumn("_seq", F.lit(0)) if out is None else out

    def state(self, *columns: str | Column, version: int | None = None) -> DataFrame:
        """``key`` and the given (named) columns of its latest delta, one row per key: a combinable maximum of these columns alone."""
        latest = self._rows(version).groupBy(self.key).agg(F.max(F.struct("_seq", *columns)).alias("_v"))
        return latest.select(self.key, "_v.*").drop("_seq")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows in force."""
        n = self.version() if version is None else version
        rows = self._rows(n)
        if len(self.deltas(n)) < 2:
            return rows.drop("_seq")
        latest = rows.groupBy(self.key).agg(F.max("_seq").alias("_seq"))
        return rows.join(latest, [self.key, "_seq"], "left_semi").drop("_seq")

    def write_delta(self, df: DataFrame) -> str:
        """Write a delta that nobody sees yet."""
        d = f"delta-{uuid.uuid4().hex}"
        df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).write.parquet(f"{self.path}/{d}")
        return d

    def delta(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}")

    def publish(self, deltas: list[str], after: int) -> int:
        """Put ``deltas`` in force as the version following ``after``; raises Conflict if that version exists."""
        target = self._path(self._manifest(after + 1))
        tmp = self._path(f"{self.path}/.manifest-{uuid.uuid4().hex}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(deltas).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        try:
            self._fc.rename(tmp, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._fs.delete(tmp, False)
            if self._fs.exists(target):
                raise Conflict(f"version {after + 1} of {self.path} was published by another run") from e
            raise
        return after + 1

    def append(self, df: DataFrame, after: int) -> DataFrame:
        """Write ``df`` as a delta and publish it after version ``after``; returns the delta as read back."""
        name = self.write_delta(df)
        try:
            self.publish([*self.deltas(after), name], after)
        except Conflict:
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
            raise
        return self.delta(name)

    def compact(self) -> None:
        """Replace all deltas by one with the rows in force; readers of older versions keep their files."""
        n = self.version()
        if n:
            self.publish([self.write_delta(self.read(n))], n)


def run_increment(source: DataFrame, target: PublishedTable, version: str, transform) -> DataFrame:
    """One run: transform what is pending, publish the results as the next delta; returns the delta.

    ``transform(pending) -> rows`` is evaluated once and must keep the key and ``version`` in its rows. ``source`` has
    one row per key (of repeated rows one is taken). A key that is redone replaces all its former rows; a key for which
    ``transform`` makes no rows stays pending. Raises Conflict, with nothing published, if another run was faster.
    """
    n = target.version()
    todo = pending(source.dropDuplicates([target.key]), target.state(version, version=n), target.key, version)
    return target.append(transform(todo), n)


def live_pages(pages: DataFrame, data_sources: DataFrame, meta: DataFrame) -> DataFrame:
    """``page_id, version, indexed, edited, mark``: current versions outside the trash, with the watermark of their source.

    An empty or unknown watermark is null; a page of an unknown source is kept. ``data_sources`` and ``meta`` never grow
    with the pages (one row per source), so they may be broadcast; Spark checks their size.
    """
    cur = current_pages(
        pages,
        {
            "source_id": page_key("data_source_id"),
            "trashed": flag("in_trash"),
            "edited": instant_us("last_edited_time"),
            "version": version_of("content_hash"),
            "indexed": version_of("indexed_hash"),
        },
    )
    sources = data_sources.groupBy(page_key("id").alias("source_id")).agg(
        F.max(flag("in_trash")).alias("source_trashed"), F.max(instant_us("watermark")).alias("mark")
    ).filter("source_id <> ''")
    loose = meta.filter("meta_key = 'loose_watermark'").agg(F.max(instant_us("meta_value")).alias("mark")).select(
        F.lit("").alias("source_id"), F.lit(False).alias("source_trashed"), "mark"
    )
    return cur.filter("NOT trashed").join(sources.unionByName(loose), "source_id", "left").filter("NOT coalesce(source_trashed, false)").select(
        "page_id", "version", "indexed", "edited", "mark"
    )


TAKEN = T.StructType([T.StructField("page_id", T.StringType()), T.StructField("version", T.StringType()), T.StructField("reason", T.StringType())])


def take_up(live: DataFrame, target: PublishedTable) -> DataFrame:
    """One sync run: publish and return ``page_id, version, reason`` (``fresh`` or ``missed``) of the pages that aren't in ``target``.

    ``live`` is of :func:`live_pages`. Nulls: a page without readable edit time is ``missed`` unless its watermark is
    empty; an empty or unknown watermark is earlier than everything; a page without content hash can't be proven done,
    so every run takes it up. Empty tables give an empty result.
    """
    late = F.col("mark").isNull() | (F.col("edited") > F.col("mark"))
    return run_increment(
        live, target, "version", lambda todo: todo.select("page_id", "version", F.when(late, "fresh").otherwise("missed").alias("reason"))
    )


def pending_pages(pages: DataFrame, data_sources: DataFrame, meta: DataFrame) -> DataFrame:
    """:func:`take_up` against what ``indexed_hash`` says was indexed: ``page_id, reason``.

    The hashes are published as the target's first version, the pages taken up as its second.
    """
    scratch = Scratch(pages.sparkSession)
    live = scratch.put(live_pages(pages, data_sources, meta))
    target = PublishedTable(pages.sparkSession, f"{scratch.root}/indexed", "page_id", TAKEN)
    done = live.filter("indexed IS NOT NULL").select("page_id", F.col("indexed").alias("version"), F.lit("indexed").alias("reason"))
    target.append(done, 0)
    return take_up(live, target).select("page_id", "reason")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending_pages(read(spark, sf_dir, "pages"), read(spark, sf_dir, "data_sources"), read(spark, sf_dir, "meta"))
