"""Mirror maintenance as micro-batches: idempotent upserts, replaced children, deletions, queues.

Plain Parquet has no MERGE, so state is a table of deltas (:class:`quillspark.operators.incremental.PublishedTable`): each
batch appends the rows that changed and publishes the next manifest. Re-reading a change (slack, replay after a crash)
changes nothing, as only newer or differing rows are appended. Versions are ordered by instant, whatever their spelling and zone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators.incremental import PublishedTable
from quillspark.tables import instant_us

LOG_ROWS, TREE_DEPTH, TREE_BLOCKS = 500, 6, 2999
#: Deltas of a mirror after which it is compacted.
DELTAS = 64


def moment(c: str) -> Column:
    """What orders times held as strings: the instant, then the spelling; unreadable ones come first."""
    return F.struct(F.coalesce(instant_us(c), F.lit(-(2**62))), F.coalesce(F.col(c), F.lit("")))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row per key by ``order`` (times as strings); equal ones by their fingerprint."""
    w = Window.partitionBy(key).orderBy(*[moment(c).desc() for c in order], F.xxhash64(*rows.columns))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert_pages(snapshot: DataFrame, batch: DataFrame, key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """(new snapshot, keys that changed). A batch row replaces the stored row; an empty source id keeps the known one.

    A key changed if it is new or its ``last_edited_time`` differs, in either direction. ``batch`` has one row per key.
    """
    old = snapshot.select(F.col(key).alias("_k"), F.col("last_edited_time").alias("_t"), F.col("data_source_id").alias("_ds"))
    joined = batch.join(old, batch[key] == F.col("_k"), "left")
    source = F.coalesce(F.nullif(F.col("data_source_id"), F.lit("")), F.col("_ds"), F.lit(""))
    fresh = joined.withColumn("data_source_id", source)
    changed = fresh.filter("_k IS NULL OR NOT (last_edited_time <=> _t)").select(key)
    kept = snapshot.join(batch.select(key), key, "left_anti")
    return kept.unionByName(fresh.select(*snapshot.columns)), changed


def replace_children(stored: DataFrame, keys: DataFrame, rows: DataFrame, key: str = "page_id") -> DataFrame:
    """``stored`` with all rows of ``keys`` replaced by ``rows``; repeated rows of a key come once."""
    return stored.join(keys.select(key).distinct(), key, "left_anti").unionByName(rows.join(keys.select(key).distinct(), key, "left_semi").distinct())


def tombstones(known: DataFrame, live: DataFrame, key: str = "page_id") -> DataFrame:
    """Known pages of a source that a full listing no longer has; pages outside any source are never reconciled."""
    return known.filter("coalesce(data_source_id, '') <> '' AND coalesce(in_trash, 0) = 0").join(live.select(key).distinct(), key, "left_anti")


def bury(snapshot: DataFrame, gone: DataFrame, key: str = "page_id") -> DataFrame:
    """``snapshot`` with ``in_trash`` set for the keys in ``gone``; the rows stay."""
    mark = gone.select(F.col(key).alias("_g")).distinct()
    return snapshot.join(mark, snapshot[key] == F.col("_g"), "left").withColumn(
        "in_trash", F.when(F.col("_g").isNotNull(), 1).otherwise(F.col("in_trash"))
    ).drop("_g")


def content_queue(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Pages whose content is older than their last edit, newest first."""
    out = pages.filter("coalesce(in_trash, 0) = 0 AND (coalesce(content_synced, '') = '' OR content_synced <> last_edited_time)")
    out = out.orderBy(F.desc("last_edited_time"), "page_id")
    return out.limit(limit) if limit else out


def embed_queue(chunks: DataFrame, pages: DataFrame, vectors: DataFrame, model: str, skip: list[str] = (), limit: int | None = None) -> DataFrame:
    """Chunks without a vector of ``model``, of the cheapest page first; sources in ``skip`` get none."""
    live = pages.filter("coalesce(in_trash, 0) = 0").select("page_id", "content_runes", "data_source_id")
    live = live.filter(~F.col("data_source_id").isin(*skip)) if skip else live
    has = vectors.select("chunk_id", F.col("model").alias("_m")).distinct()
    out = chunks.join(live, "page_id").join(has.filter(F.col("_m") == model), "chunk_id", "left_anti")
    out = out.orderBy("content_runes", "page_id", "ord", "chunk_id")
    return out.limit(limit) if limit else out


def prune_log(log: DataFrame, keep: int = LOG_ROWS) -> DataFrame:
    return log.orderBy(F.desc("log_id")).limit(keep)


def watermarks(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """``data_source_id, watermark``: the greatest edit time seen, never moving back (string order)."""
    seen = pages.groupBy("data_source_id").agg(F.max("last_edited_time").alias("seen"))
    return seen.join(stored, "data_source_id", "full").select(
        "data_source_id", F.greatest(F.coalesce("seen", F.lit("")), F.coalesce("watermark", F.lit(""))).alias("watermark")
    )


def block_trees(blocks: DataFrame, depth: int = TREE_DEPTH, most: int = TREE_BLOCKS) -> DataFrame:
    """Blocks reachable from their page in at most ``depth`` levels, the first ``most`` per page in walking order.

    ``blocks``: ``page_id, block_id, parent_id, ord, type``; below child pages and databases nothing is read.
    A fixed number of joins, one per level.
    """
    frontier = blocks.filter("coalesce(parent_id, '') = '' OR parent_id = page_id").withColumn("path", F.array(F.struct("ord", "block_id")))
    out = frontier
    for _ in range(depth - 1):
        up = frontier.filter("type NOT IN ('child_page', 'child_database')").select(
            "page_id", F.col("block_id").alias("_up"), F.col("path").alias("_path")
        )
        down = blocks.join(up, ["page_id"]).filter("parent_id = _up")
        frontier = down.withColumn("path", F.concat("_path", F.array(F.struct("ord", "block_id")))).select(*out.columns)
        out = out.unionByName(frontier)
    w = Window.partitionBy("page_id").orderBy("path")
    return out.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).drop("n", "path")


class PageMirror:
    """The pages as a published table, fed by batches or a stream. ``schema`` has ``page_id, data_source_id, last_edited_time,
    synced_at, in_trash`` and whatever else a page has."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.schema, self.table = spark, schema, PublishedTable(spark, path, "page_id", schema)
        self.failed: list[tuple[str, str]] = []

    def pages(self) -> DataFrame:
        return self.table.read()

    def apply(self, batch: DataFrame, _epoch: int = 0) -> DataFrame:
        """Upsert one batch; returns the rows appended.

        The latest row per page counts. A row older than the stored one, or equal to it, changes nothing, so a replayed
        batch doesn't either; an empty source id keeps the known one.
        """
        n = self.table.version()
        when = lambda: F.struct(moment("last_edited_time").alias("e"), moment("synced_at").alias("s"))
        content = F.xxhash64(*[F.col(f.name).cast("string") for f in self.schema if f.name != "data_source_id"])
        known = self.table.state(when().alias("_when"), content.alias("_print"), F.col("data_source_id").alias("_ds"), version=n)
        new = latest(batch.filter("page_id IS NOT NULL").select(*self.schema.names), "page_id", "last_edited_time", "synced_at")
        joined = new.withColumn("_new", when()).withColumn("_own", content).join(known, "page_id", "left")
        source = F.coalesce(F.nullif(F.col("data_source_id"), F.lit("")), F.col("_ds"), F.lit(""))
        differs = (F.col("_own") != F.col("_print")) | (source != F.coalesce("_ds", F.lit("")))
        fresh = joined.filter(F.col("_when").isNull() | (F.col("_new") > F.col("_when")) | ((F.col("_new") == F.col("_when")) & differs))
        out = self.table.append(fresh.withColumn("data_source_id", source).select(*self.schema.names), n)
        if len(self.table.deltas()) > DELTAS:
            self.table.compact()
        return out

    def reconcile(self, live: DataFrame) -> DataFrame:
        """Full pass: bury what a full listing of the sources no longer has; returns the buried rows. Only they are written."""
        n = self.table.version()
        gone = tombstones(self.table.state("data_source_id", "in_trash", version=n), live)
        return self.table.append(self.table.read(n).join(gone.select("page_id"), "page_id", "left_semi").withColumn("in_trash", F.lit(1)), n)

    def pass_over(self, sources: dict[str, Callable[[], DataFrame]]) -> list[str]:
        """Apply each source's changes; one that fails is noted and skipped, the others go on."""
        done = []
        for name, load in sources.items():
            try:
                self.apply(load())
                done.append(name)
            except Exception as e:  # noqa: BLE001 - isolation of sources
                self.failed.append((name, str(e)[:300]))
        return done

    def follow(self, path: str, checkpoint: str, once: bool = True, seconds: int = 30, files: int = 1000):
        """Structured Streaming over Parquet files with page rows, ``files`` a batch; ``once`` ends when all present files are read."""
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files).parquet(path)
        writer = stream.writeStream.foreachBatch(lambda batch, epoch: self.apply(batch, epoch) and None).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime=f"{seconds} seconds").start()
