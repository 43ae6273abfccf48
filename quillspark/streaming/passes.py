"""A mirrored workspace as published tables, and the passes that keep it: discovery, changes, deletions, content, index, embeddings.

What is read comes from an ``api`` object (see :class:`Api`); every step works on tables, one batch for all sources.
"""

from __future__ import annotations

import datetime
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.encoder import Embedder, embed_chunks
from quillspark.functions.scalars import content_hash, minus_slack, rune_count
from quillspark.operators import chunking
from quillspark.operators.incremental import PublishedTable
from quillspark.streaming import sync

PAGES = "page_id string, data_source_id string, parent_id string, title string, url string, created_time string, last_edited_time string, synced_at string, in_trash int"
#: Tables besides the pages: key and columns. Rows of ``chunks`` and ``cells`` without ``ord`` or ``col`` only say that the page's former rows are gone.
TABLES = {
    "contents": ("page_id", "page_id string, content_markdown string, content_hash string, content_runes int, content_synced string"),
    "sources": ("source_id", "source_id string, database_id string, title string, schema_json string, in_trash int"),
    "databases": ("id", "id string, title string, url string, parent_id string, in_trash int"),
    "users": ("id", "id string, name string, type string, email string"),
    "watermarks": ("data_source_id", "data_source_id string, watermark string"),
    "meta": ("meta_key", "meta_key string, meta_value string"),
    "chunks": ("page_id", "page_id string, chunk_id long, ord int, heading string, text string, hash string"),
    "cells": ("page_id", "page_id string, col string, value_str string, value_num double"),
    "vectors": ("chunk_id", "chunk_id long, dim int, scale float, vec binary, model string"),
}
LOOSE, BOOTSTRAPPED = "loose_watermark", "bootstrapped"
#: Chunks embedded in one step.
EMBED_BATCH = 8


class Api(Protocol):
    """Where a workspace is read from. Frames have the columns of the tables above; times are strings."""

    def sources(self) -> DataFrame: ...

    def databases(self) -> DataFrame: ...

    def sources_of(self, databases: DataFrame) -> DataFrame:
        """For a service that can't list sources."""

    def users(self) -> DataFrame: ...

    def changes(self, marks: DataFrame) -> DataFrame:
        """Pages of the sources in ``marks`` (``source_id, since``) edited at or after ``since``, as strings."""

    def loose(self, since: str) -> DataFrame:
        """Pages outside any source edited at or after ``since``."""

    def contents(self, pages: DataFrame) -> DataFrame:
        """``page_id, content_markdown`` of the pages (``page_id``); pages that can't be read are left out."""


class Workspace:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.pages = sync.PageMirror(spark, f"{path}/pages", spark.createDataFrame([], PAGES).schema)
        self.tables = {n: PublishedTable(spark, f"{path}/{n}", key, spark.createDataFrame([], s).schema) for n, (key, s) in TABLES.items()}
        self.failed: list[tuple[str, str]] = []

    def read(self, name: str) -> DataFrame:
        rows = self.tables[name].read()
        return rows.filter("ord IS NOT NULL") if name == "chunks" else rows.filter("col IS NOT NULL") if name == "cells" else rows

    def put(self, name: str, rows: DataFrame) -> DataFrame:
        """The last writer wins: the rows of each key in ``rows`` replace all its former rows. Rows without key are left out."""
        t = self.tables[name]
        return t.append(rows.filter(F.col(t.key).isNotNull()).select(*t.schema.names), t.version())

    def upsert(self, name: str, rows: DataFrame) -> DataFrame:
        """:meth:`put` for tables of one row per key; of repeated keys the row of the greatest fingerprint counts."""
        t = self.tables[name]
        one = rows.groupBy(t.key).agg(F.max_by(F.struct(*t.schema.names), F.xxhash64(*t.schema.names)).alias("x")).select("x.*")
        return self.put(name, one)

    def get(self, key: str) -> str | None:
        r = self.read("meta").filter(F.col("meta_key") == key).first()
        return r["meta_value"] if r else None

    def set(self, key: str, value: str) -> None:
        self.put("meta", self.spark.createDataFrame([(key, value)], TABLES["meta"][1]))

    def discover(self, api: Api) -> str:
        """Read sources and databases; returns by which way. Where sources can't be listed they are taken from the databases."""
        databases = self.upsert("databases", api.databases())
        try:
            self.upsert("sources", api.sources())
            return "sources"
        except Exception as e:  # noqa: BLE001 - an older service
            self.failed.append(("sources", str(e)[:300]))
            self.upsert("sources", api.sources_of(databases))
            return "databases"

    def marks(self, full: bool = False) -> DataFrame:
        """``source_id, since`` of the live sources: the watermark moved back by the slack; '' where there is none or the pass is full."""
        live = self.read("sources").filter("coalesce(in_trash, 0) = 0").select("source_id")
        known = self.tables["watermarks"].state("watermark").select(F.col("data_source_id").alias("source_id"), "watermark")
        since = F.lit("") if full else F.coalesce(minus_slack(F.nullif("watermark", F.lit(""))), F.lit(""))
        return live.join(known, "source_id", "left").select("source_id", since.alias("since"))

    def _advance(self, rows: DataFrame) -> None:
        """Move the watermarks of the sources in ``rows`` forward, never back, compared as strings."""
        t = self.tables["watermarks"]
        seen = rows.filter("data_source_id <> ''").groupBy("data_source_id").agg(F.max("last_edited_time").alias("seen"))
        known = t.state("watermark")
        self.put("watermarks", seen.join(known, "data_source_id", "left").select("data_source_id", F.greatest(F.coalesce("seen", F.lit("")), F.coalesce("watermark", F.lit(""))).alias("watermark")))

    def changes(self, api: Api, full: bool = False) -> list[str]:
        """Take up what changed in the live sources; returns the sources that were read.

        All sources are one batch. If that fails each is tried by itself, and those that fail are noted and keep their watermark.
        """
        marks = self.spark.createDataFrame([tuple(r) for r in self.marks(full).collect()], "source_id string, since string")  # a row per source
        names = [r["source_id"] for r in marks.collect()]

        def take(own: DataFrame) -> None:
            rows = api.changes(own)
            self.pages.apply(rows)
            self._advance(rows)

        try:
            take(marks)
            return names
        except Exception:  # noqa: BLE001 - isolation of sources
            done = []
            for name in names:
                try:
                    take(marks.filter(F.col("source_id") == name))
                    done.append(name)
                except Exception as e:  # noqa: BLE001
                    self.failed.append((name, str(e)[:300]))
            return done

    def loose(self, api: Api, full: bool = False) -> None:
        """Pages outside any source, with a watermark of their own."""
        mark = self.get(LOOSE) or ""
        since = "" if full or not mark else self.spark.range(1).select(minus_slack(F.lit(mark)).alias("s")).first()["s"]
        rows = api.loose(since)
        self.pages.apply(rows)
        seen = rows.agg(F.max("last_edited_time").alias("m")).first()["m"] or ""
        if seen > mark:
            self.set(LOOSE, seen)

    def bury(self, api: Api, sources: list[str]) -> DataFrame:
        """Put the pages of ``sources`` in the trash that a full listing no longer has, and drop them from the index; returns them."""
        marks = self.spark.createDataFrame([(s, "") for s in sources], "source_id string, since string")
        others = self.pages.table.state("data_source_id").filter(~F.col("data_source_id").isin(sources)).select("page_id")
        gone = self.pages.reconcile(api.changes(marks).select("page_id").unionByName(others))
        self.drop(gone)
        return gone

    def drop(self, pages: DataFrame) -> None:
        """Drop pages (``page_id``) from the index: their chunks, and with them what is joined to these."""
        self.put("chunks", pages.select("page_id", *[F.lit(None).alias(c) for c in self.tables["chunks"].schema.names[1:]]))

    def stale(self) -> DataFrame:
        """Pages whose content is older than their last edit, newest first."""
        return sync.content_queue(self.pages.pages().join(self.tables["contents"].state("content_synced"), "page_id", "left"))

    def fetch(self, api: Api) -> DataFrame:
        """Read the content of stale pages and index them again; returns ``page_id`` of those read.

        The content is as of the page's edit time when it was queued, so an edit in between makes the page stale again.
        """
        queue = self.stale().select("page_id", "title", F.col("last_edited_time").alias("content_synced"))
        got = api.contents(queue.select("page_id")).join(queue.select("page_id", "content_synced"), "page_id")
        text = F.coalesce("content_markdown", F.lit(""))
        made = self.upsert("contents", got.select("page_id", text.alias("content_markdown"), content_hash(text).alias("content_hash"), rune_count(text).alias("content_runes"), "content_synced"))
        self.index(made.select("page_id"))
        return made.select("page_id")

    def index(self, pages: DataFrame) -> None:
        """Chunk pages (``page_id``) anew; a chunk with a known hash keeps its id, and with it its vector."""
        wanted = pages.select("page_id").distinct()
        titles = self.pages.table.state("title")
        digests = chunking.digests(self.read("cells").join(wanted, "page_id", "left_semi"), titles)
        src = wanted.join(titles, "page_id").join(self.tables["contents"].state("content_markdown"), "page_id", "left").join(digests, "page_id", "left")
        new = chunking.with_hash(chunking.chunk_pages(src.select("page_id", "title", "digest", F.col("content_markdown").alias("markdown"))))
        old = self.read("chunks").join(wanted, "page_id", "left_semi").select("chunk_id", "page_id", "ord", "hash")
        names = self.tables["chunks"].schema.names
        gone = wanted.select("page_id", *[F.lit(None).alias(c) for c in names[1:]])
        self.put("chunks", chunking.reuse(old, new).select(*names).unionByName(gone))

    def embed(self, embedder: Embedder, batch: int = EMBED_BATCH) -> int:
        """One step of the embedding queue: vectors for the first ``batch`` chunks that lack one; returns how many were made."""
        pages = self.pages.pages().join(self.tables["contents"].state("content_runes"), "page_id", "left")
        queue = sync.embed_queue(self.read("chunks"), pages, self.read("vectors"), embedder.name, limit=batch)
        return self.put("vectors", embed_chunks(queue, embedder)).count()

    def run(self, api: Api, full: bool = False) -> dict[str, int]:
        """One pass: changes, loose pages, deletions if it is full, content. What fails is noted and doesn't stop the rest."""
        done, buried, read = self.changes(api, full), 0, 0
        for step in ("loose", "bury", "fetch"):
            try:
                if step == "loose":
                    self.loose(api, full)
                elif step == "bury" and full and done:
                    buried = self.bury(api, done).count()
                elif step == "fetch":
                    read = self.fetch(api).count()
            except Exception as e:  # noqa: BLE001
                self.failed.append((step, str(e)[:300]))
        return {"sources": len(done), "buried": buried, "contents": read}

    def bootstrap(self, api: Api) -> bool:
        """Discovery, users and a full pass, once; noted as done only if nothing failed. Returns whether it ran."""
        if self.get(BOOTSTRAPPED):
            return False
        before = len(self.failed)
        self.discover(api)
        self.upsert("users", api.users())
        self.run(api, full=True)
        if len(self.failed) == before:
            self.set(BOOTSTRAPPED, datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
        return True
