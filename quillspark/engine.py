"""The user-facing operations over a mirror: search, fetch, query, catalog, recall, status, resync."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.encoder import Embedder
from quillspark.operators import flatten, search, sqltool
from quillspark.plans import reference
from quillspark.session import sql_session
from quillspark.streaming import sync
from quillspark.tables import page_key, read


class Engine:
    """A mirror directory of Parquet tables. ``embedder`` None means keyword search only."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None, vectors: DataFrame | None = None):
        self.spark, self.path, self.embedder = spark, path, embedder
        self.pages, self.chunks = reference.pages(spark, path), reference.chunks(spark, path)
        self.relations, self.sources = reference.relations(spark, path), reference.sources(spark, path)
        self.vectors = vectors if vectors is not None else reference.vectors(spark, path)
        self.index = reference.keyword_index(spark, path)
        self._sql: SparkSession | None = None
        self._views: dict[str, str] = {}

    def search(self, query: str, mode: str = "hybrid", limit: int = search.LIMIT, expand_relations: bool = False, **filters) -> DataFrame:
        return search.search(
            *self._asked({0: query}), self.index, self.chunks, self.pages, self.vectors, self.relations, mode, limit, expand_relations,
            dim=self.embedder.dim if self.embedder else 0, filters=filters or None,
        ).drop("qid").orderBy("position")

    def _asked(self, texts: dict[int, str]) -> tuple[DataFrame, DataFrame | None]:
        """(``qid, text``; ``qid, query`` if there is an embedder) of the caller's queries."""
        queries = self.spark.createDataFrame(list(texts.items()), "qid long, text string")
        if self.embedder is None:
            return queries, None
        embedded = [(q, list(map(float, self.embedder.embed_query(t)))) for q, t in texts.items()]
        return queries, self.spark.createDataFrame(embedded, "qid long, query array<double>")

    def why(self, mode: str = "hybrid") -> str | None:
        """Why a search runs by keyword only, if it does."""
        return "no embedding model is loaded" if self.embedder is None and mode in ("hybrid", "vector") else None

    def _one(self, page: str) -> dict | None:
        key = self.spark.range(1).select(page_key(F.lit(page.split("?")[0].rsplit("/", 1)[-1])).alias("k")).first()["k"]
        bare = key.replace("-", "")[-32:]
        r = self.pages.filter(F.translate("page_id", "-", "") == bare).first()
        return r.asDict() if r else None

    def fetch(self, page: str, include_relations: bool = False) -> str:
        """A page as tagged text, by id in any spelling or by address."""
        if not page.strip():
            raise ValueError("fetch: id is required")
        p = self._one(page)
        if p is None:
            raise KeyError(f"fetch: {page} is not in the mirror")
        quoted = lambda s: json.dumps(s or "", ensure_ascii=False)
        icon = f" icon={quoted(p['icon'])}" if p["icon"] else ""
        out = [f"<page id={quoted(p['page_id'])} url={quoted(p['url'])}{icon}>"]
        if p["data_source_id"]:
            s = self.sources.filter(F.col("source_id") == p["data_source_id"]).first()
            name = flatten.view_name(p["data_source_id"])
            out.append(f"<data-source id={quoted(p['data_source_id'])} name={quoted(s['title'] if s else '')} table={quoted(name)}/>")
        out.append(f"<mirror last_edited_time={quoted(p['last_edited_time'])} synced={quoted(p['content_synced'])}/>")
        if p["in_trash"]:
            out.append("<trashed>this page is in the trash; the mirror keeps it</trashed>")
        rows = reference.props(self.spark, self.path).filter((F.col("page_id") == p["page_id"]) & F.col("col").isNotNull() & F.col("value").isNotNull())
        cells = {r["col"]: r["value"] for r in rows.groupBy("col").agg(F.max("value").alias("value")).collect()}
        if cells:
            out += ["<properties>", json.dumps(cells, ensure_ascii=False, indent=2, sort_keys=True), "</properties>"]
        if include_relations:
            near = search.related(self.pages, self.relations.filter(F.col("from_id") == p["page_id"])).orderBy("prop", "title").collect()
            if near:
                out += ["<relations>", *(f"- {r['prop']}: {r['title']} ({r['url']})" for r in near), "</relations>"]
        return "\n".join([*out, "<content>", p["content_markdown"] or "", "</content>", "</page>", ""])

    def sql(self) -> SparkSession:
        """The session with a view per source and the raw tables."""
        if self._sql is None:
            own = sql_session(self.spark)
            for t in ("pages", "page_props", "relations", "chunks", "vectors", "data_sources", "mirror_databases", "meta"):
                read(own, self.path, t).createOrReplaceTempView(t)
            sqltool.register_shims(own)
            self._sql = own
            self.refresh_views()
        return self._sql

    def refresh_views(self) -> list[str]:
        """Make the views whose source is new or has another schema than when its view was made; returns their names."""
        own = self.sql()
        return flatten.register_views(own, reference.pages(own, self.path), reference.props(own, self.path), reference.sources(own, self.path), self._views)

    def query(self, sql: str, params: list | None = None, limit: int = sqltool.CAP) -> dict:
        return sqltool.fetch(self.sql(), sql, params, limit)

    def catalog(self) -> DataFrame:
        return flatten.catalog(self.sources, self.pages).orderBy("title")

    def recall(self, entity: str, limit: int = 8) -> dict:
        """The card of an entity, its matches, and everything linked with it by source."""
        if not entity.strip():
            raise ValueError("recall: entity is required")
        found = [r.asDict() for r in self.search(entity, limit=limit).collect()]
        if not found:
            return {"entity": None, "matches": [], "linked": {}}
        edges = self.relations.filter((F.col("from_id") == found[0]["page_id"]) | (F.col("to_id") == found[0]["page_id"]))
        rows = search.linked(self.pages, edges, self.sources).filter(F.col("page_id") == found[0]["page_id"]).collect()
        linked: dict[str, list] = {}
        for r in rows:
            linked.setdefault(r["source"], []).append({"id": r["other_id"], "title": r["title"], "via_property": r["prop"]})
        return {"entity": found[0], "matches": found, "linked": linked}

    def status(self) -> DataFrame:
        return reference.mirror_status(self.spark, self.path).withColumn(
            "embedding_model", F.lit(self.embedder.name if self.embedder else "none (keyword search only)")
        )

    def resync(self, mirror: sync.PageMirror, load, page_id: str | None = None, full: bool = False) -> str:
        """Re-read one page, or all changes, or everything with deletions, through ``load(page_id | None) -> DataFrame``."""
        rows = load(page_id)
        mirror.apply(rows)
        if page_id:
            return f"re-read {page_id}"
        return f"sync pass: pages={rows.count()} buried={mirror.reconcile(rows).count() if full else 0}"

    def evaluate(self, cases: list[dict], modes=("hybrid", "keyword", "vector")) -> DataFrame:
        """Ranks ``qid, mode, rank`` of the cases' pages."""
        from quillspark.operators.evaluate import rank_of

        texts = {k: c["q"] for k, c in enumerate(cases, 1)}
        asked = self._asked(texts)
        out = None
        for mode in modes:
            r = search.search(*asked, self.index, self.chunks, self.pages, self.vectors, mode=mode, dim=self.embedder.dim if self.embedder else 0)
            r = r.select("qid", F.lit(mode).alias("mode"), "page_id", "position")
            out = r if out is None else out.unionByName(r)
        wanted = self.spark.createDataFrame([(k, m, c["expect"]) for k, c in enumerate(cases, 1) for m in modes], "qid long, mode string, expect string")
        return rank_of(out, wanted)

