"""Queries of the mirror's own operators over the test tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import scalars as X
from quillspark.operators import blocks, chunking, evaluate, flatten, postings, search
from quillspark.operators.wide import STRING_ARRAY
from quillspark.shared import Scratch
from quillspark.streaming import passes, sync
from quillspark.tables import current_pages, page_key, read

MODEL, DIM = "tern-small-i8", 64


def pages(spark: SparkSession, d: str) -> DataFrame:
    names = ("title", "url", "icon", "created_time", "last_edited_time", "in_trash", "archived", "content_markdown", "content_runes",
             "content_synced", "content_hash", "indexed_hash")
    cols = {n: F.col(n) for n in names}
    return current_pages(read(spark, d, "pages"), cols | {"data_source_id": page_key("data_source_id"), "parent_id": page_key("parent_id")})


def slim(spark: SparkSession, d: str) -> DataFrame:
    """Current pages without their content."""
    cols = {n: F.col(n) for n in ("title", "url", "last_edited_time", "in_trash", "archived", "content_runes")}
    return current_pages(read(spark, d, "pages"), cols | {"data_source_id": page_key("data_source_id")})


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as stored, full duplicates included; a search needs only some columns of them."""
    c = read(spark, d, "chunks")
    return c.select(F.col("id").alias("chunk_id"), page_key("page_id").alias("page_id"), "ord", "heading", "text", "hash")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk_rows(spark, d).distinct()


def titled(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).join(slim(spark, d).select("page_id", "title"), "page_id", "left")


def sources(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "data_sources").select(page_key("id").alias("source_id"), "title", "schema_json", "in_trash")


def relations(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "relations")
    return r.select(page_key("from_id").alias("from_id"), "prop", page_key("to_id").alias("to_id")).filter("to_id <> '' AND from_id <> ''").distinct()


def vectors(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "vectors").filter((F.col("model") == MODEL) & (F.col("dim") == DIM) & (F.octet_length("vec") == DIM))
    return v.groupBy("chunk_id").agg(F.max(F.struct("dim", "scale", "vec")).alias("v")).select("chunk_id", "v.*")


def props(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "page_props").select(page_key("page_id").alias("page_id"), "col", "value")


def keyword_index(spark: SparkSession, d: str) -> DataFrame:
    """Postings of all chunks, written once: a search reads them for statistics, dictionary and hits."""
    return Scratch(spark).put(postings.postings(titled(spark, d)))


def query_texts(spark: SparkSession, d: str) -> DataFrame:
    """``qid, text`` of every stored query."""
    return read(spark, d, "search_results").filter("query_id IS NOT NULL").groupBy(F.col("query_id").alias("qid")).agg(F.max("query_text").alias("text"))


def bm25_topk(spark, d):
    """Ten best pages of every stored query by keyword."""
    index = keyword_index(spark, d)
    ranked = search.keyword_ranking(index, chunk_rows(spark, d), search.page_filter(slim(spark, d)), postings.query_terms(query_texts(spark, d)), 10)
    return ranked.select("qid", "page_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def bm25_scores(spark, d):
    """Scores of all matching chunks of every stored query."""
    return postings.bm25(keyword_index(spark, d), postings.query_terms(query_texts(spark, d)))


def bm25_filtered(spark, d):
    """Keyword ranking with a time range; statistics stay those of the whole index."""
    allowed = search.page_filter(slim(spark, d), since="2025-01-01", until="2026-01-01")
    index = keyword_index(spark, d)
    return search.keyword_ranking(index, chunk_rows(spark, d), allowed, postings.query_terms(query_texts(spark, d)), 10).select("qid", "page_id", "chunk_id", "score")


def paired_vectors(spark: SparkSession, d: str) -> DataFrame:
    """``qid, query``: a stored vector for every stored query, as no model is at hand to embed the texts.

    The vectors of the chunks whose id is divisible by 100 are dealt out by the hundreds of their id, modulo the number of
    queries; of several the smallest id counts, and a query that gets none is left to its keywords.
    """
    asked, queries = asked_vectors(vectors(spark, d)), query_texts(spark, d).select("qid")
    n = max(queries.count(), 1)
    dealt = asked.groupBy(F.pmod(F.col("qid") / 100, F.lit(n)).cast("long").alias("k")).agg(F.min_by("query", "qid").alias("query"))
    return queries.withColumn("k", F.pmod(F.col("qid"), F.lit(n))).join(dealt, "k").select("qid", "query")


def asked_vectors(stored: DataFrame) -> DataFrame:
    """``qid, query``: the vectors of all chunks whose id is divisible by 100 stand for embedded queries."""
    import numpy as np

    def unpack(batches):
        for pdf in batches:
            yield pdf.assign(query=[(np.frombuffer(v, np.int8) * float(s)).tolist() for v, s in zip(pdf["vec"], pdf["scale"])])[["qid", "query"]]

    rows = stored.filter("chunk_id % 100 = 0 AND scale IS NOT NULL").select(F.col("chunk_id").alias("qid"), "scale", "vec")
    return rows.mapInPandas(unpack, "qid long, query array<double>")


def knn_int8(spark, d):
    """Ten best pages, by quantised dot product, of the vector of every chunk whose id is divisible by 100."""
    stored = vectors(spark, d)
    r = search.block_ranking(stored, chunk_rows(spark, d), search.page_filter(slim(spark, d)), asked_vectors(stored), DIM, 10)
    return r.select("qid", "page_id", "chunk_id", "score")


def hybrid_search(spark, d):
    """Fused search of every stored query, with relation expansion."""
    index = keyword_index(spark, d)
    return search.search(
        query_texts(spark, d), paired_vectors(spark, d), index, chunk_rows(spark, d), slim(spark, d), vectors(spark, d), relations(spark, d), expand_relations=True
    ).select("qid", F.col("position").cast("long").alias("position"), "page_id", "via", "score")


def keyword_only(spark, d):
    """Hybrid search without a model falls back to keywords, for every stored query."""
    index = keyword_index(spark, d)
    return search.search(query_texts(spark, d), None, index, chunk_rows(spark, d), slim(spark, d), vectors(spark, d)).select(
        "qid", F.col("position").cast("long").alias("position"), "page_id", "via", F.round("score", 6).alias("score")
    )


def fused_scores(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of the two stored scores of every query; ``weights``: ``qid, w`` of the keyword branch."""
    ok = lambda c: F.when(~F.isnan(c), F.col(c))
    best = rows.groupBy("qid", "page_id").agg(F.max(ok("keyword_score")).alias("k"), F.max(ok("vector_score")).alias("v"))
    rank = lambda c: best.filter(F.col(c).isNotNull()).select(
        "qid", "page_id", F.lit(0).cast("long").alias("chunk_id"), F.col(c).alias("score"),
        F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(c), "page_id")).alias("rank"),
    )
    f = search.fuse(rank("k"), rank("v"), weights)
    return f.select("qid", "page_id", "score", "via")


def stored_results(spark, d):
    return read(spark, d, "search_results").select(F.col("query_id").alias("qid"), page_key("page_id").alias("page_id"), "query_text", "keyword_score", "vector_score")


def rrf_fusion(spark, d):
    """Reciprocal rank fusion of the two stored scores of every query, keyword weight by the query's literals."""
    return fused_scores(stored_results(spark, d), query_texts(spark, d).select("qid", X.literal_weight("text").alias("w")))


def page_collapse(spark, d):
    """Best chunk per page and rank of every stored result list, by vector score."""
    rows = read(spark, d, "search_results").filter("vector_score IS NOT NULL AND NOT isnan(vector_score)")
    hits = rows.select(F.col("query_id").alias("qid"), page_key("page_id").alias("page_id"), F.lit(0).cast("long").alias("chunk_id"), F.col("vector_score").alias("score"))
    best = search.collapse(hits.groupBy("qid", "page_id", "chunk_id").agg(F.max("score").alias("score")))
    return best.groupBy("qid").agg(F.count(F.lit(1)).alias("n_pages"), F.max("score").alias("best"), F.max("rank").cast("long").alias("last_rank"))


def relation_expand(spark, d):
    """Neighbours of the five pages edited last, one relation away."""
    seeds = slim(spark, d).filter("coalesce(in_trash, 0) = 0").orderBy(F.desc("last_edited_time"), "page_id").limit(5)
    w = Window.orderBy(F.desc("last_edited_time"), "page_id")
    ranked = seeds.withColumn("position", F.row_number().over(w)).select(F.lit(1).alias("qid"), "page_id", (1.0 / F.col("position")).alias("score"), "position")
    return search.expand(ranked, relations(spark, d), slim(spark, d)).select("page_id", "via", F.round("score", 6).alias("score"))


def related_out(spark, d):
    return search.related(slim(spark, d), relations(spark, d)).select("page_id", "prop", "to_id", "title")


def recall_linked(spark, d):
    return search.linked(slim(spark, d), relations(spark, d), sources(spark, d)).select("page_id", "source", "other_id", "prop")


def catalog_counts(spark, d):
    return flatten.catalog(sources(spark, d), slim(spark, d))


def schemas(spark: SparkSession, d: str) -> dict[str, str]:
    """Schema text by source; one row of metadata per source."""
    return {r["source_id"]: r["schema_json"] or "" for r in sources(spark, d).groupBy("source_id").agg(F.max("schema_json").alias("schema_json")).collect()}


def eav_pivot_view(spark, d):
    """The generated views of all sources in long form: every non-null cell of the row and property columns.

    ``number`` holds the cells of columns declared as numbers, ``value`` all others.
    """
    return flatten.all_views(pages(spark, d), props(spark, d), schemas(spark, d))


def typed_properties(spark: SparkSession, d: str) -> DataFrame:
    """``page_id, properties``: the stored cells of each page as the API's property JSON, by the types its source declares.

    Of several values of a cell the greatest counts; lists that aren't JSON arrays of strings and types without a
    stored form are left out. A date has its start, or nothing.
    """
    rows = [(s, n, p["type"], f"date:{n}:start" if p["type"] == "date" else f"userDefined:{n}" if n.lower() in ("id", "url") else n)
            for s, text in schemas(spark, d).items() for n, p in json.loads(text or "{}").items()]
    declared = spark.createDataFrame(rows, "data_source_id string, name string, type string, col string")
    stored = props(spark, d).filter("value <> ''").groupBy("page_id", "col").agg(F.max("value").alias("v"))
    cells = stored.join(slim(spark, d).select("page_id", "data_source_id"), "page_id").join(F.broadcast(declared), ["data_source_id", "col"])
    kind, v = F.col("type"), F.col("v")
    lists = F.from_json(v, "array<string>")
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    body = (
        F.when(kind == "number", F.coalesce(v.try_cast("double").cast("string"), F.lit("null")))
        .when(kind.isin("title", "rich_text"), F.to_json(F.array(F.struct(v.alias("plain_text")))))
        .when(kind.isin("select", "status"), F.to_json(F.struct(v.alias("name"))))
        .when(kind == "multi_select", F.when(v.rlike(STRING_ARRAY), F.to_json(F.transform(lists, lambda x: F.struct(x.alias("name"))))))
        .when(kind.isin("relation", "people"), F.when(v.rlike(STRING_ARRAY), F.to_json(F.transform(lists, lambda x: F.struct(x.alias("id"))))))
        .when(kind == "checkbox", F.when(v == "__YES__", "true").otherwise("false"))
        .when(kind.isin("url", "email"), quoted(v))
        .when(kind == "date", F.to_json(F.struct(v.alias("start"))))
    )
    entry = F.concat(quoted(F.col("name")), F.lit(':{"type":'), quoted(kind), F.lit(","), quoted(kind), F.lit(":"), body, F.lit("}"))
    made = cells.select("page_id", entry.alias("entry")).filter("entry IS NOT NULL")
    return made.groupBy("page_id").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("entry"), ","), F.lit("}")).alias("properties"))


def props_flatten(spark, d):
    """Property JSON of every page flattened to attribute-value rows."""
    return flatten.flatten_properties(typed_properties(spark, d))


def props_edges(spark, d):
    """Edges of the relation properties of every page."""
    return flatten.flatten_edges(typed_properties(spark, d))


def digest_lines(spark, d):
    """Property digest of every page; finite values of columns its source declares as numbers are shown as numbers."""
    rows = [(s, c) for s, text in schemas(spark, d).items() for c, k in flatten.schema_columns(text) if k == "number"]
    numbers = spark.createDataFrame(rows, "data_source_id string, col string").withColumn("number", F.lit(True))
    own = slim(spark, d).select("page_id", "title", "data_source_id")
    p = props(spark, d).filter("col IS NOT NULL").groupBy("page_id", "col").agg(F.max("value").alias("value_str"))
    p = p.join(own.select("page_id", "data_source_id"), "page_id", "left").join(F.broadcast(numbers), ["data_source_id", "col"], "left")
    number = F.when(F.col("number"), F.col("value_str").try_cast("double"))
    typed = p.select("page_id", "col", "value_str", F.when(F.abs(number) < float("inf"), number).alias("value_num"))
    return chunking.digests(typed, own.select("page_id", "title"))


def section_chunks(spark, d):
    """Chunks of every page by headings and size."""
    src = pages(spark, d).join(digest_lines(spark, d), "page_id", "left")
    made = chunking.chunk_pages(src.select("page_id", "title", F.coalesce("digest", F.lit("")).alias("digest"), F.col("content_markdown").alias("markdown")))
    return chunking.with_hash(made)


def chunk_hash(spark, d):
    c = chunks(spark, d)
    return c.select("chunk_id", X.chunk_hash("heading", "text").alias("hash"), X.rune_count("text").cast("long").alias("runes")).distinct()


def edited_again(stored: DataFrame) -> DataFrame:
    """``page_id, ord, hash`` of chunks as a re-read would make them where the last chunk of every page was edited: hashed anew."""
    last = F.max("ord").over(Window.partitionBy("page_id"))
    text = F.when(F.col("ord") == last, F.concat(F.coalesce("text", F.lit("")), F.lit(" *"))).otherwise(F.col("text"))
    return stored.select("page_id", "ord", "heading", text.alias("text")).select("page_id", "ord", X.chunk_hash("heading", "text").alias("hash")).distinct()


def hash_reuse(spark, d):
    """Of every page's chunks after an edit, those whose hash was stored before, paired copy by copy."""
    old = chunks(spark, d).select("chunk_id", "page_id", "ord", "hash")
    new = edited_again(chunks(spark, d))
    return chunking.reuse(old, new).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("reused").alias("n_reused"))


def pending_vectors(spark, d):
    """Chunks of live pages without a vector of the model."""
    out = sync.embed_queue(chunks(spark, d), slim(spark, d), read(spark, d, "vectors"), MODEL)
    return out.select("chunk_id", "page_id", "content_runes").distinct()


def stale_pages(spark, d):
    return sync.content_queue(pages(spark, d)).select("page_id", "last_edited_time", "content_synced")


def known_minus_live(spark, d):
    """Pages of a source that a listing of the pages with relations would bury."""
    return sync.tombstones(slim(spark, d), relations(spark, d).select(F.col("from_id").alias("page_id"))).select("page_id")


def upsert_latest(spark, d):
    """Snapshot after the newest versions are merged over the oldest: changed pages per source."""
    p = read(spark, d, "pages").select(page_key("id").alias("page_id"), page_key("data_source_id").alias("data_source_id"), "last_edited_time", "synced_at")
    us = p.withColumns({"t": F.unix_micros(F.col("last_edited_time").try_cast("timestamp"))}).distinct()
    first = us.groupBy("page_id").agg(F.min(F.struct("t", "last_edited_time", "synced_at", "data_source_id")).alias("v")).select("page_id", "v.*")
    last = us.groupBy("page_id").agg(F.max(F.struct("t", "last_edited_time", "synced_at", "data_source_id")).alias("v")).select("page_id", "v.*")
    new, changed = sync.upsert_pages(first, last)
    return changed.join(new.select("page_id", "data_source_id"), "page_id").groupBy("data_source_id").agg(F.count(F.lit(1)).alias("n_changed"))


def watermark_slack(spark, d):
    return read(spark, d, "data_sources").select(page_key("id").alias("source_id"), X.minus_slack("watermark").alias("since")).distinct()


def canonical_id(spark, d):
    return read(spark, d, "pages").select(X.canonical_page_id("url").alias("canonical_id"), page_key("id").alias("page_id")).distinct()


def accent_fold(spark, d):
    """Distinct index terms of the documents and in how many they are."""
    t = read(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(X.terms("text"))).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))


def json_props_extract(spark, d):
    """Sum of a JSON attribute per event type."""
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"))


def eav_flatten(spark, d):
    """Source schemas to (source, column, type) rows."""
    rows = [(s, c, k) for s, text in schemas(spark, d).items() for c, k in flatten.schema_columns(text)]
    return spark.createDataFrame(rows, "source_id string, col string, type string").distinct()


def log_tail(spark, d):
    """Newest 500 entries of a log, kept by event time."""
    return sync.prune_log(read(spark, d, "events").select(F.col("event_id").alias("log_id"), "event_type", "ts")).select("log_id", "event_type")


def mirror_status(spark, d):
    """Counts of the mirror in one row."""
    p = slim(spark, d).agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_if(F.coalesce("in_trash", F.lit(0)) != 0).alias("n_trashed")
    ).withColumn("k", F.lit(1))
    c = chunks(spark, d).agg(F.count(F.lit(1)).alias("n_chunks")).withColumn("k", F.lit(1))
    s = sources(spark, d).filter("coalesce(in_trash, 0) = 0").agg(F.count_distinct("source_id").alias("n_sources")).withColumn("k", F.lit(1))
    return p.join(c, "k").join(s, "k").drop("k")


def knn_exact(spark, d):
    """Five most similar embeddings of every one whose id is divisible by 100, against all, in blocks."""
    import numpy as np
    import pandas as pd

    e = read(spark, d, "embeddings").filter("embedding IS NOT NULL").select("vec_id", "embedding")
    size, part_rows = 4096, 20_000
    parts = max(1, -(-e.count() // part_rows))
    asked = e.filter("vec_id % 100 = 0")
    blocks_ = max(1, -(-asked.count() // size))
    q = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks_)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "vec_id", "embedding")
    x = e.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks_ - 1).cast("long"))).alias("b"), F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(parts)).cast("int").alias("part"), "vec_id", "embedding")

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"vec_id": np.zeros(0, np.int64), "neighbour_id": np.zeros(0, np.int64), "similarity": np.zeros(0)})
        s = np.stack(a["embedding"].to_numpy()).astype(float) @ np.stack(b["embedding"].to_numpy()).astype(float).T
        s[a["vec_id"].to_numpy()[:, None] == b["vec_id"].to_numpy()[None, :]] = -np.inf
        n = min(5, s.shape[1])
        at = np.argsort(-s, axis=1, kind="stable")[:, :n]
        out = pd.DataFrame({"vec_id": np.repeat(a["vec_id"].to_numpy(), n), "neighbour_id": b["vec_id"].to_numpy()[at.ravel()], "similarity": np.take_along_axis(s, at, 1).ravel()})
        return out[np.isfinite(out["similarity"])]

    found = q.groupBy("b", "part").cogroup(x.groupBy("b", "part")).applyInPandas(best, "vec_id long, neighbour_id long, similarity double")
    w = Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour_id")
    return found.withColumn("r", F.row_number().over(w)).filter("r <= 5").select("vec_id", "neighbour_id", F.round("similarity", 5).alias("similarity"))


def quantize_vectors(spark, d):
    """Scale and sum of components of every embedding after int8 quantisation."""
    q = read(spark, d, "embeddings").select("vec_id", X.quantize(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.round(F.col("q.scale").cast("double"), 7).alias("scale"), F.aggregate("q.q", F.lit(0), lambda a, x: a + F.abs(x)).cast("long").alias("weight"))


def hit_mrr(spark, d):
    """Retrieval quality of both stored scores: is the page that is first by one among the first of the other?"""
    rows = read(spark, d, "search_results").select(F.col("query_id").alias("qid"), page_key("page_id").alias("page_id"), "keyword_score", "vector_score")
    ok = lambda c: F.when(~F.isnan(c), F.col(c))
    best = rows.groupBy("qid", "page_id").agg(F.max(ok("keyword_score")).alias("keyword"), F.max(ok("vector_score")).alias("vector"))

    def ranked(c: str) -> DataFrame:
        w = Window.partitionBy("qid").orderBy(F.desc(c), "page_id")
        return best.filter(F.col(c).isNotNull()).select("qid", F.lit(c).alias("mode"), "page_id", F.row_number().over(w).alias("position"))

    results = ranked("keyword").unionByName(ranked("vector"))
    first = ranked("keyword").filter("position = 1").select("qid", F.col("page_id").alias("expect"))
    cases = first.select("qid", F.explode(F.array(F.lit("keyword"), F.lit("vector"))).alias("mode"), "expect")
    return evaluate.metrics(evaluate.rank_of(results, cases)).select("mode", "cases", "hit1", "hit3", "hit5", "missed", "hit1_percent", "mrr")


#: How a line of Markdown is told to be a block: type, pattern whose first group is its text (of images the second its address).
LINES = (
    ("heading_1", r"^# +(.*)$"), ("heading_2", r"^## +(.*)$"), ("heading_3", r"^### +(.*)$"), ("to_do", r"^[-*+] \[[ xX]\] +(.*)$"),
    ("divider", r"^(-{3,})$"), ("bulleted_list_item", r"^[-*+] +(.*)$"), ("numbered_list_item", r"^[0-9]+[.)] +(.*)$"), ("quote", r"^> ?(.*)$"),
    ("equation", r"^\$\$(.+)\$\$$"), ("image", r"^!\[(.*)\]\((.*)\)$"), ("paragraph", r"^(.*)$"),
)


def line_blocks(spark: SparkSession, d: str) -> DataFrame:
    """``page_id, block_id, parent_id, ord, type, raw``: every line of every page that isn't blank as a block of its type."""
    lines = pages(spark, d).select("page_id", F.posexplode(F.split(F.coalesce("content_markdown", F.lit("")), "\n")).alias("ord", "line")).filter(F.col("line").rlike(r"\S"))
    kind, text, line = F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("line")
    for name, pattern in reversed(LINES):
        kind = F.when(line.rlike(pattern), name).otherwise(kind)
        text = F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 1)).otherwise(text)
    rows = lines.withColumns({"type": kind, "text": text})
    rich = F.array(F.struct(F.col("text").alias("plain_text")))
    is_ = lambda t: F.col("type") == t
    body = (
        F.when(is_("to_do"), F.to_json(F.struct(rich.alias("rich_text"), line.rlike(r"^[-*+] \[[xX]\]").alias("checked"))))
        .when(is_("divider"), "{}")
        .when(is_("equation"), F.to_json(F.struct(F.col("text").alias("expression"))))
        .when(is_("image"), F.to_json(F.struct(rich.alias("caption"), F.struct(F.regexp_extract(line, LINES[-2][1], 2).alias("url")).alias("external"))))
        .otherwise(F.to_json(F.struct(rich.alias("rich_text"))))
    )
    raw = F.concat(F.lit('{"'), F.col("type"), F.lit('":'), body, F.lit("}"))
    return rows.select("page_id", F.concat_ws("-", "page_id", "ord").alias("block_id"), F.lit("").alias("parent_id"), "ord", "type", raw.alias("raw"))


def markdown_render(spark, d):
    """Pages rendered from block trees: headings, lists, quotes, formulas, images, rules and paragraphs of every page."""
    return blocks.render_pages(line_blocks(spark, d))


def stream_upsert(spark, d):
    """Batches of page versions through the streaming mirror until all are read; the pages it then holds."""
    schema = T.StructType([T.StructField(n, T.IntegerType() if n == "in_trash" else T.StringType()) for n in ("page_id", "data_source_id", "last_edited_time", "synced_at", "in_trash")])
    src = read(spark, d, "pages").select(page_key("id").alias("page_id"), page_key("data_source_id").alias("data_source_id"), "last_edited_time", "synced_at", "in_trash")
    scratch = Scratch(spark)
    src.repartition(3).write.parquet(f"{scratch.root}/feed")
    mirror = sync.PageMirror(spark, f"{scratch.root}/mirror", schema)
    mirror.follow(f"{scratch.root}/feed", f"{scratch.root}/progress", files=1).awaitTermination()
    return mirror.pages().select("page_id", "data_source_id", F.col("in_trash"))


class TableApi:
    """The test tables as the service a workspace is read from."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    def sources(self) -> DataFrame:
        return read(self.spark, self.d, "data_sources").select(page_key("id").alias("source_id"), "database_id", "title", "schema_json", "in_trash", "watermark")

    def _versions(self) -> DataFrame:
        return read(self.spark, self.d, "pages").select(
            page_key("id").alias("page_id"), page_key("data_source_id").alias("data_source_id"), page_key("parent_id").alias("parent_id"),
            "title", "url", "created_time", "last_edited_time", "synced_at", "in_trash",
        )

    def changes(self, marks: DataFrame) -> DataFrame:
        own = F.broadcast(marks.withColumnRenamed("source_id", "data_source_id"))  # a row per source
        return self._versions().join(own, "data_source_id").filter("last_edited_time >= since").drop("since")

    def loose(self, since: str) -> DataFrame:
        return self._versions().filter("data_source_id = ''").filter(F.col("last_edited_time") >= since)


def synced(spark: SparkSession, d: str) -> passes.Workspace:
    """A workspace with the stored sources and watermarks after one incremental pass over the pages."""
    api, w = TableApi(spark, d), passes.Workspace(spark, f"{Scratch(spark).root}/workspace")
    w.upsert("sources", api.sources())
    w.upsert("watermarks", api.sources().select(F.col("source_id").alias("data_source_id"), "watermark"))
    w.set(passes.LOOSE, read(spark, d, "meta").filter(F.col("meta_key") == passes.LOOSE).first()["meta_value"])
    w.changes(api)
    w.loose(api)
    if w.failed:
        raise RuntimeError(str(w.failed))
    return w


def sync_pass(spark, d):
    """Pages a pass from the stored watermarks takes up, in their latest version."""
    return synced(spark, d).pages.pages().select("page_id", "last_edited_time", "in_trash")


def sync_watermarks(spark, d):
    """Watermarks after that pass."""
    return synced(spark, d).read("watermarks").select(F.col("data_source_id").alias("source_id"), "watermark")


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_scores, bm25_filtered, knn_int8, hybrid_search, keyword_only, rrf_fusion, page_collapse, relation_expand, related_out,
        recall_linked, catalog_counts, eav_pivot_view, props_flatten, props_edges, digest_lines, section_chunks, chunk_hash, hash_reuse, pending_vectors, stale_pages,
        known_minus_live, upsert_latest, watermark_slack, canonical_id, accent_fold, json_props_extract, eav_flatten, log_tail, mirror_status,
        knn_exact, quantize_vectors, hit_mrr, markdown_render, stream_upsert, sync_pass, sync_watermarks,
    )
}
