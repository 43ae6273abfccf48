"""Retrieval: exact vector ranking, page collapse, rank fusion, expansion, materialising."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.scalars import literal_weight
from quillspark.operators import postings, scoring
from quillspark.shared import Scratch

# The fusion constant, defaults of a search and the share of a related page's score.
RRF_K, LIMIT, LEAST_CANDIDATES, PER_RESULT, RELATED_SHARE = 60, 10, 40, 5, 3.0
MODES = ("hybrid", "keyword", "vector")


def page_filter(
    pages: DataFrame, sources: list[str] | None = None, ids: list[str] | None = None, since: str | None = None, until: str | None = None
) -> DataFrame:
    """Searchable pages: not in the trash; an empty list or bound filters nothing; times compare as strings, ends included."""
    out = pages.filter("coalesce(in_trash, 0) = 0")
    if sources:
        out = out.filter(F.col("data_source_id").isin(sources))
    if ids:
        out = out.filter(F.col("page_id").isin(ids))
    if since:
        out = out.filter(F.col("last_edited_time") >= since)
    if until:
        out = out.filter(F.col("last_edited_time") <= until)
    return out


def collapse(hits: DataFrame, candidates: int | None = None) -> DataFrame:
    """``qid, page_id, chunk_id, score`` to one row per page with its best chunk and its dense ``rank`` per query.

    Ties go to the smaller chunk id. The best chunk is a combinable maximum; ranks are cut at ``candidates``.
    """
    best = hits.groupBy("qid", "page_id").agg(F.max(F.struct("score", (-F.col("chunk_id")).alias("c"))).alias("b")).select(
        "qid", "page_id", (-F.col("b.c")).alias("chunk_id"), F.col("b.score").alias("score")
    )
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    ranked = best.withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= candidates) if candidates else ranked


def owners_of(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """``chunk_id, nth, page_id`` of the chunks of the given pages, written once for those who rank them and those who look pages up."""
    owners = chunks.select("chunk_id", "page_id").join(pages.select("page_id"), "page_id")
    return Scratch(chunks.sparkSession).put(postings.numbered(owners))


def cut(hits: DataFrame, owners: DataFrame, candidates: int) -> DataFrame:
    """:func:`collapse` of ``qid, chunk_id, nth, score`` where each page has one row per query at most: only the best get their page's id."""
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id", "nth")))
    return ranked.filter(F.col("rank") <= candidates).join(owners, ["chunk_id", "nth"]).select("qid", "page_id", "chunk_id", "score", "rank")


def keyword_ranking(index: DataFrame, chunks: DataFrame, pages: DataFrame, asked: DataFrame, candidates: int | None = None, owners: DataFrame | None = None) -> DataFrame:
    """Pages by their best chunk; where ranks are cut at ``candidates``, only so many pages of each part of the chunks are brought together.

    ``owners``: :func:`owners_of` ``chunks`` and ``pages``, if they are at hand.
    """
    found = postings.Matches(index, asked)
    if candidates:
        owners = owners_of(chunks, pages) if owners is None else owners
        return cut(found.best_pages(owners, candidates), owners, candidates)
    owned = chunks.select("chunk_id", "page_id").join(pages.select("page_id"), "page_id")
    return collapse(found.scores().join(owned, "chunk_id").select("qid", "page_id", "chunk_id", "score"))


def quantize_query(v: list[float]) -> tuple[float, np.ndarray]:
    """(scale, int8 components) of a query vector, in the steps of :func:`quillspark.functions.scalars.quantize`."""
    x = np.asarray(v, np.float32)
    scale = np.float32(np.abs(x).max(initial=0) / 127.0)
    if scale == 0:
        return 0.0, np.zeros(len(x), np.int32)
    y = (x.astype(float) * float(np.float32(1.0 / float(scale)))).astype(np.float32).astype(float)
    return float(scale), np.clip(np.sign(y) * np.floor(np.abs(y) + 0.5), -127, 127).astype(np.int32)


def vector_scores(vectors: DataFrame, asked: dict[int, list[float]], dim: int) -> DataFrame:
    """``qid, chunk_id, score`` of every comparable vector for the caller's query vectors, one matrix product per batch.

    Queries are quantised like the stored vectors (``chunk_id, dim, scale, vec``); stored and query vectors of another
    dimension are skipped.
    """
    kept = {q: quantize_query(v) for q, v in asked.items() if len(v) == dim}
    stored = vectors.filter((F.col("dim") == dim) & (F.octet_length("vec") == dim) & F.col("scale").isNotNull()).select("chunk_id", "scale", "vec")

    def score(batches):
        if not kept:
            return
        qids = np.array(list(kept))
        scales = np.array([s for s, _ in kept.values()])
        matrix = np.stack([x for _, x in kept.values()])
        for pdf in batches:
            x = np.frombuffer(b"".join(pdf["vec"]), np.int8).reshape(-1, dim).astype(np.int32)
            s = (x @ matrix.T).astype(float) * pdf["scale"].to_numpy().astype(float)[:, None] * scales[None, :]
            yield pd.DataFrame(
                {"qid": np.tile(qids, len(x)), "chunk_id": np.repeat(pdf["chunk_id"].to_numpy(), len(qids)), "score": s.ravel().round(6)}
            )

    return stored.mapInPandas(score, "qid long, chunk_id long, score double")


def vector_ranking(
    vectors: DataFrame, chunks: DataFrame, pages: DataFrame, asked: dict[int, list[float]], dim: int, candidates: int | None = None
) -> DataFrame:
    owned = vector_scores(vectors, asked, dim).join(chunks.select("chunk_id", "page_id"), "chunk_id").join(pages.select("page_id"), "page_id")
    return collapse(owned.select("qid", "page_id", "chunk_id", "score"), candidates)


def block_ranking(
    vectors: DataFrame, chunks: DataFrame, pages: DataFrame, asked: DataFrame, dim: int, candidates: int, size: int = 64, part_rows: int = 16384,
    owners: DataFrame | None = None,
) -> DataFrame:
    """:func:`vector_ranking` for a table of queries (``qid, query``: array of numbers) that grows with the data.

    The stored vectors of a page are brought together and searched there, in parts of whole pages: every block of ``size``
    queries meets each part once and keeps its ``candidates`` best pages of it. All tasks have the quantised queries.
    """

    def prepare(batches):
        for pdf in batches:
            kept = [(q, *quantize_query(v)) for q, v in zip(pdf["qid"], pdf["query"]) if len(v) == dim]
            yield pd.DataFrame([(q, s, x.astype(np.int8).tobytes()) for q, s, x in kept], columns=["qid", "q_scale", "q_vec"])

    owners = owners_of(chunks, pages) if owners is None else owners
    stored = vectors.filter((F.col("dim") == dim) & (F.octet_length("vec") == dim) & F.col("scale").isNotNull()).select("chunk_id", "scale", "vec")
    queries = asked.mapInPandas(prepare, "qid long, q_scale double, q_vec binary").toArrow()
    shared = vectors.sparkSession.sparkContext.broadcast((queries["qid"].to_numpy(), queries["q_scale"].to_numpy(), b"".join(queries["q_vec"].to_pylist())))
    paged = stored.join(owners, "chunk_id").repartition("page_id").sortWithinPartitions("page_id", "chunk_id").select("page_id", "chunk_id", "nth", "scale", "vec")
    exact = np.float32 if dim << 14 <= 1 << 24 else np.float64  # sums of products of int8 are exact

    def best(batches):
        qid, q_scale, q_vec = shared.value
        if not len(qid):
            return
        q_vec = np.frombuffer(q_vec, np.int8).reshape(-1, dim)
        for x in scoring.parts(batches, part_rows):
            page, chunk = pc.dictionary_encode(x["page_id"].combine_chunks()).indices.to_numpy(), x["chunk_id"].to_numpy()
            nth, scale = x["nth"].to_numpy(), x["scale"].to_numpy().astype(float)
            starts = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
            sizes = np.diff(np.r_[starts, len(page)])
            matrix = np.frombuffer(b"".join(x["vec"].to_pylist()), np.int8).reshape(-1, dim).astype(exact).T
            n = min(candidates, len(starts))
            for at in range(0, len(qid), size):
                s = (q_vec[at : at + size].astype(exact) @ matrix).astype(float)
                s *= scale[None, :]
                s *= q_scale[at : at + size, None]
                top = np.maximum.reduceat(s, starts, axis=1).round(6)
                least = np.partition(top, len(starts) - n, axis=1)[:, len(starts) - n]
                i, p = np.nonzero(top >= least[:, None])
                # of each such page, the first of its best vectors, which are sorted by chunk
                begin = np.r_[0, np.cumsum(sizes[p])[:-1]]
                rows = np.arange(sizes[p].sum()) - np.repeat(begin - starts[p], sizes[p])
                same = s[np.repeat(i, sizes[p]), rows].round(6) == np.repeat(top[i, p], sizes[p])
                first = np.minimum.reduceat(np.where(same, rows, len(page)), begin)
                order = np.lexsort((chunk[first], -top[i, p], i))
                order = order[np.arange(len(i)) - np.searchsorted(i, i) < n]
                first = first[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qid[at + i[order]]), pa.array(chunk[first]), pa.array(nth[first]), pa.array(top[i, p][order])], ["qid", "chunk_id", "nth", "score"]
                )

    return cut(paged.mapInArrow(best, "qid long, chunk_id long, nth int, score double"), owners, candidates)


def fuse(keyword: DataFrame, vector: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted reciprocal ranks of two rankings; ``weights``: ``qid, w`` of the keyword branch.

    A page absent from a branch gets nothing from it. Its chunk is the vector's unless the keyword branch ranks it
    better. Output: ``qid, page_id, chunk_id, score, kw_rank, vec_rank, keyword_score, vector_score, via, position``.
    """
    k = keyword.select("qid", "page_id", F.col("chunk_id").alias("k_chunk"), F.col("rank").alias("kw_rank"), F.col("score").alias("keyword_score"))
    v = vector.select("qid", "page_id", F.col("chunk_id").alias("v_chunk"), F.col("rank").alias("vec_rank"), F.col("score").alias("vector_score"))
    both = k.join(v, ["qid", "page_id"], "full").join(weights, "qid")
    part = lambda r, w: F.coalesce(w / (RRF_K + F.col(r)), F.lit(0.0))
    scored = both.select(
        "qid", "page_id",
        F.when(F.col("v_chunk").isNull() | (F.col("kw_rank") < F.col("vec_rank")), F.col("k_chunk")).otherwise(F.col("v_chunk")).alias("chunk_id"),
        F.round(part("vec_rank", F.lit(1.0)) + part("kw_rank", F.col("w")), 9).alias("score"),
        "kw_rank", "vec_rank", "keyword_score", "vector_score",
        F.when(F.col("k_chunk").isNull(), "vector").when(F.col("v_chunk").isNull(), "keyword").otherwise("both").alias("via"),
    )
    order = [F.desc("score"), F.col("kw_rank").asc_nulls_last(), F.col("vec_rank").asc_nulls_last()]
    return scored.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))


def edges_both_ways(relations: DataFrame) -> DataFrame:
    """``page_id, other_id, prop, out``: every distinct edge seen from both ends, so that one equality finds a page's neighbours."""
    e = relations.select("from_id", "prop", "to_id").distinct()
    return e.select(F.col("from_id").alias("page_id"), F.col("to_id").alias("other_id"), "prop", F.lit(True).alias("out")).unionByName(
        e.select(F.col("to_id").alias("page_id"), F.col("from_id").alias("other_id"), "prop", F.lit(False).alias("out"))
    )


def expand(seeds: DataFrame, relations: DataFrame, pages: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Pages one relation away from the seeds (``qid, page_id, score, position``), a third of the better parent's score.

    Edges between two seeds are skipped, so are pages in the trash; other filters don't apply here. At most
    ``min(limit, 10)`` rows per query, in order of (seed, property, page).
    """
    near = edges_both_ways(relations).join(seeds.select("qid", "page_id", "score", "position"), "page_id")
    known = seeds.select("qid", F.col("page_id").alias("other_id"))
    fresh = near.join(known, ["qid", "other_id"], "left_anti")
    live = pages.filter("coalesce(in_trash, 0) = 0").select(F.col("page_id").alias("other_id"), "title")
    best = fresh.join(live, "other_id").groupBy("qid", "other_id", "title").agg(
        F.min(F.struct("position", "prop")).alias("first"), F.max("score").alias("parent_score")
    )
    w = Window.partitionBy("qid").orderBy("first.position", "first.prop", "other_id")
    return best.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= min(limit, 10)).select(
        "qid", F.col("other_id").alias("page_id"), F.round(F.col("parent_score") / RELATED_SHARE, 9).alias("score"),
        F.lit("relation").alias("via"), F.col("title").alias("snippet"), "n",
    )


def search(
    queries: DataFrame,
    vectors_of: DataFrame | None,
    index: DataFrame,
    chunks: DataFrame,
    pages: DataFrame,
    vectors: DataFrame,
    relations: DataFrame | None = None,
    mode: str = "hybrid",
    limit: int = LIMIT,
    expand_relations: bool = False,
    dim: int = 64,
    filters: dict | None = None,
) -> DataFrame:
    """The whole search of a table of queries (``qid, text``; one row per query) as one plan.

    ``vectors_of`` (``qid, query``: array of numbers) has the queries' vectors; a query without one is ranked by keyword only,
    and with no table at all hybrid and vector modes fall back to keyword. An unknown mode runs no branch. Output: ``qid, position, page_id, title, chunk_id, snippet, score, via``.
    """
    limit = limit if limit > 0 else LIMIT
    candidates = max(PER_RESULT * limit, LEAST_CANDIDATES)
    mode = "keyword" if mode in ("hybrid", "vector") and vectors_of is None else mode
    allowed = page_filter(pages, **(filters or {}))
    nothing = queries.sparkSession.createDataFrame([], "qid long, page_id string, chunk_id long, score double, rank int")
    owners = owners_of(chunks, allowed) if mode in MODES else None
    kw = keyword_ranking(index, chunks, allowed, postings.query_terms(queries), candidates, owners) if mode in ("hybrid", "keyword") else nothing
    vec = nothing
    if mode in ("hybrid", "vector"):
        vec = block_ranking(vectors, chunks, allowed, vectors_of, dim, candidates, owners=owners)
    weights = queries.select("qid", literal_weight("text").alias("w"))
    fused = fuse(kw, vec, weights).filter(F.col("position") <= limit)
    if expand_relations and relations is not None:
        fused = Scratch(queries.sparkSession).put(fused)  # read as results, as seeds and as pages known already
    # a row per key, so where the caller wants neither text nor title, Spark leaves the join out
    texts = chunks.groupBy("page_id", "chunk_id").agg(F.min("text").alias("snippet"))
    direct = fused.join(texts, ["page_id", "chunk_id"], "left").join(pages.select("page_id", "title"), "page_id", "left").select(
        "qid", "position", "page_id", "title", "chunk_id", "snippet", "score", "via"
    )
    if not (expand_relations and relations is not None):
        return direct
    more = expand(fused, relations, pages, limit).select(
        "qid", (F.lit(limit) + F.col("n")).alias("position"), "page_id", F.col("snippet").alias("title"),
        F.lit(None).cast("long").alias("chunk_id"), "snippet", "score", "via",
    )
    return direct.unionByName(more)


def related(pages: DataFrame, relations: DataFrame, most: int = 200) -> DataFrame:
    """Outgoing links of every page, by property and title, at most 200 each: ``page_id, prop, title, url``."""
    live = pages.filter("coalesce(in_trash, 0) = 0").select(F.col("page_id").alias("to_id"), "title", "url")
    w = Window.partitionBy("page_id").orderBy("prop", "title", "to_id")
    out = relations.select(F.col("from_id").alias("page_id"), "prop", "to_id").distinct().join(live, "to_id")
    return out.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).select("page_id", "prop", "to_id", "title", "url")


def linked(pages: DataFrame, relations: DataFrame, sources: DataFrame, most: int = 200) -> DataFrame:
    """What each page is linked with in either direction: ``page_id, source, other_id, prop, title``.

    ``source`` is the title of the other page's source, or the standing name for pages outside any. Two
    properties to the same page are two rows. By source, newest first, at most 200 per page.
    """
    names = sources.select(F.col("source_id").alias("data_source_id"), F.col("title").alias("source"))
    other = pages.filter("coalesce(in_trash, 0) = 0").select(F.col("page_id").alias("other_id"), "title", "data_source_id", "last_edited_time")
    both = edges_both_ways(relations).join(other, "other_id").join(F.broadcast(names), "data_source_id", "left")
    out = both.withColumn("source", F.coalesce("source", F.lit("вне базы")))
    w = Window.partitionBy("page_id").orderBy("source", F.desc("last_edited_time"), "other_id", "prop", "out")
    return out.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).select("page_id", "source", "other_id", "prop", "title")

