"""Keyword searches of many queries at once, against BM25 in plain Python."""

import random
import re

import pyarrow as pa
import pytest

from quillspark.operators import postings, scoring, search
from quillspark.plans import reference

from .conftest import SMALL
from .test_mirror import asked, bm25_by_hand

N, LIVE = 120, "2025-01-01"


@pytest.fixture(scope="module")
def library(spark):
    """Chunks of a few frequent and many rare words, three to a page, and one text query per row of ``texts``."""
    rng = random.Random(7)
    frequent, rare = ["oak", "elm", "ash", "fir"], [f"x{i}q" for i in range(60)]
    docs = [[w for w in frequent if rng.random() < 0.6] + rng.sample(rare, 2) + rng.choices(frequent, k=rng.randrange(4)) for _ in range(N)]
    texts = [" ".join(rng.sample(frequent, rng.randrange(4)) + rng.sample(rare, rng.randrange(3))) for _ in range(40)] + ["x1q", "oak oak elm"]
    c = spark.createDataFrame([(i, f"p{i % 40}", 0, None, " ".join(d)) for i, d in enumerate(docs)], "chunk_id long, page_id string, ord int, heading string, text string")
    p = spark.createDataFrame(
        [(f"p{i}", None, "s", LIVE if i % 3 else "2020-01-01", int(i % 7 == 0), 0, "u") for i in range(40)],
        "page_id string, title string, data_source_id string, last_edited_time string, in_trash int, archived int, url string",
    )
    index = postings.postings(c.join(p.select("page_id", "title"), "page_id"))
    scores = {q: bm25_by_hand([{"text": d, "heading": [], "title": []} for d in docs], [(w, False) for w in t.split()], postings.FIELD_WEIGHTS) for q, t in enumerate(texts)}
    return index, c, p, asked(spark, *texts), scores


def ranked(scores, allowed, most):
    """``qid, page_id, chunk_id, rank, score`` of the best pages."""
    out = set()
    for q, own in scores.items():
        best = {}
        for i, s in enumerate(own):
            if s and allowed(i % 40):
                best.setdefault(f"p{i % 40}", []).append((-s, i))
        for rank, (s, i, page) in enumerate(sorted((*min(x), page) for page, x in best.items())[:most], 1):
            out.add((q, page, i, rank, -s))
    return out


def close(got, want):
    return {r[:4] for r in got} == {r[:4] for r in want} and all(abs(a[4] - b[4]) < 2e-6 for a, b in zip(sorted(got), sorted(want)))


@pytest.mark.parametrize("share", [0.0, 0.1, 1.0])
def test_filtered_ranking(library, monkeypatch, share):
    """Whatever counts as frequent, the ranking is the same; only the best pages of each part of the chunks are brought together."""
    index, c, p, queries, scores = library
    monkeypatch.setattr(scoring, "FREQUENT", share)
    allowed = search.page_filter(p, since="2025-01-01", until="2026-01-01")
    got = search.keyword_ranking(index, c, allowed, postings.query_terms(queries), 3).select("qid", "page_id", "chunk_id", "rank", "score").collect()
    assert close({tuple(r) for r in got}, ranked(scores, lambda i: i % 3 and i % 7, 3)) and len(got) > 80
    found = postings.Matches(index, postings.query_terms(queries)).best_pages(c.join(allowed, "page_id"), 3)
    assert found.count() <= found.rdd.getNumPartitions() * 3 * len(scores) < sum(s > 0 for x in scores.values() for s in x)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk(library):
    """All pages' ranking; scores of (query, chunk) aren't summed up over a shuffle."""
    index, c, p, queries, scores = library
    got = search.keyword_ranking(index, c, p, postings.query_terms(queries), 10).select("qid", "page_id", "chunk_id", "rank", "score")
    assert "sum(part" not in plan(got) and close({tuple(r) for r in got.collect()}, ranked(scores, lambda i: True, 10))


def test_pages_stay_whole(library):
    """A page's chunks are scored together, so no ids of pages go along with the scores; a chunk on two pages counts once in the statistics."""
    index, c, p, queries, scores = library
    shared = c.filter("chunk_id = 1").selectExpr("chunk_id", "'p2' AS page_id", "ord", "heading", "text")
    got = search.keyword_ranking(index, c.union(shared).union(shared), p, postings.query_terms(queries), 10)
    assert not re.search(r"hashpartitioning\(qid#\d+L?, page_id", plan(got))
    want = set()
    for q, own in scores.items():
        pages = {f"p{k}": [(-own[i], i) for i in [*range(k, N, 40), *[1] * (k == 2)] if own[i]] for k in range(40)}
        best = sorted((*min(x), page) for page, x in pages.items() if x)[:10]
        want |= {(q, rank, i, round(-s, 4)) for rank, (s, i, _) in enumerate(best, 1)}
    assert {(r["qid"], r["rank"], r["chunk_id"], round(r["score"], 4)) for r in got.collect()} == want
    rows = pa.RecordBatch.from_pydict({"page_id": ["a"] * 3 + ["b"] * 4 + ["c"]})
    assert ["".join(t["page_id"].to_pylist()) for t in scoring.parts((rows.slice(i, 2) for i in range(0, 8, 2)), 2)] == ["aaa", "bbbbc"]


def test_keyword_only(library):
    """A search without vectors has the positions of the keyword ranking of live pages, from one pass over the chunks."""
    index, c, p, queries, scores = library
    got = search.search(queries, None, index, c, p, None)
    want = {(q, rank, page, i) for q, page, i, rank, _ in ranked(scores, lambda i: i % 7, 10)}
    assert "sum(part" not in plan(got) and {tuple(r) for r in got.select("qid", "position", "page_id", "chunk_id").collect()} == want


def test_texts_stay_out(library, spark):
    """Where neither text nor title is asked for, they aren't read; chunks stored twice don't double results."""
    index, c, p, queries, scores = library
    read = plan(reference.keyword_only(spark, SMALL))
    assert "content_markdown" not in read and "heading" not in read
    got = search.search(queries, None, index, c.union(c), p, None)
    want = {(q, rank, page, i) for q, page, i, rank, _ in ranked(scores, lambda i: i % 7, 10)}
    assert sorted(tuple(r) for r in got.select("qid", "position", "page_id", "chunk_id").collect()) == sorted(want)


def test_all_scores(library):
    """All scores are made where the chunks are: nothing is exchanged."""
    index, _, _, queries, scores = library
    got = postings.bm25(index, postings.query_terms(queries))
    assert "Exchange" not in plan(got)
    got = {(r["qid"], r["chunk_id"]): r["score"] for r in got.collect()}
    want = {(q, i): s for q, own in scores.items() for i, s in enumerate(own) if s}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_hybrid(library, spark):
    """The keyword branch of a hybrid search sums up no scores over a shuffle; a query with a vector gets pages by either branch."""
    index, c, p, queries, scores = library
    vectors = spark.createDataFrame([(i, 2, 1.0, bytes([1 + i, 1])) for i in range(N)], "chunk_id long, dim int, scale double, vec binary")
    got = search.search(queries, spark.createDataFrame([(1, [1.0, 0.0])], "qid long, query array<double>"), index, c, p, vectors, dim=2)
    assert "sum(part" not in plan(got)
    found = {tuple(r) for r in got.select("qid", "position", "page_id", "chunk_id").collect()}
    assert {x for x in found if x[0] != 1} == {(q, rank, page, i) for q, page, i, rank, _ in ranked(scores, lambda i: i % 7, 10) if q != 1}
    assert len({x[2] for x in found if x[0] == 1}) == 10


def test_vectors_stay_single(library, spark):
    """Stored vectors aren't copied for blocks of queries; of a query for which all vectors are equal, the smallest chunks count."""
    _, c, p, _, _ = library
    vectors = spark.createDataFrame([(i, 2, 1.0, bytes([1 + i, 1])) for i in range(N)], "chunk_id long, dim int, scale double, vec binary")
    table = spark.createDataFrame([(q, [float(q % 7), float(q % 3)]) for q in range(150)], "qid long, query array<double>")
    got = search.block_ranking(vectors, c, p, table, 2, 10)
    assert "CoGroups" not in plan(got) and "Generate" not in plan(got)
    want = search.vector_ranking(vectors, c, p, {r["qid"]: r["query"] for r in table.collect()}, 2, 10)
    names = ("qid", "page_id", "chunk_id", "score", "rank")
    assert {tuple(r) for r in got.select(*names).collect()} == {tuple(r) for r in want.select(*names).collect()}
    read = plan(reference.hybrid_search(spark, SMALL))
    assert "content_markdown" not in read and "MapInArrow" not in read
