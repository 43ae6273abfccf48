"""Queries that must cover all of their input, against counts in plain Python."""

from quillspark.functions.scalars import carries_literal
from quillspark.operators import flatten, hierarchy, search
from quillspark.plans import reference, registry

from .conftest import SMALL


def test_all_descendants(spark):
    parents = {r["id"]: r["parent"] for r in hierarchy.page_links(spark, SMALL).collect()}
    want = set()
    for i in parents:
        above, at = [], parents[i]
        while at in parents and at not in above and at != i:
            above.append(at)
            at = parents[at]
        if at not in parents:
            want |= {(a, i) for a in above}
    got = [tuple(r) for r in hierarchy.p5_descendants(spark, SMALL).select("ancestor_id", "page_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(parents[a] in parents for a, _ in got)


def test_rrf_weights(spark):
    texts, ranks = {}, {}
    for r in spark.read.parquet(f"{SMALL}/search_results.parquet").collect():
        texts[r["query_id"]] = r["query_text"]
        page = "".join(c for c in r["page_id"].strip().lower() if c != "-")
        for branch in ("keyword_score", "vector_score"):
            x = r[branch]
            if x is not None and x == x:
                best = ranks.setdefault((r["query_id"], branch), {})
                best[page] = max(best.get(page, x), x)
    want = {}
    for (q, branch), best in ranks.items():
        w = 1.0 if branch == "vector_score" or carries_literal(texts[q]) else 0.2
        for n, page in enumerate(sorted(best, key=lambda p: (-best[p], p)), 1):
            want[q, page] = want.get((q, page), 0) + w / (60 + n)
    got = {(r["qid"], r["page_id"].replace("-", "")): r["score"] for r in registry.queries()["rrf_fusion"](spark, SMALL).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in want)
    assert {carries_literal(t) for t in texts.values()} == {True, False}


def test_knn_int8_asks_all(spark):
    stored, owned = reference.vectors(spark, SMALL), reference.chunks(spark, SMALL)
    allowed = search.page_filter(reference.slim(spark, SMALL))
    asked = {r["qid"]: r["query"] for r in reference.asked_vectors(stored).collect()}
    assert asked.keys() == {r["chunk_id"] for r in stored.collect() if r["chunk_id"] % 100 == 0} != set()
    want = {tuple(r) for r in search.vector_ranking(stored, owned, allowed, asked, reference.DIM, 10).select("qid", "page_id", "chunk_id", "score", "rank").collect()}
    table = spark.createDataFrame(list(asked.items()), "qid long, query array<double>")
    for blocks in ({}, {"size": 2, "part_rows": 50}):
        got = search.block_ranking(stored, owned, allowed, table, reference.DIM, 10, **blocks).select("qid", "page_id", "chunk_id", "score", "rank").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {r["qid"] for r in registry.queries()["knn_int8"](spark, SMALL).collect()} == asked.keys()


def test_eav_pivot_all_sources(spark):
    schemas = {r["source_id"]: dict(flatten.schema_columns(r["schema_json"])) for r in reference.sources(spark, SMALL).collect()}
    live = {r["page_id"]: r for r in reference.pages(spark, SMALL).collect() if not r["in_trash"] and not r["archived"] and r["data_source_id"] in schemas}
    want = {}
    for p, r in live.items():
        for c in flatten.ROW_COLUMNS:
            x = p if c == "id" else r[c]
            if x is not None and c not in schemas[r["data_source_id"]]:
                want[p, c] = x
    for r in reference.props(spark, SMALL).collect():
        kind = schemas[live[r["page_id"]]["data_source_id"]].get(r["col"]) if r["page_id"] in live else None
        if kind and r["value"] is not None:
            x = r["value"]
            if kind == "number":
                try:
                    x = float(x)
                except ValueError:
                    continue
            at = (r["page_id"], r["col"])
            want[at] = max(want.get(at, x), x)
    got = registry.queries()["eav_pivot_view"](spark, SMALL).collect()
    assert {(r["page_id"], r["col"]): r["value"] if r["number"] is None else r["number"] for r in got} == want and len(got) == len(want)
    assert all(live[r["page_id"]]["data_source_id"] == r["source_id"] for r in got)
    assert any(r["number"] is not None for r in got) and len({r["source_id"] for r in got}) > 1
