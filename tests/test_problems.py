"""General problems 1, 2, 5 and 6 on small fixtures: nulls, ties, repeats, empty tables, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import hierarchy, incremental, orphans, wide
from quillspark.shared import dense_numbers, heavy_keys, spread_join

from .conftest import rows

A, B, C, D = (f"{x * 8}-{x * 4}-{x * 4}-{x * 4}-{x * 12}" for x in "abcd")
PAGE = "id string, data_source_id string, parent_id string, parent_type string, created_time string, last_edited_time string, in_trash int, content_hash string, indexed_hash string, synced_at string, _v string, version string"


def page(i, ds="", parent=None, kind=None, created="2024-01-01T00:00:00Z", edited="2025-01-01T00:00:00Z", trash=0, ch="aa", ih="aa", synced="2025-02-01T00:00:00Z"):
    return (i, ds, parent, kind, created, edited, trash, ch, ih, synced, "extra", "extra")


def frames(spark, pages, sources=(), meta=()):
    return (
        spark.createDataFrame(list(pages), PAGE),
        spark.createDataFrame(list(sources), "id string, in_trash int, watermark string, schema_json string"),
        spark.createDataFrame(list(meta), "meta_key string, meta_value string"),
    )


def test_pending_pages(spark):
    p = frames(
        spark,
        [
            page(A, ih=None),  # never indexed, before the watermark: missed
            page(A, edited="2024-01-01T00:00:00Z", ih="AA"),  # older version doesn't count
            page(B, ih="AA"),  # same hash in other case: done
            page(C, ds=D.upper().replace("-", ""), ih="bb", edited="2025-06-01T01:30:00+03:00"),  # fresh by instant
            page(C, ds=D.upper().replace("-", ""), ih="bb", edited="2025-06-01T01:30:00+03:00"),
            page(D, trash=1, ih=None),
            page("e" * 32, ds="ffffffff-ffff-ffff-ffff-ffffffffffff", ih=""),
        ],
        [(D, 0, "2025-05-31T22:29:59Z", None), ("f" * 32, 1, "", None)],
        [("loose_watermark", "2025-03-01T00:00:00Z"), (None, None)],
    )
    assert rows(incremental.pending_pages(*p)) == [(A, "missed"), (C, "fresh")]
    assert rows(incremental.pending_pages(*frames(spark, []))) == []


def test_pending_nulls(spark):
    src = spark.createDataFrame([("a", "1"), ("b", None), (None, "1")], "k string, v string")
    done = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", None)], "k string, v string")
    assert rows(incremental.pending(src, done, "k", "v")) == [("b", None)]


def test_published_runs(spark, tmp_path):
    src = spark.createDataFrame([("a", "1", "x"), ("b", "1", "y"), ("b", "1", "y")], "k string, v string, t string")
    table = incremental.PublishedTable(spark, f"file://{tmp_path}/t", "k", src.schema)
    seen = []

    def work(df):
        seen.append(df.count())
        return df

    assert table.version() == 0 and table.read().count() == 0
    incremental.run_increment(src, table, "v", work)
    changed = spark.createDataFrame([("a", "2", "x2"), ("b", "1", "y"), ("c", "1", "z")], "k string, v string, t string")

    def dies(df):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        incremental.run_increment(changed, table, "v", dies)
    table.write_delta(changed)  # written but never published
    delta = incremental.run_increment(changed, table, "v", work)
    assert rows(delta) == [("a", "2", "x2"), ("c", "1", "z")]
    assert rows(table.read()) == [("a", "2", "x2"), ("b", "1", "y"), ("c", "1", "z")]
    assert rows(table.read(1)) == [("a", "1", "x"), ("b", "1", "y")]
    incremental.run_increment(changed, table, "v", work)
    assert seen == [2, 2, 0] and table.version() == 3
    # a key that goes back to an old version is pending again
    assert rows(incremental.run_increment(src, table, "v", work)) == [("a", "1", "x")]
    table.compact()
    assert len(table.deltas()) == 1 and rows(table.read()) == [("a", "1", "x"), ("b", "1", "y"), ("c", "1", "z")]


def test_two_runs_at_once(spark, tmp_path):
    src = spark.createDataFrame([("a", "1"), ("b", "1")], "k string, v string")
    table = incremental.PublishedTable(spark, f"file://{tmp_path}/t", "k", src.schema)

    def slow(df):  # another run publishes while this one works
        incremental.run_increment(src, table, "v", lambda d: d)
        return df

    with pytest.raises(incremental.Conflict):
        incremental.run_increment(src, table, "v", slow)
    assert rows(table.read()) == [("a", "1"), ("b", "1")] and len(table.deltas()) == 1


def test_random_transform_runs_once(spark, tmp_path):
    """Keys and rows of a run come from one evaluation, so a transform that differs from call to call loses nothing."""
    src = spark.range(200).selectExpr("CAST(id AS STRING) AS k", "'1' AS v")
    table = incremental.PublishedTable(spark, f"file://{tmp_path}/t", "k", src.schema)
    some = lambda df: df.filter(F.rand() < 0.5)
    total = 0
    for _ in range(4):
        total += incremental.run_increment(src, table, "v", some).count()
    assert total == table.read().count() == table.read().select("k").distinct().count() > 150


SCHEMA = '{"Amount": {"type": "number"}, "Due": {"type": "date"}, "Done": {"type": "checkbox"}, "Tags": {"type": "multi_select"}, "url": {"type": "url"}, "score": {"type": "rich_text"}, "Score": {"type": "number"}}'


def test_wide(spark):
    entities = spark.createDataFrame([(A, "s1"), (B, "s1"), (C, "s2")], "entity string, source_id string")
    sources = spark.createDataFrame([("s1", SCHEMA), ("s2", "no json"), (None, None)], "id string, schema_json string")
    props = spark.createDataFrame(
        [
            (A, "Amount", "12"), (A, "Amount", " 12.0 "), (A, "Amount", None), (A, "Amount", ""),  # equal as numbers
            (A, "Due", "2025-01-01"),  # a date has no bare column
            (A, "date:Due:start", "2025-02-30"), (A, "date:Due:end", "2025-02-03T10:00:00.000+03:00"),
            (A, "Done", "yes"), (A, "Done", "__YES__"), (A, "Done", "__NO__"),
            (A, "Tags", '["a", "b\\"c"]'), (A, "Tags", "[1]"), (A, "score", "x"), (A, "Score", "1e999"),
            (A.upper(), "userDefined:url", "https://x"), (A, "url", None), (None, "Amount", "1"), (A, None, "1"),
            (C, "Amount", "1"), (D, "Amount", "x"),
        ],
        "page_id string, col string, value string",
    )
    w = wide.widen(props, entities, wide.declared(sources), block=2)
    got = {r["entity"]: r for r in w.rows.collect()}
    assert set(got) == {A, B, C}
    at = {c: f"c{i}" for i, (c, _) in enumerate(w.columns)}
    assert got[A][at["Amount"]] == 12.0 and got[A][at["Score"]] is None and got[A][at["score"]] == "x"
    assert got[A][at["userDefined:url"]] == "https://x" and got[B][at["Amount"]] is None
    issues = rows(w.issues())
    assert [x[1:] for x in issues if x[0] == A] == [
        ("Done", "conflict"), ("Done", "mistyped"), ("Due", "undeclared"), ("Score", "mistyped"),
        ("Tags", "mistyped"), ("date:Due:start", "mistyped"), ("url", "undeclared"),
    ]
    assert [x[1:] for x in issues if x[0] == C] == [("Amount", "undeclared")] and not [x for x in issues if x[0] == B]
    own = w.of_source("s1", [("Score", "number"), ("score", "text")])
    assert own.columns == ["page_id", "Score", "score"]
    empty = wide.widen(props.limit(0), entities.limit(0), wide.declared(sources.limit(0)))
    assert empty.rows.count() == 0


def forest(n, seed):
    rng = random.Random(seed)
    return {f"n{i}": (f"n{rng.randrange(n)}" if rng.random() < 0.8 else None) for i in range(n)}


def truth(parents):
    out = {}
    for x in parents:
        path, at = [], x
        while at is not None and at in parents and at not in path:
            path.append(at)
            at = parents[at]
        out[x] = ("", -1) if at in path else (path[-1], len(path) - 1)
    return out


@pytest.mark.parametrize("parents", [forest(60, 1), {f"n{i}": f"n{i + 1}" for i in range(40)} | {"x": "y", "y": "x", "z": "x", "s": "s"}])
def test_hierarchy(spark, parents):
    df = spark.createDataFrame([(k, v, 1) for k, v in parents.items()] + [(None, "n1", 1), ("", "n1", 1)], "id string, parent string, n int")
    h = hierarchy.build(df, with_path=True, salts=3)
    got = {r["id"]: r for r in h.nodes.collect()}
    want = truth(parents)
    assert {k: (r["root"], r["depth"]) for k, r in got.items()} == want
    tree = {k: r for k, r in got.items() if r["depth"] >= 0}
    assert len({r["pre"] for r in tree.values()}) == len(tree)
    below = lambda x: {y for y, r in tree.items() if x in r["path"][:-1]}
    for k, r in tree.items():
        assert r["path"][-1] == k and len(r["path"]) == r["depth"] + 1 and r["size"] == 1 + len(below(k))
        assert below(k) == {y for y, s in tree.items() if r["pre"] < s["pre"] < r["pre"] + r["size"]}
    pairs = rows(h.descendants(df.select("id"), bits=2))
    assert pairs == sorted(((k, y) for k in tree for y in below(k)), key=str)


def test_hierarchy_empty(spark):
    assert hierarchy.build(spark.createDataFrame([], "id string, parent string")).nodes.count() == 0


def test_orphans(spark):
    pages, _, _ = frames(
        spark,
        [page(A, edited="2025-01-31T23:30:00-01:00"), page(B, created="2025-03-01T00:00:00Z"), page(C, trash=1)],
    )
    refs = spark.createDataFrame(
        [(A.upper(), "p", B), (A, "p", B.replace("-", "")), (A, "p", C), (A, "q", D), (A, "q", ""), (A, "q", None), (C, "p", A), (None, "p", A), (D, None, D), (A, "p", A)],
        "from_id string, prop string, to_id string",
    )
    got = rows(orphans.orphans(refs.selectExpr("*", "1 AS known", "2 AS _salt"), orphans.parents_of(pages)))
    assert got == sorted(
        [
            (A, "p", B, "to", "late", "2025-02"), (A, "p", C, "to", "trashed", "2025-02"), (A, "q", D, "to", "missing", "2025-02"),
            (C, "p", A, "from", "trashed", "2025-01"), ("", "p", A, "from", "missing", ""), (D, None, D, "from", "missing", ""), (D, None, D, "to", "missing", ""),
        ],
        key=str,
    )
    assert orphans.orphans(refs.limit(0), orphans.parents_of(pages.limit(0))).count() == 0


def test_salted_merge(spark):
    refs = spark.createDataFrame([(f"r{i}", "hot" if i % 3 else f"k{i}") for i in range(60)] + [("n", None)], "ref string, key string")
    parents = spark.createDataFrame([("hot", 1), ("k3", 2)], "key string, w int")
    heavy = heavy_keys(refs, "key", 60, pieces=10)
    assert rows(heavy) == [("hot", 7)]
    got = orphans.merge_parents(refs, parents, "key", heavy, "p_")
    assert got.count() == 61 and got.filter("p_w IS NULL").count() == 20
    inner = spread_join(refs, parents, "key", heavy)
    assert inner.count() == 41 and rows(spread_join(refs, parents, "key", heavy.collect())) == rows(inner) == rows(spread_join(refs, parents, "key", []))
    # a key of two thirds of the rows is spread over its parts
    parts = inner.select("ref", "key").filter("key = 'hot'").count() / 7
    salted = refs.join(heavy, refs["key"] == heavy["_hot"]).selectExpr("pmod(xxhash64(ref), _parts) AS p").groupBy("p").count()
    assert salted.count() > 3 and salted.agg({"count": "max"}).collect()[0][0] < 3 * parts


def test_dense_numbers(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(100)], "g int, x int")
    got = rows(dense_numbers(df, ["g"], ["x"], "n", salts=4), "g", "n")
    assert got == sorted(((g, n) for g in range(3) for n in range(34 if g == 0 else 33)), key=str)
