"""The mirror's own operators: contracts of flattening, views, chunking, rendering, retrieval, sync."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import convert, encoder, scalars, unigram
from quillspark.operators import blocks, chunking, evaluate, flatten, postings, search, sqltool
from quillspark.session import sql_session
from quillspark.sources import api, dump
from quillspark.streaming import passes, sync

from . import fake_service
from .conftest import SMALL, rows


def one(spark, expr, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr.alias("x")).first()["x"]


def flat(spark, props):
    df = spark.createDataFrame([("p", json.dumps(props, ensure_ascii=False))], "page_id string, properties string")
    return {r["col"]: r["value_num"] if r["value_num"] is not None else r["value_str"] for r in flatten.flatten_properties(df).collect()}


def test_flatten(spark):
    text = lambda *x: [{"type": "text", "plain_text": t} for t in x]
    got = flat(
        spark,
        {
            "Name": {"type": "title", "title": text("RAM ", "32")}, "ID": {"type": "rich_text", "rich_text": text("x")},
            "n": {"type": "number", "number": 1.5}, "none": {"type": "number", "number": None}, "s": {"type": "select", "select": {"name": "low"}},
            "st": {"type": "status", "status": None}, "m": {"type": "multi_select", "multi_select": [{"name": "R&D"}, {"name": "сад"}]},
            "d": {"type": "date", "date": {"start": "2025-01-01T10:00:00Z", "end": None}}, "d0": {"type": "date", "date": None},
            "c": {"type": "checkbox", "checkbox": True}, "mail": {"type": "email", "email": "a@b"}, "who": {"type": "people", "people": [{"id": "u1"}]},
            "by": {"type": "created_by", "created_by": {"id": "u2"}}, "nobody": {"type": "last_edited_by"}, "r": {"type": "relation", "relation": [{"id": "x1"}, {"id": "x2"}]},
            "f": {"type": "files", "files": [{"name": "a", "file": {"url": "h"}}, {"name": "b", "external": {"url": "e"}, "file": {"url": "h"}}]},
            "u": {"type": "unique_id", "unique_id": {"prefix": "T", "number": 7}}, "u2": {"type": "unique_id", "unique_id": {"prefix": None, "number": 8}},
            "fo": {"type": "formula", "formula": {"type": "boolean", "boolean": False}}, "fn": {"type": "formula", "formula": {"type": "number", "number": 2}},
            "ro": {"type": "rollup", "rollup": {"type": "array", "array": [{"type": "number", "number": 3}, {"type": "string", "string": "q"}, {"type": "people"}]}},
            "v": {"type": "verification", "verification": {"state": "ok"}}, "new": {"type": "mystery", "mystery": 1},
        },
    )
    assert got.pop("new") and got == {
        "Name": "RAM 32", "userDefined:ID": "x", "n": 1.5, "none": None, "s": "low", "st": None, "m": '["R\\u0026D","сад"]', "date:d:start": "2025-01-01T10:00:00Z",
        "date:d:end": None, "date:d:is_datetime": 1.0, "date:d0:start": None, "date:d0:end": None, "date:d0:is_datetime": None, "c": "__YES__", "mail": "a@b",
        "who": '["u1"]', "by": '["u2"]', "nobody": "null", "r": '["x1","x2"]', "f": '[{"name":"a","url":"h"},{"name":"b","url":"e"}]', "u": "T-7", "u2": 8.0,
        "fo": "__NO__", "fn": 2.0, "ro": '[3,"q",null]', "v": "ok",
    }


def test_edges_title_icon_parent(spark):
    props = json.dumps({"Rel": {"type": "relation", "relation": [{"id": "b"}, {"id": "b"}]}, "T": {"type": "title", "title": [{"plain_text": "hi"}]}})
    df = spark.createDataFrame([("a", props, '{"emoji": "X"}', '{"page_id": "", "database_id": "d"}'), ("n", None, None, None)], "page_id string, properties string, icon string, parent string")
    assert rows(flatten.flatten_edges(df)) == [("a", "Rel", "b")]
    kind, ident = flatten.parent_of(F.col("parent"))
    got = df.select(flatten.title_of(F.col("properties")).alias("t"), flatten.icon_of(F.col("icon")).alias("i"), kind.alias("k"), ident.alias("p"))
    assert rows(got) == [("", "", "", ""), ("hi", "X", "database_id", "d")]


def test_views_names_and_shadowing(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.caseSensitive", "true")
    pages = own.createDataFrame(
        [("p1", "s", "T1", "u", "", "c", "e", "md", "", 0, 0), ("p2", "s", "T2", "u", "", "c", "e", "md", "", 0, 0), ("p3", "s", "T3", "u", "", "c", "e", "md", "", 0, 1)],
        "page_id string, data_source_id string, title string, url string, icon string, created_time string, last_edited_time string, content_markdown string, parent_id string, in_trash int, archived int",
    )
    props = own.createDataFrame([("p1", "title", "own"), ("p1", "Title", "other"), ("p1", "n", "2.5")], "page_id string, col string, value string")
    columns = flatten.schema_columns('{"title": {"type": "rich_text"}, "Title": {"type": "title"}, "n": {"type": "number"}, "url": {"type": "url"}}')
    assert [c for c, _ in columns] == ["Title", "n", "title", "userDefined:url"]
    view = flatten.wide_view(pages, props, "s", columns)
    assert "url" in view.columns and view.columns.count("title") == 1
    assert {(r["id"], r["title"], r["Title"], r["n"]) for r in view.collect()} == {("p1", "own", "other", 2.5), ("p2", None, None, None)}


@pytest.mark.parametrize(
    ("text", "literal"),
    [("ZIM_FOO", True), ("mail @ida", True), ("QL77X price", True), ("plan-notes.toml", True), ("SMTP relay", True), ("ПОЛИС", False), ("2024 12", False), ("the watering plan.", False), ("RAM", False)],
)
def test_literal(text, literal):
    assert scalars.carries_literal(text) is literal
    assert scalars.keyword_weight(text) == (1.0 if literal else 0.2)


def test_literal_weight(spark):
    texts = ["ZIM_FOO", "mail @ida", "QL77X, price", "«plan-notes.toml»", "SMTP relay", "ПОЛИС", "2024 12", "the watering plan.", "RAM", "a.b.", "ab_", "x@y", "", None, "Haus№5", "(WORD)", "\u00a0QL77X"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.literal_weight("t").alias("w")).collect()
    assert [r["w"] for r in got] == [scalars.keyword_weight(t or "") for t in texts]


def test_match_expression():
    assert scalars.match_expression("a To long-word kel_x") == '"to" OR "long"* OR "word"* OR "kel_x"*'


def test_scalars(spark):
    page = "12345678123412341234123456789abC"
    assert one(spark, scalars.canonical_page_id("v"), f"https://x/{'0' * 32}/T-{page}?v=1") == page.lower()
    assert one(spark, scalars.canonical_page_id("v"), "none") == ""
    assert one(spark, scalars.clean_id("v"), f"https://x/Title-{page}?a=1") == page
    assert one(spark, scalars.normalize_id("v"), f"https://x/{page}?next=/b") == page
    assert one(spark, scalars.minus_slack("v"), "2025-01-01T00:01:30.500Z") == "2024-12-31T23:59:30Z"
    assert one(spark, scalars.minus_slack("v"), "soon") == "soon"
    assert [one(spark, scalars.display_column("v"), c) for c in ("date:D:start", "date:D:end", "userDefined:id", "x")] == ["D", "D (до)", "id", "x"]
    assert one(spark, scalars.format_number(F.lit(100.0))) == "100" and one(spark, scalars.format_number(F.lit(1.25))) == "1.25"
    assert one(spark, scalars.opaque("v"), json.dumps(["a" * 8 + "-" * 4 + "b" * 24])) is True
    assert one(spark, scalars.json_text(F.col("v")), "a<b & c") == "a\\u003cb \\u0026 c"
    assert [one(spark, scalars.nearest(F.lit(x))) for x in (2.5, -2.5, 0.4)] == [3, -3, 0]
    assert one(spark, scalars.percent(F.lit(1), F.lit(8))) == 13 and one(spark, scalars.percent(F.lit(0), F.lit(0))) == 0
    spans = [{"plain_text": " bold ", "annotations": {"bold": True, "italic": True}, "href": "u"}, {"plain_text": "x", "annotations": {"code": True, "bold": True}}, {"type": "equation", "plain_text": "e", "equation": {"expression": "e^x"}}]
    native = one(spark, scalars.rich_markdown(F.from_json("v", scalars.SPAN)), json.dumps(spans))
    assert native == blocks.spans(spans) == " [_**bold**_](u) `x`$e^x$"
    assert rows(spark.createDataFrame([("Ärger Straße, kel_x Й",)], "v string").select(scalars.terms("v").alias("t")))[0][0] == ["arger", "straße", "kel", "x", "й"]


def test_quantize(spark):
    rng = np.random.default_rng(3)
    v = [rng.normal(size=16).astype(np.float32).tolist(), [0.0] * 16]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v array<float>").select("i", scalars.quantize(F.col("v")).alias("q")).orderBy("i").collect()
    scale, q = search.quantize_query(v[0])
    assert got[0]["q"]["q"] == q.tolist() and got[0]["q"]["scale"] == pytest.approx(scale) and got[1]["q"]["scale"] == 0
    same = spark.createDataFrame([(v[0],)], "v array<float>").select(scalars.dot_quantized(scalars.quantize(F.col("v")), scalars.quantize(F.col("v"))).alias("d")).first()["d"]
    assert same == pytest.approx(float(np.dot(v[0], v[0])), rel=0.02)


def test_sections_and_sizes():
    md = "intro\n# A\n## B\ntext\n## C\nmore\n##no\n```\n# in code\n```\n"
    assert [h for h, _ in chunking.sections(md)] == ["", "A › B", "A › C", "in code"]
    assert [h for h, _ in chunking.sections("## one\na\n## two\nb\n## three\nc")] == ["one", "one › two", "one › three"]
    assert chunking.sections("# only\n## headings\n") == []
    long = "\n\n".join(["p" * 300] * 4 + ["q" * 1201])
    assert [len(x) for x in chunking.by_size(long)] == [300, 300, 300, 300, 500, 500, 201]
    assert chunking.by_size("x" * 800) == ["x" * 800]
    assert chunking.units("T", "d: 1", "") == [("", "T\nd: 1")] and chunking.units(None, None, None) == []
    assert chunking.units("T", "", "# H\nbody") == [("H", "T\n\nbody")]


def test_digest(spark):
    props = spark.createDataFrame(
        [("p", "b", "T", None), ("p", "c", "__YES__", None), ("p", "d", "__NO__", None), ("p", "date:D:end", "2025", None), ("p", "date:D:is_datetime", None, 1.0), ("p", "a", None, 2.50), ("p", "e", json.dumps(["1" * 32, "a-" * 18]), None)],
        "page_id string, col string, value_str string, value_num double",
    )
    titles = spark.createDataFrame([("p", "T")], "page_id string, title string")
    assert rows(chunking.digests(props, titles)) == [("p", "a: 2.5\nc: да\nD (до): 2025")]


def test_reuse_pairs_copies(spark):
    old = spark.createDataFrame([(10, "p", 0, "h"), (11, "p", 1, "h"), (12, "p", 2, "g")], "chunk_id long, page_id string, ord int, hash string")
    new = spark.createDataFrame([("p", 0, "h"), ("p", 1, "x"), ("p", 2, "h"), ("p", 3, "h")], "page_id string, ord int, hash string")
    got = {r["ord"]: r["chunk_id"] for r in chunking.reuse(old, new).collect() if r["reused"]}
    assert got == {0: 10, 2: 11}


def block(i, kind, body=None, parent="", n=0):
    return ("p", i, parent, n, kind, json.dumps({kind: body or {}}))


def test_render(spark):
    t = lambda s: {"rich_text": [{"plain_text": s}]}
    cells = lambda *x: {"cells": [[{"plain_text": c}] for c in x]}
    b = [
        block("1", "heading_2", t("H"), n=0), block("2", "numbered_list_item", t("one"), n=1), block("3", "numbered_list_item", t("two"), n=2),
        block("3a", "bulleted_list_item", t("in"), "3", 0), block("4", "paragraph", t("two\nlines"), n=3), block("5", "numbered_list_item", t("again"), n=4),
        block("6", "to_do", t("x") | {"checked": True}, n=5), block("7", "code", t("a = 1") | {"language": "py"}, n=6), block("8", "table", {"has_column_header": True}, n=7),
        block("8a", "table_row", cells("a|b", "c"), "8", 0), block("8b", "table_row", cells("d"), "8", 1), block("9", "callout", t("note\nmore") | {"icon": {"emoji": "!"}}, n=8),
        block("10", "image", {"external": {"url": "u"}}, n=9), block("11", "child_page", {"title": "sub"}, n=10), block("12", "strange", t("kept"), n=11), block("13", "breadcrumb", n=12),
    ]
    df = spark.createDataFrame(b, "page_id string, block_id string, parent_id string, ord int, type string, raw string")
    assert rows(blocks.render_pages(df))[0][1] == (
        "## H\n\n1. one\n2. two\n\t- in\ntwo\nlines\n\n1. again\n- [x] x\n```py\na = 1\n```\n\n| a\\|b | c |\n| --- | --- |\n| d |  |\n\n"
        '> ! note\n> more\n\n![image](u)\n\n<page id="11">sub</page>\n\nkept\n'
    )
    assert blocks.render([]) == "\n"


def corpus(spark):
    chunks = [(1, "p1", 0, "", "memory RAM modules of the server"), (2, "p1", 1, "RAM", "thirty two gigabytes"), (3, "p2", 0, "", "watering the garden kel_x twice"), (4, "p3", 0, "", "money spent on garden tools"), (5, "p3", 1, None, None)]
    c = spark.createDataFrame(chunks, "chunk_id long, page_id string, ord int, heading string, text string")
    p = spark.createDataFrame(
        [("p1", "Memory", "s1", "2025-01-01", 0, 0, "u1"), ("p2", "Watering", "s1", "2025-02-01", 0, 0, "u2"), ("p3", "Money", "s2", "2025-03-01", 0, 0, "u3"), ("p4", "Gone", "s2", "2025-03-01", 1, 0, "u4")],
        "page_id string, title string, data_source_id string, last_edited_time string, in_trash int, archived int, url string",
    )
    return c, p


def bm25_by_hand(docs, terms_, weights):
    n, lens = len(docs), [sum(map(len, d.values())) for d in docs]
    avg, out = sum(lens) / n, [0.0] * n
    for t, prefix in terms_:
        f = [sum(w * sum(x.startswith(t) if prefix else x == t for x in d[k]) for k, w in weights.items()) for d in docs]
        df = sum(x > 0 for x in f)
        if df:
            idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
            for i in range(n):
                out[i] += idf * f[i] * 2.2 / (f[i] + 1.2 * (0.25 + 0.75 * lens[i] / avg)) if f[i] else 0
    return [round(x, 6) for x in out]


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, text string")


def test_query_terms(spark):
    texts = ["Garden RAM mem x", "kel_x Ünït", "", None, " ".join(f"w{i}" for i in range(50))]
    got = {}
    for r in postings.query_terms(asked(spark, *texts)).collect():
        got.setdefault((r["qid"], r["tno"]), []).append((r["j"], r["token"], r["prefix"]))
    want = {(q, t): w for q, text in enumerate(texts) for t, w in enumerate(scalars.match_terms(text or ""))}
    assert got.keys() == want.keys() and len([k for k in got if k[0] == 4]) == 32
    assert sorted(got[1, 0]) == [(0, "kel", False), (1, "x", True)] and got[1, 1] == [(0, "unit", True)] and all(any(x[2] for x in got[k]) == want[k][1] for k in got)


def test_bm25(spark):
    c, p = corpus(spark)
    titled = c.join(p.select("page_id", "title"), "page_id")
    index = postings.postings(titled)
    got = {r["chunk_id"]: r["score"] for r in postings.bm25(index, postings.query_terms(asked(spark, "garden ram mem"))).collect()}
    docs = [
        {"text": "memory ram modules of the server".split(), "heading": [], "title": ["memory"]}, {"text": "thirty two gigabytes".split(), "heading": ["ram"], "title": ["memory"]},
        {"text": "watering the garden kel x twice".split(), "heading": [], "title": ["watering"]}, {"text": "money spent on garden tools".split(), "heading": [], "title": ["money"]}, {"text": [], "heading": [], "title": ["money"]},
    ]
    want = bm25_by_hand(docs, [("garden", True), ("ram", False), ("mem", False)], postings.FIELD_WEIGHTS)
    assert got == {i + 1: s for i, s in enumerate(want) if s}
    phrase = postings.bm25(index, postings.query_terms(asked(spark, "kel_x")))
    assert [r["chunk_id"] for r in phrase.collect()] == [3]
    assert postings.bm25(index, postings.query_terms(asked(spark, "kel_twice"))).count() == 0


def test_search(spark):
    c, p = corpus(spark)
    e = encoder.HashEmbedder(32)
    vec = encoder.embed_chunks(c.fillna(""), e)
    index = postings.postings(c.join(p.select("page_id", "title"), "page_id"))
    rel = spark.createDataFrame([("p1", "Related", "p3"), ("p4", "Related", "p1"), ("p1", "Related", "p3")], "from_id string, prop string, to_id string")
    go = lambda mode="hybrid", v=True, limit=2, **k: search.search(
        asked(spark, "RAM modules"), spark.createDataFrame([(0, e.embed_query("RAM modules").tolist())], "qid long, query array<double>") if v else None, index, c, p, vec, rel, mode, limit=limit, dim=32, **k
    )
    first = go().orderBy("position").collect()
    assert first[0]["page_id"] == "p1" and first[0]["via"] == "both" and len({r["page_id"] for r in first}) == len(first)
    assert first[0]["score"] == pytest.approx(1 / 61 + 0.2 / 61)
    assert {r["via"] for r in go("hybrid", v=False).collect()} == {"keyword"} and go("odd").count() == 0
    only = go(filters={"sources": ["s2"]}).collect()
    assert {r["page_id"] for r in only} == {"p3"}
    more = go("keyword", limit=1, expand_relations=True).orderBy("position").collect()
    assert [(r["page_id"], r["via"]) for r in more] == [("p1", "keyword"), ("p3", "relation")] and more[1]["score"] == pytest.approx(more[0]["score"] / 3)
    assert rows(search.linked(p, rel, spark.createDataFrame([("s1", "One")], "source_id string, title string")), "page_id", "source", "other_id") == [
        ("p1", "вне базы", "p3"), ("p3", "One", "p1"), ("p4", "One", "p1"),
    ]
    assert rows(search.related(p, rel), "page_id", "to_id") == [("p1", "p3"), ("p4", "p1")]


def test_evaluate(spark):
    with pytest.raises(ValueError, match="case 2"):
        evaluate.read_cases('[{"q": "a", "expect": "b"}, {"q": "a"}]')
    ranks = spark.createDataFrame([(1, "h", 1), (2, "h", 4), (3, "h", 0), (1, "k", 2), (2, "k", 0), (3, "k", 0)], "qid int, mode string, rank int")
    m = {r["mode"]: r for r in evaluate.metrics(ranks).collect()}
    assert (m["h"]["hit1"], m["h"]["hit3"], m["h"]["hit5"], m["h"]["missed"], m["h"]["hit1_percent"], m["h"]["mrr"]) == (1, 1, 2, 1, 33, 0.416667)
    text = evaluate.report(ranks)
    assert "case 2: best rank 4" in text and "case 3: best rank none" in text and "case 1:" not in text


def test_read_only(spark):
    for bad in ("DELETE FROM x", "SELECT 1; DROP TABLE x", "SELECT ';x'"):
        with pytest.raises(sqltool.NotReadOnly):
            sqltool.check_text(bad)
    with pytest.raises(sqltool.NotReadOnly):
        sqltool.check_plan(spark, "WITH a AS (SELECT 1 AS x) INSERT INTO t SELECT * FROM a")
    sqltool.check_plan(spark, "WITH a AS (SELECT 1 AS x) SELECT * FROM a WHERE x IN (SELECT 1)")
    got = sqltool.fetch(spark, "SELECT id FROM range(10) WHERE id >= ?", [3], limit=4)
    assert got["truncated"] and len(got["rows"]) == 4 and sqltool.fetch(spark, "(SELECT 1 AS a)", limit=-1)["rows"] == [[1]]


def test_sync(spark, tmp_path):
    schema = "page_id string, data_source_id string, last_edited_time string, synced_at string, in_trash int"
    snap = spark.createDataFrame([("a", "s", "2", "1", 0), ("b", "s", "1", "1", 0), ("l", "", "1", "1", 0)], schema)
    batch = spark.createDataFrame([("a", "", "1", "2", 0), ("b", "s", "1", "2", 0), ("c", "s", "5", "2", 0)], schema)
    new, changed = sync.upsert_pages(snap, batch)
    assert rows(changed) == [("a",), ("c",)] and ("a", "s", "1", "2", 0) in rows(new) and new.count() == 4
    again, none = sync.upsert_pages(new, batch)
    assert none.count() == 0 and rows(again) == rows(new)
    gone = sync.tombstones(new, batch.filter("page_id <> 'b'"))
    assert rows(gone, "page_id") == [("b",)]
    assert rows(sync.bury(new, gone).filter("in_trash = 1"), "page_id") == [("b",)]
    kids = spark.createDataFrame([("a", "x"), ("b", "y")], "page_id string, v string")
    assert rows(sync.replace_children(kids, changed, kids.limit(0))) == [("b", "y")]
    marks = spark.createDataFrame([("s", "3"), ("t", "9")], "data_source_id string, watermark string")
    assert rows(sync.watermarks(new, marks)) == [("", "1"), ("s", "5"), ("t", "9")]
    m = sync.PageMirror(spark, f"file://{tmp_path}/m", new.schema)
    assert m.pass_over({"ok": lambda: batch, "bad": lambda: 1 / 0}) == ["ok"] and m.failed[0][0] == "bad"
    assert m.pages().count() == 3 and rows(m.reconcile(batch.filter("page_id = 'b'")), "page_id", "in_trash") == [("c", 1)]


def test_mirror_batches(spark, tmp_path):
    schema = "page_id string, data_source_id string, last_edited_time string, synced_at string, in_trash int"
    make = lambda *r: spark.createDataFrame(list(r), schema)
    m = sync.PageMirror(spark, f"file://{tmp_path}/m", make(("", "", "", "", 0)).schema)
    m.apply(make(("a", "s", "2025-01-01T12:00:00+03:00", "1", 0), ("a", "s", "2025-01-01T10:00:00Z", "1", 1), ("b", "s", "2025-01-01T00:00:00Z", "1", 0), (None, "s", "2", "1", 0)))
    assert rows(m.pages(), "page_id", "in_trash") == [("a", 1), ("b", 0)]  # 12:00+03:00 is earlier than 10:00Z
    older = make(("a", "t", "2025-01-01T09:59:59Z", "9", 0), ("b", "", "2025-01-02T00:00:00Z", "1", 0))
    assert rows(m.apply(older), "page_id", "data_source_id") == [("b", "s")]  # an older version in a later batch changes nothing
    assert m.apply(older).count() == 0 and rows(m.pages(), "page_id", "last_edited_time") == [("a", "2025-01-01T10:00:00Z"), ("b", "2025-01-02T00:00:00Z")]
    assert len(m.table.deltas()) == 3


def test_mirror_stream(spark, tmp_path):
    """Files of two batches through the stream, the newer version first."""
    schema = "page_id string, data_source_id string, last_edited_time string, synced_at string, in_trash int"
    feed = f"file://{tmp_path}/feed"
    first = spark.createDataFrame([("a", "s", "2025-02-01T00:00:00Z", "1", 0), ("b", "s", "2025-01-01T00:00:00Z", "1", 0)], schema)
    m = sync.PageMirror(spark, f"file://{tmp_path}/m", first.schema)
    for batch in (first, spark.createDataFrame([("a", "s", "2025-01-01T00:00:00Z", "2", 1), ("c", "s", "2025-01-01T00:00:00Z", "1", 0)], schema)):
        batch.coalesce(1).write.mode("append").parquet(feed)
        m.follow(feed, f"file://{tmp_path}/progress", files=1).awaitTermination()
    assert rows(m.pages(), "page_id", "in_trash") == [("a", 0), ("b", 0), ("c", 0)] and m.table.version() == 2


class FakeApi:
    """A workspace in lists: pages ``id, source, title, edited, text``; ``broken`` names what can't be read."""

    def __init__(self, spark, pages, broken=()):
        self.spark, self.pages, self.broken, self.asked = spark, pages, set(broken), []

    def sources(self):
        if "sources" in self.broken:
            raise RuntimeError("no such endpoint")
        return self.spark.createDataFrame([("s1", "d", "One", "{}", 0), ("s2", "d", "Two", "{}", 0), ("s3", "d", "Gone", "{}", 1)], passes.TABLES["sources"][1])

    def databases(self):
        return self.spark.createDataFrame([("d", "D", "u", "", 0)], passes.TABLES["databases"][1])

    def sources_of(self, databases):
        return self.spark.createDataFrame([("s1", databases.first()["id"], "One", "{}", 0)], passes.TABLES["sources"][1])

    def users(self):
        return self.spark.createDataFrame([("u", "Ida", "person", "i@x"), ("u", "Ida", "person", "i@x")], passes.TABLES["users"][1])

    def rows(self, keep):
        return self.spark.createDataFrame([(i, s, "", t, "", e, e, "1", 0) for i, s, t, e, _ in self.pages if keep(s, e)], passes.PAGES)

    def changes(self, marks):
        since = {r["source_id"]: r["since"] for r in marks.collect()}
        self.asked.append(since)
        if self.broken & set(since):
            raise RuntimeError("timeout")
        return self.rows(lambda s, e: s in since and e >= since[s])

    def loose(self, since):
        return self.rows(lambda s, e: s == "" and e >= since)

    def contents(self, pages):
        own = self.spark.createDataFrame([(i, x) for i, _, _, _, x in self.pages if x is not None], "page_id string, content_markdown string")
        return own.join(pages, "page_id")


def test_workspace(spark, tmp_path):
    api = FakeApi(spark, [("a", "s1", "A", "2025-01-01T10:00:00Z", "# H\n\none\n\n## I\n\ntwo"), ("b", "s2", "B", "2025-01-02T10:00:00Z", "bee"), ("l", "", "L", "2025-01-03T10:00:00Z", None)], broken={"sources"})
    w = passes.Workspace(spark, f"file://{tmp_path}/w")
    # discovery falls back to the databases; a failure leaves the flag unset, so the next start begins again
    assert w.bootstrap(api) and w.get(passes.BOOTSTRAPPED) is None and [r["source_id"] for r in w.read("sources").collect()] == ["s1"]
    api.broken, w.failed = {"s2"}, []
    assert w.bootstrap(api) and w.failed[0][0] == "s2" and rows(w.pages.pages(), "page_id") == [("a",), ("l",)]
    api.broken, w.failed = set(), []
    assert w.bootstrap(api) and not w.bootstrap(api) and rows(w.read("users"), "name") == [("Ida",)]
    assert rows(w.read("watermarks")) == [("s1", "2025-01-01T10:00:00Z"), ("s2", "2025-01-02T10:00:00Z")] and w.get(passes.LOOSE) == "2025-01-03T10:00:00Z"
    chunks = {(r["page_id"], r["ord"]): r["chunk_id"] for r in w.read("chunks").collect()}
    assert set(chunks) == {("a", 0), ("a", 1), ("b", 0)} and rows(w.stale(), "page_id") == [("l",)]
    e = encoder.HashEmbedder(16)
    assert [w.embed(e, 2), w.embed(e, 2), w.embed(e, 2)] == [2, 1, 0]
    # an edit: read from two minutes before the watermark; the chunk that stayed keeps its id and vector
    api.pages[0] = ("a", "s1", "A", "2025-01-01T10:01:00Z", "# H\n\none\n\n## I\n\nthree")
    assert w.run(api) == {"sources": 2, "buried": 0, "contents": 1} and api.asked[-1] == {"s1": "2025-01-01T09:58:00Z", "s2": "2025-01-02T09:58:00Z"}
    after = {(r["page_id"], r["ord"]): r["chunk_id"] for r in w.read("chunks").collect()}
    assert after["a", 0] == chunks["a", 0] and after["a", 1] != chunks["a", 1] and w.embed(e) == 1
    # a full pass buries what is gone, inside sources only, and drops it from the index
    del api.pages[1:]
    assert w.run(api, full=True)["buried"] == 1 and not w.failed
    assert rows(w.pages.pages().filter("in_trash = 1"), "page_id") == [("b",)] and {r["page_id"] for r in w.read("chunks").collect()} == {"a"}
    w.set("k", "1")
    w.set("k", "2")
    assert w.get("k") == "2" and w.get("none") is None


def test_block_trees(spark):
    b = spark.createDataFrame(
        [("p", "1", "", 0, "toggle"), ("p", "2", "1", 0, "paragraph"), ("p", "3", "2", 0, "paragraph"), ("p", "4", "", 1, "child_page"), ("p", "5", "4", 0, "paragraph"), ("p", "6", "", 2, "paragraph")],
        "page_id string, block_id string, parent_id string, ord int, type string",
    )
    assert rows(sync.block_trees(b, depth=2), "block_id") == [("1",), ("2",), ("4",), ("6",)]
    assert rows(sync.block_trees(b, most=3), "block_id") == [("1",), ("2",), ("3",)]


def test_listing(spark, tmp_path):
    for n in range(2):
        (tmp_path / f"{n}.json").write_text(json.dumps({"object": "list", "has_more": n == 0, "results": [{"object": "page", "id": f"p{n}", "last_edited_time": f"202{n}", "properties": {}}, {"object": "user", "id": "u"}]}))
    assert rows(dump.listing(spark, str(tmp_path), since="2021", object="page"), "id") == [("p1",)]


def test_api_source(spark):
    opts = {"base": "http://x", "token": "t", "transport": "tests.fake_service:call", "rate": "100000"}
    assert api.read(spark, kind="source", ids="s0,s1", since="2025-01-01T01:40:00Z", **opts).selectExpr("count(*)", "count(DISTINCT id)", "min(last_edited_time)").first()[:] == (150, 150, "2025-01-01T01:40:00Z")
    assert api.read(spark, kind="search", since="2025-01-01T04:00:00Z", **opts).count() == 10 and api.read(spark, kind="users", **opts).count() == 120
    with pytest.raises(Exception, match="401"):
        api.read(spark, kind="users", **(opts | {"token": ""})).count()


def test_api_stops_early_and_waits():
    fake_service.SEEN.clear()
    waits, now = [], [0.0]

    def sleep(s):
        waits.append(s)
        now[0] += s

    client = api.Client("http://x", "t", fake_service.call, rate=2.5, sleep=sleep, clock=lambda: now[0])
    assert len(list(api.objects(client, "search", "", "2025-01-01T04:00:00Z"))) == 10 and len(fake_service.SEEN) == 1  # of three pages
    assert [o["id"] for o in api.objects(client, "source", "s1", "")][:2] == ["p1", "p3"] and waits == pytest.approx([0.4] * 2)
    waits.clear()
    dead = api.Client("http://x", "t", lambda *a: (500, {}, "no"), sleep=sleep, clock=lambda: now[0])
    with pytest.raises(api.ApiError):
        dead.call("GET", "users")
    assert [w for w in waits if w != 0.4] == [0.5, 1.0, 2.0, 4.0, 8.0]
    asked = iter([(429, {"Retry-After": "90"}, ""), (200, {}, "{}")])
    waits.clear()
    assert api.Client("http://x", "", lambda *a: next(asked), sleep=sleep, clock=lambda: now[0]).call("GET", "users") == {} and waits == [30.0]


def test_api_stream():
    s = api.PagedApiStream({"ids": "s0", "since": "2025-01-01T04:00:00Z", "base": "http://x", "token": "t", "transport": "tests.fake_service:call", "rate": "100000"})
    batch, end = s.read(s.initialOffset())
    assert len(list(batch)) == 5 and end == {"s0": "2025-01-01T04:08:00Z"}
    again, same = s.read(end)
    assert [r[0] for r in again] == ["p248"] and same == end and len(list(s.readBetweenOffsets(s.initialOffset(), {"s0": "2025-01-01T04:02:00Z"}))) == 2


def test_dialect(spark):
    own = sql_session(spark)
    sqltool.register_shims(own)
    got = sqltool.fetch(own, "SELECT group_concat(x) AS a, total(n) AS b, json_group_array(iif(n > 1, n * 2, 0)) AS c, strftime('%Y-%m-%dT%H', '2025-03-04T05:06:07Z') AS d, 'total(1)' AS e FROM (VALUES ('p', 1), ('q', 2)) AS v(x, n)")
    assert got["rows"] == [["p,q", 3.0, "[0,4]", "2025-03-04T05", "total(1)"]]
    assert sqltool.fetch(own, "SELECT total(n) AS t, group_concat(x, ' - ') AS g FROM (SELECT 1 AS n, 'a' AS x) WHERE n > 5")["rows"] == [[0.0, None]]
    assert sqltool.translate("SELECT \"iif(\", iif(a, ')', iif(b, 1, 2)) FROM t") == "SELECT \"iif(\", if(a, ')', if(b, 1, 2)) FROM t" and sqltool.translate("total(") == "total("


def test_views_made_again(spark):
    source = "11111111-1111-1111-1111-111111111111"
    own = sql_session(spark)
    pages = own.createDataFrame([("p", source, "t", 0, 0, None, None, None, None, None, None)], "page_id string, data_source_id string, title string, in_trash int, archived int, url string, icon string, created_time string, last_edited_time string, content_markdown string, parent_id string")
    props = own.createDataFrame([("p", "N", "1"), ("p", "M", "x")], "page_id string, col string, value string")
    make = lambda text: own.createDataFrame([(source, text)], "source_id string, schema_json string")
    known = {}
    assert flatten.register_views(own, pages, props, make('{"N": {"type": "number"}}'), known) == [f"collection://{source}"]
    assert flatten.register_views(own, pages, props, make('{"N": {"type": "number"}}'), known) == []
    assert flatten.register_views(own, pages, props, make('{"N": {"type": "number"}, "M": {"type": "select"}}'), known) == [f"collection://{source}"]
    assert own.sql(f'SELECT N, M FROM "collection://{source}"').first()[:] == (1.0, "x")


def test_weights(tmp_path):
    t = {"a": np.arange(6, dtype=np.float32).reshape(2, 3), "b": np.arange(5, dtype=np.int8)}
    dump.write_blob(f"{tmp_path}/w", {"dim": 3}, t)
    meta, got = dump.read_blob(f"{tmp_path}/w")
    assert meta == {"dim": 3} and all((got[k] == t[k]).all() for k in t)
    raw = {"x": np.array([1.5, -2], np.float16), "y": np.array([0x3FC0], np.uint16)}
    header = json.dumps({"x": {"dtype": "F16", "shape": [2], "data_offsets": [0, 4]}, "y": {"dtype": "BF16", "shape": [1], "data_offsets": [4, 6]}}).encode()
    (tmp_path / "s").write_bytes(len(header).to_bytes(8, "little") + header + raw["x"].tobytes() + raw["y"].tobytes())
    got = dump.read_safetensors(f"{tmp_path}/s")
    assert got["x"].tolist() == [1.5, -2] and got["y"].tolist() == [1.5]


def test_unigram():
    m = unigram.MARK
    assert unigram.normalize("") == "" and unigram.normalize("  a​b \n") == f"{m}a{m}b{m}" and unigram.normalize("ｘ\x07y") == f"{m}xy" and unigram.normalize(" ") == m
    v = unigram.Unigram({m: (5, -2.0), f"{m}ab": (6, -1.0), "a": (7, -3.0), "b": (8, -3.0), "c": (9, -1.0)}, added={"<mask>": 99})
    assert v.tokens("abc") == [6, 9] and v.tokens("ab<mask>c") == [6, 99, 5, 9] and v.tokens("z") == [5, 0]
    assert v.encode("abc abc", 4) == [1, 6, 9, 2]


def test_encoder_close_to_float():
    rng, h, f = np.random.default_rng(5), 16, 32
    t = {"words": rng.normal(size=(12, h)), "positions": rng.normal(size=(8, h)), "types": rng.normal(size=(1, h))}
    norms = ["emb"]
    for k in range(2):
        t |= {f"{k}.{m}": rng.normal(size=(h, h)) / 4 for m in ("query", "key", "value", "out")} | {f"{k}.up": rng.normal(size=(f, h)) / 4, f"{k}.down": rng.normal(size=(h, f)) / 4}
        norms += [f"{k}.attn", f"{k}.ffn"]
    t |= {f"{n}.gain": np.ones(h) for n in norms} | {f"{n}.bias": np.zeros(h) for n in norms}
    vocab = unigram.Unigram({c: (i + 3, -1.0) for i, c in enumerate("abcdefg▁")})
    enc = encoder.Encoder(t, vocab, layers=2, heads=4)
    got = enc.embed_query("ab cd")
    assert len(got) == h and np.linalg.norm(got) == pytest.approx(1, abs=1e-5) and not np.allclose(got, enc.embed_passage("g"))
    exact, kept = {k: v for k, v in t.items() if np.ndim(v) == 2}, encoder.linear
    names = {id(enc.t[k]): v for k, v in exact.items()}
    encoder.linear = lambda x, w, b: (x @ names[id(w)].T).astype(np.float32)
    try:
        assert float(enc.embed_query("ab cd") @ got) > 0.99
    finally:
        encoder.linear = kept


def write_safetensors(path, tensors):
    header, at = {}, 0
    for k, v in tensors.items():
        header[k] = {"dtype": "F32", "shape": list(v.shape), "data_offsets": [at, at + v.nbytes]}
        at += v.nbytes
    raw = json.dumps(header).encode()
    path.write_bytes(len(raw).to_bytes(8, "little") + raw + b"".join(v.tobytes() for v in tensors.values()))


def test_convert(tmp_path):
    rng, h = np.random.default_rng(7), 8
    make = lambda *shape: rng.normal(size=shape).astype(np.float32)
    pieces = [("<s>", 0.0), ("</s>", 0.0), ("<unk>", 0.0), (unigram.MARK, -2.0), (unigram.MARK + "a", -1.0), ("b", -3.0), ("é", -4.0)]
    t = {"embeddings.word_embeddings.weight": make(7, h), "embeddings.position_embeddings.weight": make(16, h), "embeddings.token_type_embeddings.weight": make(2, h)}
    norm = lambda k: {f"{k}.weight": np.ones(h, np.float32), f"{k}.bias": np.zeros(h, np.float32)}
    t |= norm("embeddings.LayerNorm") | norm("encoder.layer.0.attention.output.LayerNorm") | norm("encoder.layer.0.output.LayerNorm")
    for k, o, i in (("attention.self.query", h, h), ("attention.self.key", h, h), ("attention.self.value", h, h), ("attention.output.dense", h, h), ("intermediate.dense", 16, h), ("output.dense", h, 16)):
        t |= {f"encoder.layer.0.{k}.weight": make(o, i), f"encoder.layer.0.{k}.bias": make(o)}
    write_safetensors(tmp_path / "model.safetensors", {f"bert.{k}": v for k, v in t.items()})
    config = {"model_type": "bert", "hidden_act": "gelu", "num_hidden_layers": 1, "num_attention_heads": 2, "max_position_embeddings": 16}
    (tmp_path / "config.json").write_text(json.dumps(config))
    tokenizer = {"model": {"type": "Unigram", "unk_id": 2, "vocab": pieces}, "added_tokens": [{"id": i, "content": p} for i, (p, _) in enumerate(pieces[:3])]}
    (tmp_path / "tokenizer.json").write_text(json.dumps(tokenizer))
    made = convert.convert(str(tmp_path), str(tmp_path / "w"), "tiny")
    again = convert.load(str(tmp_path / "w"))
    assert again.vocabulary.encode("ab é") == [0, 4, 5, 3, 6, 1] and again.vocabulary.encode("z<unk>") == [0, 3, 2, 2, 1] and again.name == "tiny" and again.dim == h
    assert np.array_equal(made.embed_query("ab"), again.embed_query("ab")) and not np.allclose(again.embed_query("ab"), again.embed_query("é"))
    (tmp_path / "config.json").write_text(json.dumps(config | {"hidden_act": "relu"}))
    with pytest.raises(ValueError, match="gelu"):
        convert.convert(str(tmp_path), str(tmp_path / "w"), "tiny")


def test_engine(spark):
    from quillspark.engine import Engine

    eng = Engine(spark, SMALL)
    assert eng.why() and eng.search("watering plan").count() > 0
    page = eng.pages.filter("data_source_id <> '' AND coalesce(in_trash, 0) = 0").first()
    text = eng.fetch(page["page_id"].replace("-", "").upper(), include_relations=True)
    assert text.startswith(f'<page id="{page["page_id"]}"') and "<properties>" in text
    got = eng.query(f'SELECT count(*) AS n FROM "collection://{page["data_source_id"]}" WHERE id = ?', [page["page_id"]])
    assert got["rows"] == [[1]] and eng.refresh_views() == []
    # two views joined through the relations
    edge = eng.relations.join(eng.pages.selectExpr("page_id AS from_id", "data_source_id AS a", "in_trash AS x", "archived AS y"), "from_id").join(eng.pages.selectExpr("page_id AS to_id", "data_source_id AS b", "in_trash AS z", "archived AS w"), "to_id")
    e = edge.filter("a <> '' AND b <> '' AND coalesce(x, 0) + coalesce(y, 0) + coalesce(z, 0) + coalesce(w, 0) = 0").first()
    got = eng.query(f'SELECT p.id, r.prop, q.id FROM "collection://{e["a"]}" p JOIN relations r ON replace(lower(r.from_id), \'-\', \'\') = replace(p.id, \'-\', \'\') JOIN "collection://{e["b"]}" q ON replace(lower(r.to_id), \'-\', \'\') = replace(q.id, \'-\', \'\') WHERE p.id = ?', [e["from_id"]])
    assert [e["from_id"], e["prop"], e["to_id"]] in got["rows"]
    assert eng.recall("watering plan")["entity"] and eng.status().first()["n_pages"] == 200 and eng.catalog().count() > 40
