"""Property JSON to attribute-value rows and edges, and the generated wide views."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.scalars import SPAN, column_name, json_text, plain_text

ROW_COLUMNS = ("id", "url", "title", "icon", "created_time", "last_edited_time", "content_markdown", "parent_id")
TEXT_TYPES = ("title", "rich_text")


def _get(v: Column, path: str) -> Column:
    return F.get_json_object(v, path)


def _names(v: Column, path: str, field: str) -> Column:
    items = F.from_json(_get(v, path), f"array<struct<{field}:string>>")
    return json_text(F.to_json(F.coalesce(F.transform(items, lambda x: F.coalesce(x[field], F.lit(""))), F.array().cast("array<string>"))))


def _typed_scalar(v: Column, path: str) -> tuple[Column, Column]:
    """(text, number) of a typed value ``{"type": t, t: ..}``."""
    kind = _get(v, f"{path}.type")
    flag = _get(v, f"{path}.boolean")
    text = (
        F.when(kind == "string", _get(v, f"{path}.string"))
        .when(kind == "boolean", F.when(flag == "true", "__YES__").when(flag == "false", "__NO__"))
        .when(kind == "date", _get(v, f"{path}.date.start"))
    )
    return text, F.when(kind == "number", _get(v, f"{path}.number").try_cast("double"))


def _rollup_list(v: Column) -> Column:
    item = "struct<type:string,number:double,string:string,boolean:boolean,date:struct<start:string>>"
    items = F.from_json(_get(v, "$.rollup.array"), f"array<{item}>")

    def one(x: Column) -> Column:
        quoted = F.when(x["type"] == "string", x["string"]).when(x["type"] == "date", x["date"]["start"]).when(
            (x["type"] == "boolean") & x["boolean"].isNotNull(), F.when(x["boolean"], "__YES__").otherwise("__NO__")
        )
        number = F.when(x["type"] == "number", x["number"])
        whole = number.cast("long")
        shown = F.when((number == whole) & (F.abs(number) < 1e15), whole.cast("string")).otherwise(number.cast("string"))
        text = F.substring(F.to_json(F.array(quoted)), 2, 1 << 30)
        return F.coalesce(shown, F.when(quoted.isNotNull(), F.regexp_replace(text, r"\]$", "")), F.lit("null"))

    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(items, F.array().cast(f"array<{item}>")), one), ","), F.lit("]"))


def cells(name: Column, v: Column) -> Column:
    """Array of ``(col, value_str, value_num)`` that a property value makes."""
    kind = F.coalesce(_get(v, "$.type"), F.lit(""))
    text_kind = lambda k: plain_text(F.from_json(_get(v, f"$.{k}"), SPAN))
    f_text, f_num = _typed_scalar(v, "$.formula")
    r_text, r_num = _typed_scalar(v, "$.rollup")
    number = _get(v, "$.unique_id.number")
    prefix = F.coalesce(_get(v, "$.unique_id.prefix"), F.lit(""))
    person = lambda k: F.when(_get(v, f"$.{k}").isNull(), "null").otherwise(
        json_text(F.to_json(F.array(F.coalesce(_get(v, f"$.{k}.id"), F.lit("")))))
    )
    files = F.from_json(_get(v, "$.files"), "array<struct<name:string,external:struct<url:string>,file:struct<url:string>>>")
    urls = F.transform(
        F.coalesce(files, F.array().cast("array<struct<name:string,external:struct<url:string>,file:struct<url:string>>>")),
        lambda x: F.struct(
            F.coalesce(x["name"], F.lit("")).alias("name"),
            F.coalesce(F.nullif(x["external"]["url"], F.lit("")), x["file"]["url"], F.lit("")).alias("url"),
        ),
    )
    text = (
        F.when(kind == "title", text_kind("title"))
        .when(kind == "rich_text", text_kind("rich_text"))
        .when(kind.isin("select", "status"), F.coalesce(_get(v, "$.select.name"), _get(v, "$.status.name")))
        .when(kind == "multi_select", _names(v, "$.multi_select", "name"))
        .when(kind == "checkbox", F.when(_get(v, "$.checkbox") == "true", "__YES__").otherwise("__NO__"))
        .when(kind == "people", _names(v, "$.people", "id"))
        .when(kind == "relation", _names(v, "$.relation", "id"))
        .when(kind == "files", json_text(F.to_json(urls)))
        .when(kind == "unique_id", F.when(number.isNotNull() & (prefix != ""), F.concat(prefix, F.lit("-"), number)))
        .when(kind == "formula", f_text)
        .when(kind == "rollup", F.when(_get(v, "$.rollup.type") == "array", json_text(_rollup_list(v))).otherwise(r_text))
        .when(kind == "verification", F.coalesce(_get(v, "$.verification.state"), F.lit("")))
    )
    for k in ("url", "email", "phone_number", "created_time", "last_edited_time"):
        text = text.when(kind == k, _get(v, f"$.{k}"))
    for k in ("created_by", "last_edited_by"):
        text = text.when(kind == k, person(k))
    known = ["title", "rich_text", "number", "select", "status", "multi_select", "date", "checkbox", "people", "relation", "files",
             "unique_id", "formula", "rollup", "verification", "url", "email", "phone_number", "created_time", "last_edited_time",
             "created_by", "last_edited_by"]
    text = text.when(~kind.isin(*known), v)
    num = (
        F.when(kind == "number", _get(v, "$.number").try_cast("double"))
        .when((kind == "unique_id") & (prefix == ""), number.try_cast("double"))
        .when(kind == "formula", f_num)
        .when((kind == "rollup") & (F.coalesce(_get(v, "$.rollup.type"), F.lit("")) != "array"), r_num)
    )
    cell = lambda c, s, n: F.struct(c.alias("col"), s.cast("string").alias("value_str"), n.cast("double").alias("value_num"))
    start, nothing = _get(v, "$.date.start"), F.lit(None)
    date = F.array(
        cell(F.concat(F.lit("date:"), name, F.lit(":start")), start, nothing),
        cell(F.concat(F.lit("date:"), name, F.lit(":end")), F.nullif(_get(v, "$.date.end"), F.lit("")), nothing),
        cell(F.concat(F.lit("date:"), name, F.lit(":is_datetime")), nothing, F.when(start.isNotNull(), F.when(start.contains("T"), 1.0).otherwise(0.0))),
    )
    return F.when(kind == "date", date).otherwise(F.array(cell(column_name(name), text, num)))


def flatten_properties(pages: DataFrame, key: str = "page_id", properties: str = "properties") -> DataFrame:
    """``page_id, col, value_str, value_num``: one row per property column, natively; unreadable JSON gives no rows."""
    props = F.from_json(F.col(properties), "map<string,string>")
    each = pages.select(F.col(key).alias("page_id"), F.explode(props).alias("name", "v")).filter("v IS NOT NULL")
    return each.select("page_id", F.explode(cells(F.col("name"), F.col("v"))).alias("x")).select("page_id", "x.*")


def flatten_edges(pages: DataFrame, key: str = "page_id", properties: str = "properties") -> DataFrame:
    """``from_id, prop, to_id`` of relation properties, distinct."""
    props = F.from_json(F.col(properties), "map<string,string>")
    each = pages.select(F.col(key).alias("from_id"), F.explode(props).alias("prop", "v")).filter(_get(F.col("v"), "$.type") == "relation")
    ids = F.from_json(_get(F.col("v"), "$.relation"), "array<struct<id:string>>")
    return each.select("from_id", "prop", F.explode(ids).alias("x")).select("from_id", "prop", F.col("x.id").alias("to_id")).distinct()


def title_of(properties: Column) -> Column:
    """Text of the property whose type is title."""
    values = F.map_values(F.from_json(properties, "map<string,string>"))
    found = F.filter(values, lambda v: _get(v, "$.type") == "title")
    return F.coalesce(plain_text(F.from_json(_get(F.try_element_at(found, F.lit(1)), "$.title"), SPAN)), F.lit(""))


def icon_of(icon: Column) -> Column:
    """Emoji of an icon, '' for any other."""
    return F.coalesce(_get(icon, "$.emoji"), F.lit(""))


def parent_of(parent: Column) -> tuple[Column, Column]:
    """(type, id) of a parent: page before data source, database and block."""
    ids = {k: F.nullif(_get(parent, f"$.{k}"), F.lit("")) for k in ("page_id", "data_source_id", "database_id", "block_id")}
    kind = F.lit("")
    for k, v in reversed(ids.items()):
        kind = F.when(v.isNotNull(), k).otherwise(kind)
    return kind, F.coalesce(*ids.values(), F.lit(""))


def schema_columns(schema_json: str) -> list[tuple[str, str]]:
    """(column, property type) of a source: names in byte order, a date as three columns."""
    out = []
    props = json.loads(schema_json or "{}")
    for name in sorted(props, key=lambda n: n.encode()):
        kind = props[name].get("type") if isinstance(props[name], dict) else props[name]
        if kind == "date":
            out += [(f"date:{name}:{part}", "number" if part == "is_datetime" else "date") for part in ("start", "end", "is_datetime")]
        else:
            out.append((f"userDefined:{name}" if name.lower() in ("id", "url") else name, kind))
    return out


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def view_name(source_id: str) -> str:
    return f"collection://{source_id}"


def wide_view(pages: DataFrame, props: DataFrame, source_id: str, columns: list[tuple[str, str]]) -> DataFrame:
    """One row per live page of a source: its row columns and one column per property.

    A property with exactly the name of a row column wins. A page without properties still comes out. ``props``
    has ``page_id, col, value``. Use a session with ``spark.sql.caseSensitive`` for names that differ in case only.
    """
    own = {c for c, _ in columns}
    live = (
        pages.filter(F.col("data_source_id") == source_id).filter("coalesce(in_trash, 0) = 0 AND coalesce(archived, 0) = 0")
    )
    numeric = {c for c, k in columns if k == "number"}
    value = lambda c: F.col("value").try_cast("double") if c in numeric else F.col("value")
    pivot = props.filter(F.col("col").isin(*own)).join(live.select("page_id"), "page_id", "left_semi").groupBy("page_id").agg(
        *[F.max(F.when(F.col("col") == c, value(c))).alias(f"p{i}") for i, (c, _) in enumerate(columns)]
    ) if columns else props.select("page_id").distinct()
    joined = live.join(pivot, "page_id", "left")
    fixed = [(F.col("page_id") if c == "id" else F.col(c)).alias(c) for c in ROW_COLUMNS if c not in own]
    return joined.select(*fixed, *[F.col(f"p{i}").alias(c) for i, (c, _) in enumerate(columns)])


def all_views(pages: DataFrame, props: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """The views of all sources at once in long form: ``source_id, page_id, col, value, number``, every cell that isn't null.

    ``schemas`` has the schema text of each source (a row of metadata per source). All declared columns are pivoted in one
    pass, each as number or text, and a page takes those its source declares; the rules are those of :func:`wide_view`.
    """
    spark = pages.sparkSession
    declared = {s: schema_columns(j) for s, j in schemas.items()}
    columns = sorted({(c, k == "number") for own in declared.values() for c, k in own})
    at = {x: i for i, x in enumerate(columns)}
    taken = [(s, [at[c, k == "number"] for c, k in own], [c for c, _ in own]) for s, own in declared.items()]
    own = spark.createDataFrame(taken, "data_source_id string, slots array<int>, names array<string>")
    live = pages.filter("coalesce(in_trash, 0) = 0 AND coalesce(archived, 0) = 0").join(F.broadcast(own), "data_source_id")
    value = lambda number: F.col("value").try_cast("double") if number else F.col("value")
    pivot = props.filter(F.col("col").isin([c for c, _ in columns])).groupBy("page_id").agg(
        *[F.max(F.when(F.col("col") == c, value(number))).alias(f"p{i}") for i, (c, number) in enumerate(columns)], F.lit(1).alias("has")
    )
    cell = lambda c, v, n: F.struct(F.lit(c).alias("col"), v.cast("string").alias("value"), n.cast("double").alias("number"))
    nothing = F.lit(None)
    fixed = [cell(c, F.when(~F.array_contains("names", c), F.col("page_id" if c == "id" else c)), nothing) for c in ROW_COLUMNS]
    pivoted = [
        cell(c, nothing if number else F.when(F.array_contains("slots", i), F.col(f"p{i}")), F.when(F.array_contains("slots", i), F.col(f"p{i}")) if number else nothing)
        for i, (c, number) in enumerate(columns)
    ]
    kept = F.filter(F.array(*fixed, *pivoted), lambda x: x["value"].isNotNull() | x["number"].isNotNull())
    return live.join(pivot, "page_id", "left").select(F.col("data_source_id").alias("source_id"), "page_id", F.explode(kept).alias("c")).select("source_id", "page_id", "c.*")


def register_views(spark: SparkSession, pages: DataFrame, props: DataFrame, sources: DataFrame, known: dict[str, str] | None = None) -> list[str]:
    """Create the view of every source in the session; returns the names of those that were made.

    ``known`` (source id -> schema text) is what the session's views were made from, and is brought up to date: a view is made
    again only if its source's schema text changed. One source is one row of metadata.
    """
    names, known = [], {} if known is None else known
    for r in sources.groupBy("source_id").agg(F.max("schema_json").alias("schema_json")).collect():
        source, text = r["source_id"], r["schema_json"] or ""
        if source in known and known[source] == text:
            continue
        view = wide_view(pages, props, source, schema_columns(text))
        spark.sql(f"DROP VIEW IF EXISTS {quote(view_name(source))}")
        view.createOrReplaceTempView(quote(view_name(source)))
        known[source] = text
        names.append(view_name(source))
    return names


def catalog(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """Live sources by title with the number of their pages outside the trash (archived ones count)."""
    counts = pages.filter("coalesce(in_trash, 0) = 0").groupBy("data_source_id").agg(F.count(F.lit(1)).alias("n"))
    live = sources.filter("coalesce(in_trash, 0) = 0")
    return live.join(counts, live["source_id"] == counts["data_source_id"], "left").select(
        "source_id", "title", F.concat(F.lit("collection://"), "source_id").alias("view"), F.coalesce("n", F.lit(0)).alias("rows")
    )
