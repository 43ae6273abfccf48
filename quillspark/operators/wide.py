"""Attribute-value rows into wide tables with typed columns (p2).

Method: column-block pivoting. The attributes are divided into blocks; the cells are written
once in the shared folder as a table divided by block and bucketed by entity, so that each block
reads its own files only; it is pivoted without another exchange, and the blocks are joined on
the entity, again without one, because all of them have the same bucketing. Next to the value of a
cell its flag is pivoted, which says whether a value didn't fit and whether values differ.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.shared import Scratch
from quillspark.tables import current_pages, page_key, read

NUMBER = r"^\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(T([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.,][0-9]+)?)?(Z|[+-]([01][0-9]|2[0-3]):?[0-5][0-9]))?$"
_JSON_STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
STRING_ARRAY = rf"^\s*+\[\s*+(?:{_JSON_STRING}\s*+(?:,\s*+{_JSON_STRING}\s*+)*+)?+\]\s*+$"
LIST_TYPES = ("multi_select", "people", "relation")
ROW_COLUMNS_TAKEN = ("id", "url")
CLASSES = ("number", "date", "checkbox", "list", "text")


def schema_columns(schema_json: str | None) -> list[tuple[str, str]]:
    """(column, class) pairs a schema declares, names sorted; unreadable JSON declares none.

    A date N is three columns, a property called id or url in any case is escaped. Where two
    properties give the same column the last one counts.
    """
    try:
        props = json.loads(schema_json or "{}")
    except ValueError:
        return []
    if not isinstance(props, dict):
        return []
    out: dict[str, str] = {}
    for name, spec in props.items():
        kind = spec.get("type") if isinstance(spec, dict) else spec
        if kind == "date":
            out |= {f"date:{name}:start": "date", f"date:{name}:end": "date", f"date:{name}:is_datetime": "number"}
            continue
        column = f"userDefined:{name}" if name.lower() in ROW_COLUMNS_TAKEN else name
        out[column] = kind if kind in ("number", "checkbox") else "list" if kind in LIST_TYPES else "text"
    return sorted(out.items())


def declared(data_sources: DataFrame) -> DataFrame:
    """``source_id, col, class`` of every source; one row per declared column."""

    def parse(batches):
        for pdf in batches:
            rows = [(s, c, k) for s, j in zip(pdf["source_id"], pdf["schema_json"]) for c, k in schema_columns(j)]
            yield pd.DataFrame(rows, columns=["source_id", "col", "class"])

    one = data_sources.groupBy(page_key("id").alias("source_id")).agg(F.max("schema_json").alias("schema_json"))
    return one.mapInPandas(parse, "source_id string, col string, class string")


def as_number(c: Column) -> Column:
    """Finite double of a decimal number, else null."""
    d = F.when(c.rlike(NUMBER), F.trim(F.translate(c, "\t\n\r\f\x0b", "")).try_cast("double"))
    return F.when(F.abs(d) < float("inf"), d + F.lit(0.0))


def fits(c: Column, kind: str) -> Column:
    """Whether a non-empty value suits a class of column; never null for a non-null value."""
    if kind == "number":
        return as_number(c).isNotNull()
    if kind == "date":
        return c.rlike(DATE) & F.substring(c, 1, 10).try_cast("date").isNotNull()
    if kind == "checkbox":
        return c.isin("__YES__", "__NO__")
    if kind == "list":
        return c.rlike(STRING_ARRAY)
    return F.lit(True)


def cell_stats(props: DataFrame, entity: str, attribute: str, value: str, may: DataFrame) -> DataFrame:
    """One row per (entity, attribute): per class the least and greatest value that fits, and whether one doesn't.

    ``may`` (``col, classes``: bits in the order of CLASSES) says which classes an attribute has anywhere; the others
    stay null, and an attribute it doesn't name has none. Everything is a minimum or maximum, so repeated rows and
    hot attributes or entities are combined before the shuffle. An empty or null value leaves all of them null. Two
    values that fit differ exactly if least and greatest do.
    """
    v = F.when(F.col(value) != "", F.col(value))
    rows = props.filter(F.col(attribute).isNotNull()).select(page_key(entity).alias("entity"), F.col(attribute).alias("col"), v.alias("v"))
    rows = rows.join(F.broadcast(may), "col", "left")
    of = {k: F.coalesce(F.col("classes").bitwiseAND(1 << i) != 0, F.lit(False)) & F.col("v").isNotNull() for i, k in enumerate(CLASSES)}
    rows = rows.select("entity", "col", "v", F.when(of["text"], F.col("v")).alias("text_v"), F.when(of["number"], as_number(F.col("v"))).alias("num"), *[
        F.when(of[k], F.lit(True) if k == "number" else fits(F.col("v"), k)).alias(f"{k}_ok") for k in CLASSES if k != "text"
    ])
    aggs = []
    for kind in CLASSES:
        if kind == "text":
            shown, bad = F.col("text_v"), F.lit(False)
        elif kind == "number":
            shown, bad = F.col("num"), F.coalesce(F.max(F.col("number_ok") & F.col("num").isNull()), F.lit(False))
        else:
            shown, bad = F.when(F.col(f"{kind}_ok"), F.col("v")), F.coalesce(F.max(~F.col(f"{kind}_ok")), F.lit(False))
        aggs += [F.min(shown).alias(f"{kind}_min"), F.max(shown).alias(f"{kind}_max"), bad.alias(f"{kind}_bad")]
    return rows.groupBy("entity", "col").agg(*aggs)


@dataclass
class WideTable:
    """``rows``: ``entity, source_id, c0 .. cN, f0 .. fN``; ``columns``: the (col, class) of each ``c``; ``strays``: ``entity, col`` undeclared.

    ``f``: 1 if some value of the cell didn't fit, 2 if values that do differ, 3 if both; null or 0 if neither.
    """

    rows: DataFrame
    columns: list[tuple[str, str]]
    strays: DataFrame

    def issues(self) -> DataFrame:
        """``entity, col, kind`` of the cells with a flag and of the attributes the source doesn't declare."""
        flagged = F.array(*[F.struct(F.lit(c).alias("col"), F.coalesce(f"f{i}", F.lit(0)).alias("flag")) for i, (c, _) in enumerate(self.columns)])
        kinds = F.array(F.struct(F.lit(1).alias("bit"), F.lit("mistyped").alias("kind")), F.struct(F.lit(2).alias("bit"), F.lit("conflict").alias("kind")))
        cells = self.rows.select("entity", F.explode(F.filter(flagged, lambda x: x["flag"] > 0)).alias("x")).select("entity", "x.col", "x.flag", F.explode(kinds).alias("k"))
        found = cells.filter(F.col("flag").bitwiseAND(F.col("k.bit")) != 0).select("entity", "col", F.col("k.kind").alias("kind"))
        strays = self.strays.select("entity", "col", F.lit("undeclared").alias("kind"))
        return found.unionByName(strays) if self.columns else strays

    def of_source(self, source_id: str, names: list[tuple[str, str]]) -> DataFrame:
        """The table of one source with its own column names (exact in letter case)."""
        at = {x: k for k, x in enumerate(self.columns)}
        return self.rows.filter(F.col("source_id") == source_id).select(
            F.col("entity").alias("page_id"), *[F.col(f"c{at[n]}").alias(n[0]) for n in names]
        )


def widen(
    props: DataFrame,
    entities: DataFrame,
    schema: DataFrame,
    entity: str = "page_id",
    attribute: str = "col",
    value: str = "value",
    block: int = 16,
    buckets: int | None = None,
) -> WideTable:
    """One row per entity with the typed columns its source declares.

    ``entities``: ``entity, source_id``; an entity without rows still comes out, with nulls.
    ``schema``: ``source_id, col, class`` (its distinct (col, class) pairs are the columns of
    the wide table and must fit the driver, as they must fit one row). A cell holds the
    greatest value that fits, as double for numbers and as text else, and its flag tells values
    that don't fit and values that differ (:class:`WideTable`). ``strays`` has a row for each attribute the source
    doesn't declare; these never become columns nor lists, however many an entity has. Rows of unknown entities, null
    attributes, null and empty values give no cell; empty tables give an empty result; other columns of the
    inputs are ignored.
    """
    spark = props.sparkSession
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    columns = sorted((r["col"], r["class"]) for r in schema.select("col", "class").distinct().collect())
    index = spark.createDataFrame(
        [(c, k, i) for i, (c, k) in enumerate(columns)], "col string, class string, slot int"
    )
    slots = schema.join(F.broadcast(index), ["col", "class"])
    classes: dict[str, int] = {}
    for c, k in columns:
        classes[c] = classes.get(c, 0) | 1 << CLASSES.index(k)
    may = spark.createDataFrame(sorted(classes.items()), "col string, classes int")
    stats = cell_stats(props, entity, attribute, value, may)
    cells = entities.select("entity", "source_id").join(stats, "entity").join(slots, ["source_id", "col"], "left")

    def pick(what: str) -> Column:
        out = F.lit(None)
        for kind in CLASSES:
            out = F.when(F.col("class") == kind, F.col(f"{kind}_{what}").cast("string" if what != "bad" else "boolean")).otherwise(out)
        return out

    differ = F.lit(False)
    for kind in CLASSES:
        differ = F.when(F.col("class") == kind, F.col(f"{kind}_min") != F.col(f"{kind}_max")).otherwise(differ)
    flag = F.when(F.coalesce(pick("bad"), F.lit(False)), 1).otherwise(0) + F.when(F.coalesce(differ, F.lit(False)), 2).otherwise(0)
    filled = cells.select(
        "entity",
        F.lit(None).cast("string").alias("source_id"),
        "slot",
        F.when(F.col("class") == "number", F.col("number_max")).alias("num"),
        F.when(F.col("class") != "number", pick("max")).alias("txt"),
        F.when(F.col("slot").isNotNull(), flag).alias("flag"),
        F.when(F.col("slot").isNull(), F.col("col")).alias("stray"),
        F.coalesce(F.floor(F.col("slot") / block), F.lit(-1)).cast("int").alias("block"),
    )
    # block -1 has one row for every entity, and its strays
    own = entities.select(
        "entity", "source_id", *[F.lit(None).cast(t).alias(c) for c, t in (("slot", "int"), ("num", "double"), ("txt", "string"), ("flag", "int"), ("stray", "string"))], F.lit(-1).alias("block")
    )
    kept = Scratch(spark).bucket(filled.unionByName(own).repartition(n, "entity"), "entity", n, by="block")
    wide = kept.filter("block = -1").groupBy("entity").agg(F.max("source_id").alias("source_id"))
    for at in range(0, len(columns), block):
        names = columns[at : at + block]
        aggs = []
        for i, (_, kind) in enumerate(names):
            here = F.col("slot") == at + i
            aggs += [F.max(F.when(here, F.col("num" if kind == "number" else "txt"))).alias(f"c{at + i}"), F.max(F.when(here, F.col("flag"))).alias(f"f{at + i}")]
        wide = wide.join(kept.filter(F.col("block") == at // block).groupBy("entity").agg(*aggs), "entity", "left")
    strays = kept.filter("block = -1 AND stray IS NOT NULL").select("entity", F.col("stray").alias("col"))
    return WideTable(wide.select("entity", "source_id", *[f"{x}{i}" for x in "cf" for i in range(len(columns))]), columns, strays)


def wide_pages(spark: SparkSession, sf_dir: str, block: int = 16) -> WideTable:
    pages = current_pages(read(spark, sf_dir, "pages"), {"source_id": page_key("data_source_id")})
    return widen(
        read(spark, sf_dir, "page_props"),
        pages.filter("source_id <> ''").withColumnRenamed("page_id", "entity"),
        declared(read(spark, sf_dir, "data_sources")),
        block=block,
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of pages of a source that are undeclared, mistyped or in conflict with themselves."""
    return wide_pages(spark, sf_dir).issues().withColumnRenamed("entity", "page_id")


def p2_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page of a source: its filled text cells as ``column=value`` lines in order of column, the number of
    filled number cells and the greatest of them."""
    w = wide_pages(spark, sf_dir)
    texts = [F.concat(F.lit(c + "="), f"c{i}") for i, (c, k) in enumerate(w.columns) if k != "number"]
    numbers = F.array_compact(F.array(F.lit(None).cast("double"), *[F.col(f"c{i}") for i, (_, k) in enumerate(w.columns) if k == "number"]))
    return w.rows.select(
        F.col("entity").alias("page_id"), "source_id", F.concat_ws("\n", *texts).alias("texts"),
        F.size(numbers).cast("long").alias("n_numbers"), F.array_max(numbers).alias("greatest"),
    )
