"""References to records that do not exist (p6).

Method: references and parents are co-partitioned and sorted by key, and both sorted streams
are merged linearly (Spark's sort-merge join); each parent carries its validity interval, which
tells missing, deleted and late references apart. References to a hot key are spread over
several partitions, to each of which the one parent row is copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.shared import heavy_keys, spread_join
from quillspark.tables import current_pages, flag, instant_us, month_of_us, page_key, read


def merge_parents(refs: DataFrame, parents: DataFrame, key: str, heavy: DataFrame, prefix: str) -> DataFrame:
    """``refs`` with the columns of ``parents`` (one row per ``key``) under ``prefix``, null if there is none.

    ``heavy`` has the keys to spread; see :func:`quillspark.shared.heavy_keys` for its bound.
    """
    named = parents.select(key, *[F.col(c).alias(prefix + c) for c in parents.columns if c != key])
    return spread_join(refs, named, key, heavy, "left", "merge")


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Orphan references ``from_id, prop, to_id, side, kind, edit_month``, distinct.

    ``refs``: ``from_id, prop, to_id`` in any spelling; null and empty ``to_id`` refer to nothing
    and are left out, a null or empty ``from_id`` is a missing page, a null ``prop`` stays null.
    ``parents``: ``page_id, valid_from, deleted, edited`` (microseconds; one row per page). A
    target is late if the referring page's last edit lies before its ``valid_from``; unreadable
    times are never late. Repeated references are dropped before anything is shuffled twice.
    Empty tables give an empty result, or all references as missing.
    """
    spelled = refs.select(page_key("from_id").alias("from_id"), "prop", page_key("to_id").alias("to_id")).filter("to_id <> ''").distinct()
    total = refs.count()  # of the file's footers
    p = parents.select("page_id", "valid_from", "deleted", "edited", F.lit(True).alias("known"))
    from_side = p.select(F.col("page_id").alias("from_id"), "known", "deleted", "edited")
    to_side = p.select(F.col("page_id").alias("to_id"), "known", "deleted", "valid_from")
    hot_from, hot_to = (heavy_keys(refs.select(page_key(k).alias(k)), k, total) for k in ("from_id", "to_id"))
    both = merge_parents(merge_parents(spelled, from_side, "from_id", hot_from, "f_"), to_side, "to_id", hot_to, "t_")

    def state(prefix: str) -> Column:
        return F.when(F.col(f"{prefix}known").isNull(), "missing").when(F.col(f"{prefix}deleted"), "trashed")

    to_kind = F.coalesce(
        state("t_"),
        F.when(F.col("f_known").isNotNull() & (F.col("t_valid_from") > F.col("f_edited")), F.lit("late")),
    )
    found = F.filter(
        F.array(
            F.struct(F.lit("from").alias("side"), state("f_").alias("kind")),
            F.struct(F.lit("to").alias("side"), to_kind.alias("kind")),
        ),
        lambda x: x["kind"].isNotNull(),
    )
    month = F.coalesce(month_of_us(F.col("f_edited")), F.lit(""))
    return both.select("from_id", "prop", "to_id", month.alias("edit_month"), F.explode(found).alias("x")).select(
        "from_id", "prop", "to_id", "x.side", "x.kind", "edit_month"
    )


def parents_of(pages: DataFrame) -> DataFrame:
    return current_pages(
        pages,
        {"valid_from": instant_us("created_time"), "deleted": flag("in_trash"), "edited": instant_us("last_edited_time")},
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(read(spark, sf_dir, "relations"), parents_of(read(spark, sf_dir, "pages")))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per property, side, kind and month."""
    return p6_found(spark, sf_dir).groupBy("prop", "side", "kind", "edit_month").agg(F.count(F.lit(1)).alias("n"))
