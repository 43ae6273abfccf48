"""Table access and the conventions every query shares.

* page ids are compared in one canonical spelling (:func:`page_key`);
* instants held as strings are compared as UTC microseconds (:func:`instant_us`);
* ``pages`` is read through :func:`current_pages`, the newest version per id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PLAIN = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def page_key(c: Column | str) -> Column:
    """Lower-case hyphenated form of an id; other strings are only trimmed and lowered, null becomes ''."""
    c = F.col(c) if isinstance(c, str) else c
    raw = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    bare = F.replace(raw, F.lit("-"), F.lit(""))
    # most ids are plain already: one pattern and no copy
    return F.when(raw.rlike(_PLAIN), raw).when(
        bare.rlike("^[0-9a-f]{32}$"), F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    ).otherwise(raw)


def instant_us(c: Column | str) -> Column:
    """UTC microseconds of an ISO-8601 string in any zone, null if it is none.

    A string without zone counts as UTC, whatever the session's time zone is.
    """
    c = F.col(c) if isinstance(c, str) else c
    s = F.trim(c)
    # most times end in Z after a T: no pattern is needed for them
    zoned = F.when((F.substring(s, 11, 1) == "T") & s.endswith("Z"), s).when(
        s.rlike(r"(?i)(z|[+-]\d{2}:?(\d{2})?)$") & s.rlike("[Tt ]"), s
    ).otherwise(F.concat(F.when(F.length(s) == 10, F.concat(s, F.lit("T00:00:00"))).otherwise(s), F.lit("Z")))
    return F.unix_micros(zoned.try_cast("timestamp"))


def month_of_us(us: Column) -> Column:
    """``YYYY-MM`` in UTC of microseconds; independent of the session's time zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / 86_400_000_000).cast("int")), "yyyy-MM")


def current_pages(pages: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One row per page id: the version latest by ``last_edited_time``, then ``synced_at``.

    Output: ``page_id`` and the given columns. Rows without an id are no pages. Instants
    that can't be read count as earliest. Among full duplicates, and versions equal in both
    times, the greatest row of the given columns is taken, so the result is deterministic.
    The maximum of a struct combines map-side, so a page with many versions costs one
    shuffled row per input partition.
    """
    named = [v.alias(k) for k, v in columns.items()]
    versions = pages.select(
        page_key("id").alias("page_id"),
        F.struct(
            F.coalesce(instant_us("last_edited_time"), F.lit(-(2**62))).alias("_edited"),
            F.coalesce(instant_us("synced_at"), F.lit(-(2**62))).alias("_synced"),
            *named,
        ).alias("_v"),
    ).filter("page_id <> ''")
    return versions.groupBy("page_id").agg(F.max("_v").alias("_v")).select(
        "page_id", *[F.col(f"_v.{k}").alias(k) for k in columns]
    )


def flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) != 0
