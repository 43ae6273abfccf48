"""One ranking from several differently-scaled scores (p4).

Method: outranking net flow. Each score is turned into percentiles within its query; for each
score a pairwise preference function (linear up to a threshold) is summed over all other
items, not by comparing pairs but with sorted prefix sums, which gives the same numbers
exactly; the weighted positive minus negative flow ranks the items.

A query may hold a third of all rows. A group that holds more than 1 / pieces of them is cut into as
many ranges of its values as it holds pieces, and prefix sums run within (group, range), shifted by the totals
of the ranges before. There is one plan for all sizes; light groups have one range. The number of pieces
follows the shuffle partitions, and what is broadcast (cuts and totals of heavy groups) has at most twice as many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.shared import Scratch, heavy_keys, salts_for, spread_join
from quillspark.tables import page_key, read

#: Quantiles taken of the values of a heavy group; of these as many are used as it has ranges.
MARKS = 512


def number_or_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c.cast("double") + F.lit(0.0))


def prefix_sums(df: DataFrame, group: list[str], value: str, sums: list[str], totals: bool = False) -> DataFrame:
    """``df`` with, for each of ``sums``, its sum over the rows of the group up to this value, ties included (``upto_``).

    Exact. ``df`` has ``_parts`` (above 1 in heavy groups) and ``_range``, which never falls as the value rises and
    is 0 in light groups. With ``totals`` also the sum over the whole group (``all_``).
    """
    heavy = df.filter("_parts > 1").groupBy(*group, "_range").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    shifts = heavy.select(
        *[F.col(c).alias(f"_{c}") for c in (*group, "_range")],
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(whole).alias(f"_a_{s}") for s in sums if totals],
    )
    keys = [*group, "_range"]
    within = Window.partitionBy(*keys).orderBy(value)
    out = df.select("*", *[F.sum(s).over(within).alias(f"_w_{s}") for s in sums], *[F.sum(s).over(Window.partitionBy(*keys)).alias(f"_p_{s}") for s in sums if totals])
    on = F.lit(True)
    for c in keys:
        on = on & (out[c] == shifts[f"_{c}"])
    joined = out.join(F.broadcast(shifts), on, "left")
    return joined.select(
        *df.columns, *[(F.col(f"_w_{s}") + F.coalesce(f"_o_{s}", F.lit(0))).alias(f"upto_{s}") for s in sums],
        *[F.coalesce(f"_a_{s}", f"_p_{s}").alias(f"all_{s}") for s in sums if totals],
    )


def cell(t: Column, low: float, high: float) -> Column:
    """Range of ``t`` among ``_parts`` equal ones of [low, high]; percentiles and flows lie evenly enough."""
    at = F.floor((F.greatest(F.least(t, F.lit(high)), F.lit(low)) - low) / (high - low) * F.col("_parts"))
    return F.when(F.col("_parts") > 1, at).otherwise(0).cast("int")


def value_ranges(counts: DataFrame) -> DataFrame:
    """``g, k, v, n, _parts`` with ``_range``: heavy groups cut at approximate quantiles, which affect only the balance; equal values never part."""
    marks = [i / MARKS for i in range(1, MARKS)]
    heavy = counts.filter("_parts > 1").groupBy("g", "k", "_parts").agg(F.percentile_approx("v", marks, 10_000).alias("c"))
    step = F.greatest(F.floor(F.lit(MARKS) / F.col("_parts")), F.lit(1)).cast("int")
    cuts = heavy.select(F.col("g").alias("_g"), F.col("k").alias("_k"), F.filter("c", lambda x, i: i % step == step - 1).alias("_cuts"))
    ranged = counts.join(F.broadcast(cuts), (F.col("g") == F.col("_g")) & (F.col("k") == F.col("_k")), "left").withColumn(
        "_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("v"))), F.lit(0))
    )
    return ranged.select("g", "k", "v", "n", "_parts", "_range")


def percentiles(counts: DataFrame) -> DataFrame:
    """``g, k, v, n, _parts`` (distinct values with ``n`` items) with ``all``, ``rank`` (1 = highest, ties share the best) and ``pct``.

    The percentile is the share of the other items below, ties counting half: (below + (n - 1) / 2) / (all - 1),
    and 0.5 for a single item. ``counts`` should be a written table, it is read more than once.
    """
    ranked = prefix_sums(value_ranges(counts), ["g", "k"], "v", ["n"], totals=True)
    below = F.col("upto_n") - F.col("n")
    return ranked.select(
        "g", "k", "v", "n", "_parts", F.col("all_n").alias("all"),
        (F.col("all_n") - F.col("upto_n") + 1).alias("rank"),
        F.when(F.col("all_n") > 1, (below + (F.col("n") - 1) / 2) / (F.col("all_n") - 1)).otherwise(0.5).alias("pct"),
    )


def net_flow(pcts: DataFrame, threshold: float) -> DataFrame:
    """``g, k, v, rank, flow``: the mean over the other items of P(x - y) - P(y - x), P(d) = min(1, max(0, d) / threshold).

    With C(t) and S(t), count and sum of the percentiles up to t, the sum of P(x - y) is
    C(x - p) + ((C(x) - C(x - p)) x - (S(x) - S(x - p))) / p; likewise for P(y - x) above. The three
    positions are looked up by sorting them in among the values, with weight nothing.
    """
    x = F.col("pct")
    point = lambda k, t, c, s: F.struct(F.lit(k).alias("probe"), t.alias("t"), c.cast("long").alias("c"), s.cast("double").alias("s"))
    three = F.array(
        point(0, x, F.col("n"), F.col("n") * x), point(1, x - threshold, F.lit(0), F.lit(0.0)), point(2, x + threshold, F.lit(0), F.lit(0.0))
    )
    points = pcts.select("g", "k", "v", "rank", "_parts", "pct", "all", F.explode(three).alias("q")).select("g", "k", "v", "rank", "_parts", "pct", "all", "q.*")
    sums = prefix_sums(points.withColumn("_range", cell(F.col("t"), 0.0, 1.0)), ["g", "k"], "t", ["c", "s"])
    at = [F.max(F.when(F.col("probe") == i, F.col(f"upto_{v}"))).alias(f"{name}_{v}") for i, name in enumerate(("own", "low", "high")) for v in ("c", "s")]
    wide = sums.groupBy("g", "k", "v").agg(F.max("rank").alias("rank"), F.max("pct").alias("pct"), F.max("all").alias("all"), *at)
    p = F.lit(threshold)
    above = F.col("low_c") + ((F.col("own_c") - F.col("low_c")) * x - (F.col("own_s") - F.col("low_s"))) / p
    below = (F.col("all") - F.col("high_c")) + ((F.col("high_s") - F.col("own_s")) - (F.col("high_c") - F.col("own_c")) * x) / p
    return wide.select("g", "k", "v", "rank", F.when(F.col("all") > 1, (above - below) / (F.col("all") - 1)).otherwise(0.0).alias("flow"))


def flows(items: DataFrame, group: str, item: str, scores: dict[str, float], threshold: float = 0.25, pieces: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(``rid, g, ahead, flow, rank0, flow0, ..``: items with the number of items of a greater flow; ``rid, i``: their names).

    All scores go through one plan, as rows of (group, score).
    """
    spark = items.sparkSession
    scratch, pieces = Scratch(spark), pieces or salts_for(spark)
    size = lambda total: max(total / pieces, 1)
    best, total = scratch.put_counted(
        items.filter(F.col(group).isNotNull() & F.col(item).isNotNull())
        .groupBy(F.col(group).alias("g"), F.col(item).alias("i"))
        .agg(*[F.max(number_or_null(F.col(s))).alias(f"s{k}") for k, s in enumerate(scores)])
        .withColumn("rid", F.monotonically_increasing_id())
    )
    heavy = heavy_keys(best, "g", total, pieces)
    parted = best.join(F.broadcast(heavy), F.col("g") == F.col("_hot"), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).drop("_hot")
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"s{k}").alias("v")) for k in range(len(scores))])
    long = parted.select("rid", "g", "_parts", F.explode(each).alias("x")).select("rid", "g", "_parts", "x.k", "x.v").filter("v IS NOT NULL")
    counts = scratch.put(long.groupBy("g", "k", "v", "_parts").agg(F.count(F.lit(1)).alias("n")))
    valued = net_flow(percentiles(counts), threshold)
    # a value that many items of a group share is one row of ``valued``: its items are spread
    x = F.struct("g", "k", "v")
    tied = counts.filter(F.col("n") > size(total)).select(x.alias("_hot"), F.ceil(F.col("n") / size(total)).cast("int").alias("_parts"))
    scored = spread_join(long.select("rid", "k", x.alias("x")), valued.select(x.alias("x"), "rank", "flow"), "x", tied).groupBy("rid").agg(
        *[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in range(len(scores)) for c in ("rank", "flow")]
    )
    has = counts.groupBy("g").agg(*[F.count_if(F.col("k") == k).alias(f"n{k}") for k in range(len(scores))])
    known = spread_join(best.select("rid", "g"), has, "g", heavy, "left")
    flow = F.lit(0.0)
    for k, w in enumerate(scores.values()):
        flow = flow + w * F.coalesce(f"flow{k}", F.when(F.col(f"n{k}") > 0, -1.0).otherwise(0.0))
    out = scratch.put(
        known.join(scored, "rid", "left").withColumn("flow", F.round(flow / sum(scores.values()), 12)).drop(*[f"n{k}" for k in range(len(scores))])
    )
    # items with a greater flow are counted by prefix sums
    same = out.groupBy("g", "flow").agg(F.count(F.lit(1)).alias("n"))
    same = same.join(F.broadcast(heavy), F.col("g") == F.col("_hot"), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).drop("_hot")
    place = prefix_sums(same.withColumn("_range", cell(F.col("flow"), -1.0, 1.0)), ["g"], "flow", ["n"], totals=True)
    y = F.struct("g", "flow").alias("y")
    tied = out.groupBy(y).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > size(total)).select(F.col("y").alias("_hot"), F.ceil(F.col("n") / size(total)).cast("int").alias("_parts"))
    ahead = place.select(y, (F.col("all_n") - F.col("upto_n")).alias("ahead"))
    return spread_join(out.withColumn("y", y), ahead, "y", tied).drop("y"), best.select("rid", "i")


def rank_items(items: DataFrame, group: str, item: str, scores: dict[str, float], threshold: float = 0.25, pieces: int | None = None) -> DataFrame:
    """One row per (group, item), ranked by net flow.

    ``scores`` maps a score column to its weight. An item counts with its greatest value of each
    score; null and NaN are no score, infinite values are the highest or lowest. A missing
    score is the least preferred outcome: the item's flow there is -1 (0 in a group in which no
    item has the score), so an item one branch never returned doesn't profit from it. Rows
    with a null group or item are left out; repeated rows count once. Output: ``group, item``,
    per score ``<score>_rank`` (1 = highest, ties share the best) and ``<score>_flow``, and ``flow`` and
    ``position`` (1 = first; ties by the scores' ranks, then the item). ``pieces`` is what heavy groups are measured by.
    """
    out, names = flows(items, group, item, scores, threshold, pieces)
    tie = Window.partitionBy("g", "flow").orderBy(*[F.col(f"rank{k}").asc_nulls_last() for k in range(len(scores))], "i")
    return out.join(names, "rid").withColumn("tie", F.row_number().over(tie)).select(
        F.col("g").alias(group), F.col("i").alias(item),
        *[F.col(f"{c}{k}").alias(f"{s}_{c}") for k, s in enumerate(scores) for c in ("rank", "flow")],
        "flow", (F.col("ahead") + F.col("tie")).alias("position"),
    )


SCORES = {"keyword_score": 1.0, "vector_score": 1.0}


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "search_results").select("query_id", page_key("page_id").alias("page_id"), *SCORES)
    return rows.filter("page_id <> ''")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that must come first: the head of the ranking, checked to be among the best two by either score.

    A page that isn't better than another by any score has no greater flow, as flows never fall when a value
    rises. Of a page among the best two by both scores at most one page is better by each, so at most two
    have a greater flow: all such pages are among those with at most two ahead.
    """
    out, names = flows(results(spark, sf_dir), "query_id", "page_id", SCORES)
    head = out.filter("ahead <= 2").filter("rank0 <= 2 AND rank1 <= 2").select("rid", F.col("g").alias("query_id"))
    return head.join(names, "rid").select("query_id", F.col("i").alias("page_id"))


def p4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ranking of every query, by equal weights of both scores."""
    return rank_items(results(spark, sf_dir), "query_id", "page_id", SCORES).select(
        "query_id", "page_id", F.col("position").cast("long").alias("position"), F.round("flow", 6).alias("flow")
    )


_KEY = "(CASE WHEN regexp_full_match(replace(lower(trim(page_id)),'-',''),'[0-9a-f]{32}') THEN regexp_replace(replace(lower(trim(page_id)),'-',''),'(.{8})(.{4})(.{4})(.{4})(.{12})','\\1-\\2-\\3-\\4-\\5') ELSE lower(trim(page_id)) END)"
_BEST = f"""best AS (SELECT query_id, {_KEY} AS page_id,
  max(CASE WHEN NOT isnan(keyword_score) THEN keyword_score END) AS k, max(CASE WHEN NOT isnan(vector_score) THEN vector_score END) AS v
  FROM search_results WHERE query_id IS NOT NULL AND trim(coalesce(page_id,'')) <> '' GROUP BY 1, 2)"""
P4_SQL = f"""WITH {_BEST},
k AS (SELECT query_id, page_id, rank() OVER (PARTITION BY query_id ORDER BY k DESC) AS r FROM best WHERE k IS NOT NULL),
v AS (SELECT query_id, page_id, rank() OVER (PARTITION BY query_id ORDER BY v DESC) AS r FROM best WHERE v IS NOT NULL)
SELECT k.query_id, k.page_id FROM k JOIN v ON k.query_id = v.query_id AND k.page_id = v.page_id WHERE k.r <= 2 AND v.r <= 2"""


def _flow_sql(s: str) -> str:
    return f"""p_{s} AS (SELECT query_id, page_id, {s} AS x,
    CASE WHEN count(*) OVER (PARTITION BY query_id) > 1 THEN (rank() OVER (PARTITION BY query_id ORDER BY {s}) - 1 + (count(*) OVER (PARTITION BY query_id, {s}) - 1) / 2.0) / (count(*) OVER (PARTITION BY query_id) - 1) ELSE 0.5 END AS pct,
    rank() OVER (PARTITION BY query_id ORDER BY {s} DESC) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM best WHERE {s} IS NOT NULL),
  f_{s} AS (SELECT a.query_id, a.page_id, any_value(a.r) AS r,
    CASE WHEN any_value(a.n) > 1 THEN sum(least(1, greatest(0, a.pct - b.pct) / 0.25) - least(1, greatest(0, b.pct - a.pct) / 0.25)) / (any_value(a.n) - 1) ELSE 0 END AS flow
    FROM p_{s} a JOIN p_{s} b ON a.query_id = b.query_id GROUP BY a.query_id, a.page_id)"""


P4_RANKING_SQL = f"""WITH {_BEST}, {_flow_sql('k')}, {_flow_sql('v')},
has AS (SELECT query_id, count(k) AS nk, count(v) AS nv FROM best GROUP BY 1),
s AS (SELECT b.query_id, b.page_id, f_k.r AS rk, f_v.r AS rv,
  round((coalesce(f_k.flow, CASE WHEN nk > 0 THEN -1 ELSE 0 END) + coalesce(f_v.flow, CASE WHEN nv > 0 THEN -1 ELSE 0 END)) / 2, 12) AS flow
  FROM best b JOIN has USING (query_id)
  LEFT JOIN f_k ON f_k.query_id = b.query_id AND f_k.page_id = b.page_id
  LEFT JOIN f_v ON f_v.query_id = b.query_id AND f_v.page_id = b.page_id)
SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY round(flow, 9) DESC, rk NULLS LAST, rv NULLS LAST, page_id) AS position, round(flow, 6) AS flow FROM s"""
