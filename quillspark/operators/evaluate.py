"""Retrieval quality: hit@k, misses, mean reciprocal rank, report."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.scalars import canonical_page_id, percent


def read_cases(text: str) -> list[dict]:
    """Cases ``[{q, expect, note?}]``; each needs q and expect, else an error names its number from 1."""
    cases = json.loads(text)
    for n, c in enumerate(cases, 1):
        if not c.get("q") or not c.get("expect"):
            raise ValueError(f"case {n}: q and expect are required")
    return cases


def rank_of(results: DataFrame, cases: DataFrame) -> DataFrame:
    """``qid, mode, rank``: the 1-based rank of the expected page, 0 if it is absent.

    ``results``: ``qid, mode, page_id, position``; ``cases``: ``qid, mode, expect``; ids compare in canonical form.
    """
    hit = results.select("qid", "mode", canonical_page_id("page_id").alias("key"), "position")
    want = cases.select("qid", "mode", canonical_page_id("expect").alias("key"))
    return want.join(hit, ["qid", "mode", "key"], "left").groupBy("qid", "mode").agg(F.coalesce(F.min("position"), F.lit(0)).alias("rank"))


def metrics(ranks: DataFrame) -> DataFrame:
    """Per mode: cases, hit@1, hit@3, hit@5, misses, whole percents of hits, MRR."""
    at = lambda k: F.count_if(F.col("rank").between(1, k))
    n = F.count(F.lit(1))
    return ranks.groupBy("mode").agg(
        n.alias("cases"), at(1).alias("hit1"), at(3).alias("hit3"), at(5).alias("hit5"), F.count_if(F.col("rank") == 0).alias("missed"),
        percent(at(1), n).alias("hit1_percent"), percent(at(3), n).alias("hit3_percent"),
        F.round(F.avg(F.when(F.col("rank") > 0, 1 / F.col("rank")).otherwise(0.0)), 6).alias("mrr"),
    )


def best_rank(ranks: DataFrame) -> DataFrame:
    """``qid, best``: the best rank over all modes, null if no mode found the page."""
    return ranks.groupBy("qid").agg(F.min(F.nullif(F.col("rank"), F.lit(0))).alias("best"))


def report(ranks: DataFrame) -> str:
    """Text table per mode and the cases that no mode ranked first."""
    lines = ["mode  cases  hit@1  hit@3  hit@5  missed  mrr"]
    for r in metrics(ranks).orderBy("mode").collect():
        lines.append(f"{r['mode']}  {r['cases']}  {r['hit1']}  {r['hit3']}  {r['hit5']}  {r['missed']}  {r['mrr']:.3f}")
    rest = best_rank(ranks).filter("best IS NULL OR best > 1").orderBy("qid").collect()
    return "\n".join([*lines, *(f"case {r['qid']}: best rank {r['best'] or 'none'}" for r in rest)])
