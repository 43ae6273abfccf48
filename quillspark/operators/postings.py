"""Keyword index and BM25 with field weights, prefixes and phrases."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.scalars import terms
from quillspark.operators import scoring
from quillspark.shared import Scratch, dense_numbers

# How many terms of a query count, the weights of text, heading and title, and how many rows of terms are broadcast at most.
MOST_TERMS = 32
MOST_BROADCAST = 1_000_000
FIELD_WEIGHTS = {"text": 1.0, "heading": 1.5, "title": 3.0}


def postings(chunks: DataFrame, fields=tuple(FIELD_WEIGHTS)) -> DataFrame:
    """``chunk_id, field, pos, term`` of chunks with the given text columns; null texts have no terms."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), terms(f).alias("terms")) for f in fields]))
    return chunks.select("chunk_id", each.alias("x")).select("chunk_id", "x.field", F.posexplode("x.terms").alias("pos", "term"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``qid, tno, j, m, token, prefix`` of ``qid, text`` rows: one row per token of every query term; a term of several tokens is a phrase.

    Terms are words of at least two characters, prefixes from four on, the first ``MOST_TERMS`` of a query. Null texts have none.
    """
    words = F.filter(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{Nd}_]+"), F.lit(0)), lambda w: F.char_length(w) >= 2)
    each = queries.select("qid", F.posexplode(F.slice(words, 1, MOST_TERMS)).alias("tno", "word"))
    split = each.select("qid", "tno", (F.char_length("word") >= 4).alias("prefix"), terms("word").alias("tokens")).withColumn("m", F.size("tokens")).filter("m > 0")
    out = split.select("qid", "tno", "m", "prefix", F.posexplode("tokens").alias("j", "token"))
    return out.withColumn("prefix", F.col("prefix") & (F.col("j") == F.col("m") - 1))


def resolved(index: DataFrame, tokens: DataFrame) -> DataFrame:
    """``token, prefix, term``: the terms of the dictionary that distinct tokens (``token, prefix``) stand for.

    Prefixes are resolved by equality too: each term of the dictionary offers all of its beginnings.
    """
    dictionary = index.select("term").distinct()
    exact = tokens.filter("NOT prefix").join(dictionary, F.col("token") == F.col("term"))
    beginnings = dictionary.select("term", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("term")), lambda n: F.left("term", n))).alias("token"))
    return exact.select("token", "prefix", "term").unionByName(tokens.filter("prefix").join(beginnings, "token").select("token", "prefix", "term"))


def phrases(index: DataFrame, words: DataFrame) -> DataFrame:
    """``tid, chunk_id, field, pos``: where a term of several tokens (``tid, m, j, token, prefix``, a row per token, and ``term`` in the
    dictionary) starts; its tokens are brought together by their common start."""
    start = index.join(words, "term").select("tid", "chunk_id", "field", (F.col("pos") - F.col("j")).alias("pos"), "j", "m")
    whole = start.groupBy("tid", "chunk_id", "field", "pos", "m").agg(F.count_distinct("j").alias("n")).filter("n = m")
    return whole.select("tid", "chunk_id", "field", "pos")


def numbered(owners: DataFrame) -> DataFrame:
    """``chunk_id, nth, page_id``: the pages of each chunk (mostly one), numbered from 0."""
    if "nth" in owners.columns:
        return owners
    return owners.groupBy("chunk_id").agg(F.sort_array(F.collect_set("page_id")).alias("pages")).select("chunk_id", F.posexplode("pages").alias("nth", "page_id"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast, unless it has too many rows for that."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


class Matches:
    """Queries numbered by their distinct terms, and for each chunk which of these it has how often; statistics are those of the whole index.

    ``found``: ``chunk_id, len, tids, fs``, a row per chunk of the index (a term may recur in ``tids``; its frequencies add up).
    A prefix or phrase is one term with a joint frequency: a chunk counts once however many expansions it has. The driver holds two
    numbers per query term and one per distinct term; postings are grouped by chunk and stay where they are.
    """

    def __init__(self, index: DataFrame, asked: DataFrame, weights: dict[str, float] = FIELD_WEIGHTS):
        self.scratch = scratch = Scratch(index.sparkSession)
        weight: Column = F.lit(0.0)
        for f, w in weights.items():
            weight = F.when(F.col("field") == f, F.lit(float(w))).otherwise(weight)
        each = asked.groupBy("qid", "tno").agg(F.sort_array(F.collect_list(F.struct("j", "token", "prefix"))).alias("tokens")).select(F.col("qid").cast("long").alias("qid"), "tokens")
        each = scratch.put(each)
        terms_, self.n_terms = scratch.put_counted(dense_numbers(each.select("tokens").distinct(), [], ["tokens"], "tid"))
        terms_ = terms_.select("tokens", F.col("tid").cast("int").alias("tid"))
        self.pairs = each.join(small(terms_, self.n_terms), "tokens").select("qid", "tid")
        words = terms_.select("tid", F.size("tokens").alias("m"), F.explode("tokens").alias("x")).select("tid", "m", "x.*")
        dictionary = scratch.put(index.select("term").distinct())
        found = words.join(resolved(dictionary, words.select("token", "prefix").distinct()), ["token", "prefix"])
        found = scratch.put(found.select("tid", "m", "j", "term"))
        known, n_known = scratch.put_counted(found.filter("m = 1").groupBy("term").agg(F.collect_set("tid").alias("tids")))
        several, n_several = scratch.put_counted(found.filter("m > 1"))
        hits = index.select("chunk_id", weight.alias("w"), "term").join(small(known, n_known), "term", "left").select("chunk_id", "w", "tids")
        rows = hits.mapInArrow(scoring.gathered, "chunk_id long, len long, tids array<int>, fs array<double>")
        if n_several:
            where = phrases(index, small(several, n_several)).select("chunk_id", F.lit(0).cast("long").alias("len"), F.array("tid").alias("tids"), F.array(weight).alias("fs"))
            rows = rows.unionByName(where)
        docs = rows.groupBy("chunk_id").agg(F.sum("len").alias("len"), F.collect_list(F.struct("tids", "fs")).alias("x"))
        self.found = docs.select("chunk_id", "len", F.flatten("x.tids").alias("tids"), F.flatten("x.fs").alias("fs"))

    def asked(self, docs: DataFrame) -> scoring.Asked:
        n_all, avg_len = docs.agg(F.count(F.lit(1)), F.avg("len")).first()
        counts = docs.select(F.explode(F.array_distinct("tids")).alias("tid")).groupBy("tid").agg(F.count(F.lit(1)).alias("df")).toArrow()
        df = np.zeros(self.n_terms)
        df[counts["tid"].to_numpy()] = counts["df"].to_numpy()
        pairs = self.pairs.toArrow()
        return scoring.Asked(pairs["qid"].to_numpy(), pairs["tid"].to_numpy(), df, n_all, avg_len or 1.0)

    def scores(self) -> DataFrame:
        """``qid, chunk_id, score`` of all matching chunks."""
        docs = self.scratch.put(self.found)
        asked = docs.sparkSession.sparkContext.broadcast(self.asked(docs))
        return docs.filter("chunk_id IS NOT NULL").mapInArrow(lambda b: scoring.all_scores(b, asked.value), "qid long, chunk_id long, score double")

    def best_pages(self, owners: DataFrame, most: int) -> DataFrame:
        """``qid, chunk_id, nth, score``: the ``most`` best pages of every query in each part of the chunks, each by its best chunk.

        ``owners``: ``chunk_id, page_id``, see :func:`numbered`. The chunks of a page are brought together, so a page has one row
        per query at most and its id needn't go along.
        """
        docs = self.scratch.put(self.found.join(numbered(owners), "chunk_id", "left").select("chunk_id", "nth", "page_id", "len", "tids", "fs"))
        asked = docs.sparkSession.sparkContext.broadcast(self.asked(docs.filter("coalesce(nth, 0) = 0")))
        paged = docs.filter("page_id IS NOT NULL").repartition("page_id").sortWithinPartitions("page_id")
        return paged.mapInArrow(lambda b: scoring.best_pages(b, asked.value, most), "qid long, chunk_id long, nth int, score double")


def bm25(index: DataFrame, asked: DataFrame, weights: dict[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """``qid, chunk_id, score``; statistics are those of the whole index, filters come after."""
    return Matches(index, asked, weights).scores()
