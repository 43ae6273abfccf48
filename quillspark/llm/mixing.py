"""Mixing sources to target weights (p9).

Method: soft-membership mixing. A classifier learnt from the labelled rows gives each document
posteriors over the domains (a labelled document belongs to its own label); nonnegative
document rates, at most the permitted number of repeats, are fitted by distributed projected
gradient least squares so that the expected tokens per domain meet the targets; the rates
are then rounded to whole copies with the domain totals kept.

The classifier is multinomial naive Bayes on hashed words, counted over all labelled rows.
Documents with equal posteriors and cap have equal gradients, hence equal rates, so the fit
runs on groups of them; a labelled domain is one group, whatever its size. Texts are read where they are, once to train
and once to count tokens and predict; only numbers are shuffled.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.tokens import VOCABULARY, token_counts
from quillspark.shared import Scratch, dense_numbers, running_totals
from quillspark.tables import read

BUCKETS = 1 << 13
#: Rounds after which a fit that neither meets the targets nor stands still is given up with an error.
ROUNDS = 400
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")


def label_of(name: str):
    """Source names compare without regard to letter case and surrounding blanks; '' is none."""
    return F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))


class _Buckets(dict):
    """Buckets of words met before; emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        out = self[word] = xxhash.xxh32_intdigest(word) % BUCKETS
        return out


_bucket = _Buckets().__getitem__


def features(text: str | None) -> np.ndarray:
    """Hashed features of a whole text: words (numbers as one), how lines begin, and its length by powers of two."""
    if not text:
        return np.zeros(0, np.int64)
    names = ["0" if w.isdigit() else w for w in _WORD.findall(text.lower())]
    lines = text.split("\n")
    names += ["^" + line[:2] for line in lines if line[:1] and not line[0].isalnum()]
    names += [f"#{len(text).bit_length()}"] * 8 + [f"/{len(lines).bit_length()}"] * 4
    return np.fromiter(map(_bucket, names), np.int64, len(names))


@dataclass
class Classifier:
    labels: list[str]
    prior: np.ndarray
    weight: np.ndarray  # labels x buckets, log probabilities

    def posteriors(self, text: str | None) -> np.ndarray:
        """Posteriors; evidence is tempered by the square root of the text's length, as words depend on each other."""
        x = features(text)
        score = self.prior + (self.weight[:, x].sum(1) / math.sqrt(max(len(x), 1)) if len(x) else 0)
        p = np.exp(score - score.max())
        return p / p.sum()


def train(labelled: DataFrame) -> Classifier:
    """Classifier from ``label, text`` rows, all of them. Shuffled are at most labels x buckets counts per partition."""

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for pdf in batches:
            for label, text in zip(pdf["label"], pdf["text"]):
                own = seen.setdefault(label, np.zeros(BUCKETS, np.int64))
                np.add.at(own, features(text), 1)
                docs[label] = docs.get(label, 0) + 1
        for label, own in seen.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"label": label, "bucket": np.append(at, -1), "n": np.append(own[at], docs[label])})

    counts = labelled.mapInPandas(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    labels = sorted(counts["label"].unique())
    weight, prior = np.ones((len(labels), BUCKETS)), np.ones(len(labels))
    for k, label in enumerate(labels):
        own = counts[counts["label"] == label]
        words = own[own["bucket"] >= 0]
        weight[k, words["bucket"].to_numpy()] += words["n"].to_numpy()
        prior[k] += own.loc[own["bucket"] < 0, "n"].sum()
    return Classifier(labels, np.log(prior / max(prior.sum(), 1)), np.log(weight / weight.sum(1, keepdims=True)))


def memberships(documents: DataFrame, model: Classifier, domains: list[str]) -> DataFrame:
    """``documents`` (with ``label, text``) with ``p``, the membership in each of ``domains``; the text is dropped.

    One where the label is the domain, nothing where it is another label, and the posteriors of the
    classifier where there is no label (rounded to six decimals).
    """
    at = [domains.index(x) if x in domains else -1 for x in model.labels]

    def run(batches):
        for pdf in batches:
            out = []
            for label, text in zip(pdf["label"], pdf["text"]):
                p = np.zeros(len(domains))
                if label:
                    if label in domains:
                        p[domains.index(label)] = 1.0
                elif model.labels:
                    for k, x in zip(at, model.posteriors(text)):
                        if k >= 0:
                            p[k] = round(float(x), 6)
                out.append(p)
            yield pdf.drop(columns="text").assign(p=out)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.schema if f.name != "text")
    return documents.mapInPandas(run, f"{schema}, p array<double>")


@dataclass
class Fit:
    """``history``: residuals of the rounds; ``off``: greatest distance of a domain's total from its target, as a share of it;
    ``met``: whether that is within the tolerance. If not, the rates stand still at the optimum, as the problem is convex."""

    history: list[np.ndarray]
    off: float
    met: bool


def fit_rates(groups: DataFrame, goal: np.ndarray, available: np.ndarray, tolerance: float = 1e-5, rounds: int = ROUNDS) -> Fit:
    """Projected gradient on rates of ``groups`` (``p, cap, tokens``).

    Minimises the sum over domains of (total - goal)^2 / available. In the metric in which a group
    weighs its tokens the gradient of a rate is p . residual with residual = (total - goal) /
    available, and a step of 1 never overshoots, as memberships sum to at most 1. A group's rate
    follows from the residuals so far (see :func:`rate_of`), so a round is one pass over the
    groups that sends one vector per partition, and nothing is stored between rounds. It ends when all targets are
    met or no rate moves any more; otherwise it raises.
    """
    history: list[np.ndarray] = []
    safe = np.where(available > 0, available, 1)
    while True:
        steps = [h.copy() for h in history]

        def total(batches, steps=steps):
            out, moved = np.zeros(len(goal)), 0.0
            for pdf in batches:
                if len(pdf):
                    p, cap, tokens = np.stack(pdf["p"].to_numpy()), pdf["cap"].to_numpy(), pdf["tokens"].to_numpy()
                    r = rate_of(p, cap, steps)
                    out += (r * tokens) @ p
                    if steps:
                        moved += float((np.abs(r - rate_of(p, cap, steps[:-1])) * tokens).sum())
            yield pd.DataFrame({"k": np.arange(-1, len(goal)), "v": np.append(moved, out)})

        now, moved = np.zeros(len(goal)), 0.0
        for r in groups.mapInPandas(total, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            if r["k"] < 0:
                moved = r["v"]
            else:
                now[r["k"]] = r["v"]
        off = float((np.abs(now - goal)[goal > 0] / goal[goal > 0]).max(initial=0))
        met = off < tolerance
        if met or history and moved < tolerance * 0.01 * max(goal.sum(), 1):
            return Fit(history, off, met)
        if len(history) >= rounds:
            raise RuntimeError(f"the rates still move after {rounds} rounds; a target is missed by {off:.2%}")
        history.append((now - goal) / safe)


def rate_of(p: np.ndarray, cap: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    """Rates after the given residuals, from 1 (or the cap), clipped to [0, cap]; 0 without any membership."""
    r = np.where(p.sum(1) > 0, np.minimum(1.0, cap), 0.0)
    for h in history:
        r = np.clip(r - p @ h, 0, cap)
    return r


def _measured(documents: DataFrame, model: Classifier, domains: list[str], vocabulary: str) -> DataFrame:
    """``doc_id, label, n_tokens, p``, one row per id: of repeated ids the row of the least digest counts. No text is shuffled."""
    rows = documents.filter("doc_id IS NOT NULL").select("doc_id", label_of("source").alias("label"), F.xxhash64("text", "source").alias("digest"), "text")
    counted = token_counts(rows.withColumn("body", F.col("text")), "label", "digest", "body", vocabulary=vocabulary).withColumnRenamed("body", "text")
    each = memberships(counted.select("doc_id", "label", "digest", "n_tokens", "text"), model, domains)
    one = each.groupBy("doc_id").agg(F.min(F.struct("digest", "label", "n_tokens", "p")).alias("x"))
    return one.select("doc_id", "x.label", "x.n_tokens", "x.p")


def whole_copies(rated: DataFrame) -> DataFrame:
    """``doc_id, label, n_tokens, rate, p, copies`` of labelled documents (``cap`` too): whole copies with the domain totals kept.

    Each document gets the lower whole number. One more get first those in hashed order, as long as they fit into what
    the domain still lacks, then, of the others, the shortest, until the next one would no longer fit: the total
    falls short of the target by less than the shortest document left over, however long others are.
    """
    whole = F.floor(F.col("rate") + 1e-9)
    base = rated.withColumn("whole", whole)
    lacks = base.groupBy("label").agg(F.sum((F.col("rate") - F.col("whole")) * F.col("n_tokens")).alias("lack"))  # a row per domain
    able = running_totals(base.filter("whole < cap"), ["label"], ["doc_id"], F.col("n_tokens"), "before").join(F.broadcast(lacks), "label")
    first = Scratch(rated.sparkSession).put(able.withColumn("more", F.col("before") + F.col("n_tokens") <= F.col("lack")))
    gaps = first.groupBy("label").agg(F.max("lack").alias("lack"), F.sum(F.when(F.col("more"), F.col("n_tokens")).otherwise(0)).alias("got"))
    gaps = gaps.select("label", (F.col("lack") - F.col("got")).alias("gap"))
    rest = first.filter("NOT more").join(F.broadcast(gaps), "label").filter("n_tokens <= gap").select("doc_id", "label", "n_tokens", "gap")
    # how many of each size: all sizes that fit together, and of the next as many as there is room for
    sizes = rest.groupBy("label", "n_tokens", "gap").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("label").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("gap") - F.coalesce(F.sum(F.col("n") * F.col("n_tokens")).over(before), F.lit(0))
    taken = sizes.select("label", "n_tokens", F.greatest(F.least(F.floor(room / F.col("n_tokens")), F.col("n")), F.lit(0)).alias("take")).filter("take > 0")
    second = dense_numbers(rest.join(taken, ["label", "n_tokens"]), ["label", "n_tokens"], ["doc_id"], "number").filter("number < take").select("doc_id", F.lit(1).alias("extra"))
    more = first.filter("more").select("doc_id", F.lit(1).alias("extra")).unionByName(second)
    return base.join(more, "doc_id", "left").select("doc_id", "label", "n_tokens", "rate", "p", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("copies"))


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, total: float | None = None) -> tuple[DataFrame, Fit]:
    """Selected documents ``doc_id, source_name, n_tokens, rate, copies, p`` with ``copies >= 1``, and how the fit ended.

    ``documents``: ``doc_id, text, source``; ``targets``: ``source_name, target_share, max_repeats``
    (few rows by nature). Targets without documents get nothing and the other shares are scaled up;
    documents of sources without target are not used. Documents without source enter by their
    posteriors, with the smallest of all caps. ``total`` is the size of the mix in tokens; by default
    the largest for which every target can be met within its repeats. Null ids and texts without
    tokens are left out; repeated ids count once. Whole copies: see :func:`whole_copies`; documents
    without source get their fraction by chance (of their id's hash).
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    wanted = {
        r["s"]: (r["share"], r["cap"])
        for r in targets.groupBy(label_of("source_name").alias("s")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).collect()
        if r["s"] and (r["share"] or 0) > 0 and (r["cap"] or 0) > 0
    }
    domains = sorted(wanted)
    empty = spark.createDataFrame([], "doc_id long, source_name string, n_tokens long, rate double, copies long, p array<double>"), Fit([], 0.0, True)
    if not domains:
        return empty
    model = train(documents.select(label_of("source").alias("label"), "text").filter("label <> ''"))
    least = min(c for _, c in wanted.values())
    caps = F.coalesce(*[F.when(F.col("label") == d, F.lit(float(c))) for d, (_, c) in wanted.items()], F.lit(float(least)))
    docs = scratch.put(
        _measured(documents, model, domains, vocabulary).filter(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) > 0).filter("n_tokens > 0").withColumn("cap", caps)
    )
    groups = scratch.put(docs.groupBy("p", "cap").agg(F.sum("n_tokens").alias("tokens")))
    own = {r["label"]: r["n"] for r in docs.filter("label <> ''").groupBy("label").agg(F.sum("n_tokens").alias("n")).collect()}
    present = [d for d in domains if own.get(d)]
    if not present:
        return empty
    scale = sum(wanted[d][0] for d in present)
    share = np.array([wanted[d][0] / scale if d in own else 0.0 for d in domains])
    size = total or min(own[d] * wanted[d][1] / (wanted[d][0] / scale) for d in present)
    # available tokens per domain, for the scale of the steps; soft members add a little
    soft = docs.filter("label = ''").select(F.posexplode("p").alias("k", "x"), "n_tokens").groupBy("k").agg(F.sum(F.col("x") * F.col("n_tokens")).alias("v"))
    available = np.array([float(own.get(d, 0)) for d in domains])
    for r in soft.collect():
        available[r["k"]] += r["v"]
    fit = fit_rates(groups, share * size, available)

    def rate(batches):
        for pdf in batches:
            if len(pdf):
                pdf["rate"] = rate_of(np.stack(pdf["p"].to_numpy()), pdf["cap"].to_numpy(), fit.history)
            else:
                pdf["rate"] = pd.Series(dtype=float)
            yield pdf

    rated = scratch.put(docs.mapInPandas(rate, "doc_id long, label string, n_tokens long, p array<double>, cap double, rate double"))
    sure = whole_copies(rated.filter("label <> ''"))
    whole = F.floor(F.col("rate") + 1e-9)
    chance = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / 1_000_000 < F.col("rate") - whole
    unsure = rated.filter("label = ''").select("doc_id", "label", "n_tokens", "rate", "p", (whole + chance.cast("long")).alias("copies"))
    rows = sure.unionByName(unsure).filter("copies >= 1").select("doc_id", F.col("label").alias("source_name"), "n_tokens", "rate", "copies", "p")
    return rows, fit


def shares(selected: DataFrame, targets: DataFrame, fit: Fit) -> DataFrame:
    """Per target: its share, the tokens and share reached by its own documents, the share by expected membership, and how the fit ended.

    ``p`` is ordered like the sorted names of the targets with a positive share and cap.
    """
    spark = selected.sparkSession
    t = targets.groupBy(label_of("source_name").alias("source_name")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    names = sorted(r["source_name"] for r in t.filter("target_share > 0 AND max_repeats > 0").collect() if r["source_name"])
    weight = F.col("n_tokens") * F.col("copies")
    table = Scratch(spark).put(selected)
    by_label = table.groupBy("source_name").agg(F.sum(weight).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_repeats"))
    order = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "source_name string, k int")
    by_member = table.select(F.posexplode("p").alias("k", "x"), weight.alias("w")).groupBy("k").agg(F.sum(F.col("x") * F.col("w")).alias("expected"))
    everything = table.agg(F.sum(weight)).collect()[0][0] or 0
    return (
        t.join(F.broadcast(order), "source_name", "left")
        .join(F.broadcast(by_member), "k", "left")
        .join(F.broadcast(by_label), "source_name", "left")
        .select(
            "source_name", "target_share", "max_repeats",
            F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.round(F.coalesce(F.col("tokens") / F.lit(float(everything or 1)), F.lit(0.0)), 6).alias("actual_share"),
            F.round(F.coalesce(F.col("expected") / F.lit(float(everything or 1)), F.lit(0.0)), 6).alias("expected_share"),
            F.lit(len(fit.history)).alias("fit_rounds"), F.lit(round(fit.off, 9)).alias("fit_off"), F.lit(fit.met).alias("fit_met"),
        )
    )


def selection(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Fit]:
    return mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), read(spark, sf_dir, "mix_targets"))


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected documents with their number of copies."""
    return selection(spark, sf_dir)[0].select("doc_id", "source_name", "n_tokens", "copies")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares aimed at and reached, per source."""
    selected, fit = selection(spark, sf_dir)
    return shares(selected, read(spark, sf_dir, "mix_targets"), fit)
