"""Filling fixed-capacity containers with items (p8).

Method: Martello-Toth dominance reduction. Small sets of documents that provably dominate
every alternative are fixed for good, which shrinks the instance; the remainder is packed
best-fit, largest first.

Sizes are whole tokens up to the capacity, so an instance is a histogram of at most
``capacity`` sizes however many documents there are. The driver plans on the histogram, many equal
containers at a time; the plan (runs of equal containers) is then applied to the documents
in Spark by their number within their size.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.tokens import VOCABULARY, token_counts
from quillspark.shared import Scratch, dense_numbers
from quillspark.tables import read


class Plan:
    """Runs ``(size, first number, number of containers, first container, items per container)``."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {s: n for s, n in histogram.items() if n > 0 and 0 < s <= capacity}
        self.sizes = sorted(self.left)
        self.used = dict.fromkeys(self.sizes, 0)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.bins = self.fixed = 0
        self._reduce()
        self._best_fit()

    def _emit(self, pattern: dict[int, int], times: int) -> None:
        for s, k in pattern.items():
            self.runs.append((s, self.used[s], times, self.bins, k))
            self.used[s] += times * k
        self.bins += times

    def _take(self, pattern: dict[int, int]) -> None:
        """Fix ``pattern`` as often as its items last."""
        times = min(self.left[s] // k for s, k in pattern.items())
        self._emit(pattern, times)
        self.fixed += times
        for s, k in pattern.items():
            self.left[s] -= times * k
            if not self.left[s]:
                del self.left[s]
                self.sizes.pop(bisect.bisect_left(self.sizes, s))

    def _smallest(self, n: int, j: int) -> list[int]:
        """The n smallest items besides one of size j."""
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(self.left[s] - (s == j), n - len(out))
            if len(out) == n:
                break
        return out

    def _largest(self, room: int, *without: int) -> int:
        """The largest size of at most ``room`` of which an item is left besides ``without``; 0 if there is none."""
        at = bisect.bisect_right(self.sizes, room) - 1
        while at >= 0:
            s = self.sizes[at]
            if self.left[s] > without.count(s):
                return s
            at -= 1
        return 0

    def _best_pair(self, room: int, j: int) -> int:
        """The greatest sum of two items within ``room``, besides one of size j."""
        best, hi = 0, bisect.bisect_right(self.sizes, room) - 1
        for a in self.sizes[: hi + 1]:
            if self.left[a] > (a == j):
                b = self._largest(min(room - a, self.sizes[hi]), j, a)
                if b:
                    best = max(best, a + b)
        return best

    def _dominating(self, j: int) -> dict[int, int] | None:
        """A set with an item of size j that dominates all feasible sets with it, if one of at most three is known."""
        room = self.capacity - j
        low = self._smallest(3, j)
        if not low or low[0] > room:
            return {j: 1}
        k = self._largest(room, j)
        pair = {j: 2} if k == j else {j: 1, k: 1}
        if k == room or len(low) < 2 or low[0] + low[1] > room:
            return pair  # a perfect fit, or no two others fit: the largest single item stands for any
        if len(low) < 3 or sum(low) > room:
            if self._best_pair(room, j) <= k:
                return pair  # at most two others fit, and any two fit in place of k
            b = self._largest(room - k, j, k)
            if b and b >= self._largest(room // 2, j):
                three: dict[int, int] = {}
                for s in (j, k, b):
                    three[s] = three.get(s, 0) + 1
                return three  # of any two others the smaller is at most half the room, so b stands for it and k for the larger
        return None

    def _reduce(self) -> None:
        again = True
        while again:
            again = False
            for j in reversed(list(self.sizes)):
                while j in self.left and (pattern := self._dominating(j)):
                    if any(self.left[s] < k for s, k in pattern.items()):
                        break
                    self._take(pattern)
                    again = True

    def _best_fit(self) -> None:
        open_: dict[int, list[tuple[dict[int, int], int]]] = {}
        rooms: list[int] = []

        def put(room: int, pattern: dict[int, int], times: int) -> None:
            if times:
                if room not in open_:
                    bisect.insort(rooms, room)
                    open_[room] = []
                open_[room].append((pattern, times))

        def place(s: int, n: int, room: int, pattern: dict[int, int], times: int) -> int:
            """Fill up to ``times`` containers, each with as many as fit before the next; return what is left."""
            each = room // s
            full = min(times, n // each)
            put(room - each * s, pattern | {s: each}, full)
            n -= full * each
            times -= full
            if n and times:
                put(room - n * s, pattern | {s: n}, 1)
                n, times = 0, times - 1
            put(room, pattern, times)
            return n

        for s in reversed(self.sizes):
            n = self.left[s]
            while n:
                at = bisect.bisect_left(rooms, s)
                if at == len(rooms):
                    n = place(s, n, self.capacity, {}, -(-n // (self.capacity // s)))
                else:
                    room = rooms[at]
                    pattern, times = open_[room].pop()
                    if not open_[room]:
                        del open_[room]
                        rooms.pop(at)
                    n = place(s, n, room, pattern, times)
        for room in rooms:
            for pattern, times in open_[room]:
                if pattern:
                    self._emit(pattern, times)


def pieces(sizes: DataFrame, limits: list[tuple[str, int]]) -> DataFrame:
    """``container, capacity, doc_id, piece, first_token, n_tokens``: whole texts, or pieces of a text larger than the container."""
    cap = F.array(*[F.struct(F.lit(c).alias("container"), F.lit(int(n)).cast("long").alias("capacity")) for c, n in limits])
    each = sizes.select("doc_id", F.col("n_tokens").alias("whole"), F.explode(cap).alias("l")).select(
        "doc_id", "whole", "l.container", "l.capacity"
    )
    last = F.greatest(F.ceil(F.col("whole") / F.col("capacity")) - 1, F.lit(0))
    cut = each.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    first = F.col("piece") * F.col("capacity")
    return cut.select(
        "container", "capacity", "doc_id", "piece", first.alias("first_token"), F.least(F.col("whole") - first, F.col("capacity")).alias("n_tokens")
    )


def pack(sizes: DataFrame, limits: list[tuple[str, int]]) -> DataFrame:
    """Pieces with their container number ``bin_id`` (0, 1, .. per kind of container).

    ``sizes``: ``doc_id, n_tokens``; a null id is left out, of repeated ids the greatest size counts,
    a null or negative size is 0. Texts without tokens need no room: their ``bin_id`` is -1.
    ``limits`` has few rows by nature; their histogram has at most the sum of their capacities.
    """
    spark = sizes.sparkSession
    if not limits:
        return spark.createDataFrame([], "container string, bin_id long, doc_id long, piece long, first_token long, n_tokens long")
    one = sizes.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.greatest(F.coalesce(F.max("n_tokens"), F.lit(0)), F.lit(0)).alias("n_tokens"))
    items = Scratch(spark).put(pieces(one, limits))
    counts: dict[str, dict[int, int]] = {c: {} for c, _ in limits}
    for r in items.groupBy("container", "n_tokens").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["container"]][r["n_tokens"]] = r["n"]
    table: dict[tuple[str, int], list] = {}
    for container, capacity in limits:
        for size, first, times, bin_id, each in Plan(counts[container], capacity).runs:
            table.setdefault((container, size), []).append((first, times, bin_id, each))
    lookup = {k: np.array(sorted(v), np.int64) for k, v in table.items()}
    numbered = dense_numbers(items, ["container", "n_tokens"], ["doc_id", "piece"], "number")

    def place(batches):
        for pdf in batches:
            out = np.full(len(pdf), -1, np.int64)
            for key, rows in pdf.groupby(["container", "n_tokens"]).indices.items():
                runs = lookup.get((key[0], int(key[1])))
                if runs is not None:
                    number = pdf["number"].to_numpy()[rows]
                    at = np.searchsorted(runs[:, 0], number, side="right") - 1
                    out[rows] = runs[at, 2] + (number - runs[at, 0]) // runs[at, 3]
            yield pdf.assign(bin_id=out)[["container", "bin_id", "doc_id", "piece", "first_token", "n_tokens"]]

    return numbered.mapInPandas(place, "container string, bin_id long, doc_id long, piece long, first_token long, n_tokens long")


def packed(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    limits = [(r["container"], r["capacity_tokens"]) for r in read(spark, sf_dir, "pack_limits").collect()]
    return pack(token_counts(read(spark, sf_dir, "documents"), vocabulary=vocabulary), limits)


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes, for each capacity."""
    return packed(spark, sf_dir)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, the least number that could do by volume, and the share of room filled."""
    limits = read(spark, sf_dir, "pack_limits").select("container", F.col("capacity_tokens").cast("long").alias("capacity"))
    used = packed(spark, sf_dir).filter("bin_id >= 0").groupBy("container").agg(
        (F.max("bin_id") + 1).alias("bins"), F.sum("n_tokens").alias("tokens")
    )
    return used.join(F.broadcast(limits), "container").select(
        "container", "capacity", "bins", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins"),
        F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6).alias("fill"),
    )
