"""Most similar vectors for every vector (p3).

Method: a hierarchical k-means tree with best-bin-first traversal through a priority queue, widening the
visits until calibrated recall is reached.

* The upper levels of the tree are fitted on a bounded sample (``sample_rows``) and sent to all tasks; their
  leaves are buckets. Within a bucket the tree goes on over all of its rows, built where the bucket is
  searched, down to leaves of ``LEAF_ROWS`` rows, so leaves don't grow with the data.
* Best-bin-first: a query goes down to the nearest leaf and puts the branches it passes by into its priority
  queue; the nearest branch in the queue is gone down next, until enough leaves are visited. A batch of queries
  is traversed at once, each with a queue of its own; a node's centres are compared only with the queries that open it.
* A row is stored in its nearest bucket and a query visits its ``visits`` nearest ones, by the same traversal. Where
  every row is a query, a pair that one side finds counts for both. The width is calibrated on a bounded set of queries
  that are compared with all rows; within a bucket on a bounded set of its queries that are compared with all rows of it.
* Exact copies are grouped first, so that however many copies a vector has, it is searched once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.shared import Scratch
from quillspark.tables import read

DIM = 64
#: Rows of a bucket and of a leaf that the tree aims at; smallest ids kept of a group of copies (one more than are asked for).
BUCKET_ROWS, LEAF_ROWS, LOW_IDS = 8_000, 128, 6
#: Widths tried in calibration.
WIDTHS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024)


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float32)
    n = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x / np.where(n == 0, 1, n)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit centres, centre of each row) of spherical k-means, moved by at most ``most`` of the rows."""
    own = x if len(x) <= most else x[rng.choice(len(x), most, replace=False)]
    centres = own[rng.choice(len(own), k, replace=False)]
    for _ in range(rounds):
        at = (own @ centres.T).argmax(1)
        member = np.zeros((len(own), k), np.float32)
        member[np.arange(len(own)), at] = 1
        sums = member.T @ own
        n = np.sqrt(np.einsum("ij,ij->i", sums, sums))[:, None]
        centres = np.where(n > 0, sums / np.where(n == 0, 1, n), centres)
    return centres, (x @ centres.T).argmax(1)


@dataclass
class Tree:
    """Nodes by number, the children of a node in a row: centre, first child and number of children, leaf number (-1 inside)."""

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def visit(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The ``visits`` leaves best-bin-first reaches for each unit row, in order; -1 where the tree has fewer."""
        out = np.full((len(x), min(visits, self.leaves)), -1, np.int32)
        all_rows = np.arange(len(x))
        slots = 0
        queue, node = np.full((len(x), 0), -np.inf, np.float32), np.zeros((len(x), 0), np.int32)
        at = np.zeros(len(x), np.int32)  # the branch each row goes down
        live = all_rows
        for step in range(out.shape[1]):
            if step:  # pop the best branch
                best = queue.argmax(1)
                live = np.flatnonzero(queue[all_rows, best] > -np.inf)
                at = np.where(queue[all_rows, best] > -np.inf, node[all_rows, best], -1)
                queue[all_rows, best] = -np.inf
            going = live[self.leaf[at[live]] < 0]
            while len(going):
                order = going[np.argsort(at[going], kind="stable")]
                nodes, starts = np.unique(at[order], return_index=True)
                wide = int(self.count[nodes].max())
                pushed = np.full((len(x), wide), -np.inf, np.float32)
                kids = np.zeros((len(x), wide), np.int32)
                for n, rows in zip(nodes, np.split(order, starts[1:])):
                    a, k = self.first[n], self.count[n]
                    s = x[rows] @ self.centres[a : a + k].T
                    top = s.argmax(1)
                    at[rows] = a + top
                    s[np.arange(len(rows)), top] = -np.inf
                    pushed[rows, :k] = s
                    kids[rows, :k] = np.arange(a, a + k)
                if out.shape[1] > 1:
                    queue, node = np.hstack([queue, pushed]), np.hstack([node, kids])
                    slots += wide
                    if slots > 4 * out.shape[1] + 64:  # no more branches than visits are left can ever be popped
                        keep = min(out.shape[1], queue.shape[1] - 1)
                        pick = np.argpartition(-queue, keep, axis=1)[:, :keep]
                        queue, node = np.take_along_axis(queue, pick, 1), np.take_along_axis(node, pick, 1)
                        slots = keep
                going = going[self.leaf[at[going]] < 0]
            out[live, step] = self.leaf[at[live]]
        return out


def fit(x: np.ndarray, leaves: float, branching: int = 16, least: int = 8, seed: int = 7, rounds: int = 5, most: int = 4096) -> tuple[Tree, np.ndarray]:
    """(tree over unit rows with about so many leaves, the leaf of each row).

    Rows are divided until a part holds a share of 1 / ``leaves`` or fewer than 2 x ``least`` rows. Equal rows can't be divided.
    """
    rng = np.random.default_rng(seed)
    dim = x.shape[1] if x.ndim == 2 else DIM
    centres, first, count, leaf = [np.zeros(dim, np.float32)], [0], [0], [-1]
    home = np.zeros(len(x), np.int32)
    queue, made, at = [(0, np.arange(len(x)))], 0, 0
    share = max(len(x), 1) / max(leaves, 1)
    while at < len(queue):
        n, own = queue[at]
        at += 1
        want = min(branching, math.ceil(len(own) / share), len(own) // least)
        parts: list[np.ndarray] = []
        if want >= 2:
            found, near = _kmeans(x[own], want, rng, rounds, most)
            parts = [np.flatnonzero(near == i) for i in range(want)]
            used = [i for i in range(want) if len(parts[i])]
        if want < 2 or len(used) < 2:
            leaf[n] = made
            home[own] = made
            made += 1
            continue
        first[n], count[n] = len(centres), len(used)
        for i in used:
            centres.append(found[i])
            first.append(0)
            count.append(0)
            leaf.append(-1)
            queue.append((len(centres) - 1, own[parts[i]]))
    return Tree(np.asarray(centres, np.float32), np.asarray(first), np.asarray(count), np.asarray(leaf, np.int32)), home


def _matrix(vecs) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), np.int8).reshape(-1, DIM)


def _arrow_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of int8 of an Arrow column of DIM bytes each, without a Python object per row."""
    if isinstance(column, pa.ChunkedArray):
        parts = [_arrow_matrix(c) for c in column.chunks]
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros((0, DIM), np.int8)
    if not len(column):
        return np.zeros((0, DIM), np.int8)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, ends, data = column.buffers()
    start = int(np.frombuffer(ends, kind, 1, column.offset * np.dtype(kind).itemsize)[0])
    return np.frombuffer(data, np.int8, len(column) * DIM, start).reshape(-1, DIM)


def usable(vectors: DataFrame) -> DataFrame:
    """``id, model, vec`` of comparable vectors: a dimension of 64, 64 bytes, not all zero, no nulls; repeated rows stay."""
    v = vectors.filter(
        (F.col("dim") == DIM) & (F.octet_length("vec") == DIM) & (F.col("vec") != F.lit(bytes(DIM)))
    ).filter("chunk_id IS NOT NULL AND model IS NOT NULL")
    return v.select(F.col("chunk_id").alias("id"), "model", "vec")


@dataclass
class Index:
    """``items``: distinct vectors ``vid, model, vec, h1, h2, ids`` (the smallest ids), ``copies``; ``ids``: all ``h1, h2, id``."""

    items: DataFrame
    ids: DataFrame
    tree: Tree
    rows: int
    scratch: Scratch


def build(vectors: DataFrame, bucket_rows: int = BUCKET_ROWS, sample_rows: int = 20_000) -> Index:
    """Index of ``id, model, vec`` rows. ``sample_rows`` bounds what the upper levels are fitted on, nothing else.

    A vector is known by 128 bits of hash, under which its ids are gathered without moving it; of a group of copies only
    the smallest ids are kept with it, cut before the shuffle.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    keyed = vectors.select("id", "model", "vec", F.xxhash64("model", "vec").alias("h1"), F.xxhash64("vec", F.lit(7), "model").alias("h2"))
    ids = keyed.select("h1", "h2", "id").distinct()
    first = Window.partitionBy("h1", "h2").orderBy("id")
    low = ids.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= LOW_IDS).groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    each = keyed.groupBy("h1", "h2").agg(F.first("model").alias("model"), F.first("vec").alias("vec"), F.min("id").alias("a"), F.max("id").alias("b"))
    items, rows = scratch.put_counted(
        each.join(low, ["h1", "h2"]).select(F.monotonically_increasing_id().alias("vid"), "model", "vec", "h1", "h2", "ids", F.get("ids", F.size("ids") - 1).alias("last"), "b")
    )
    slots = 1 << 24
    cut = slots if rows <= sample_rows else int(slots * sample_rows / rows * 0.98)
    picked = items.filter(F.pmod("h1", F.lit(slots)) < cut).select("vec", "h1").limit(sample_rows).toPandas().sort_values(["h1", "vec"])
    tree, _ = fit(unit(_matrix(picked["vec"])), rows / bucket_rows, most=sample_rows)
    return Index(items, ids, tree, rows, scratch)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of paired int8 rows in double precision."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def _candidates(s: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the similarities that may be among the k greatest of their row and reach the floor."""
    if floor > -1:
        return np.nonzero(s >= floor - 1e-4)
    n = min(k + 1, s.shape[1])  # one may be the row itself
    c = np.argpartition(-s, n - 1, axis=1)[:, :n]
    return np.repeat(np.arange(len(c)), n), c.ravel()


def _best(qid: np.ndarray, xid: np.ndarray, cosine: np.ndarray, k: int, floor: float) -> pd.DataFrame:
    """The k greatest cosines (at least ``floor``) of each query, another row each time, every row once."""
    ok = (cosine >= floor) & (qid != xid)
    found = pd.DataFrame({"vid": qid[ok], "nid": xid[ok], "cosine": cosine[ok]})
    found = found.drop_duplicates(["vid", "nid"]).sort_values(["vid", "cosine", "nid"], ascending=[True, False, True])
    return found[found.groupby("vid").cumcount() < k]


def scan(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, floor: float, size: int = 1024) -> pd.DataFrame:
    """``vid, nid, cosine`` of int8 queries against int8 rows, all compared."""
    uq, ux, out = unit(q), unit(x).T, []
    for a in range(0, len(q) if len(x) else 0, size):
        r, c = _candidates(uq[a : a + size] @ ux, k, floor)
        out.append(_best(qid[a + r], xid[c], _exact(q[a + r], x[c]), k, floor))
    return pd.concat(out) if out else _best(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), k, floor)


def search_bucket(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, floor: float, recall: float, sample: int = 384, leaf_rows: int = LEAF_ROWS) -> pd.DataFrame:
    """:func:`scan` by the tree of the bucket, of as many leaves a query as bring ``recall`` on ``sample`` of its queries.

    The width is one step above the first that does, as the queries are a sample.
    """
    ux, uq = unit(x), unit(q)
    tree, home = fit(ux, max(len(x) / leaf_rows, 1), rounds=3, most=2048)
    if not len(q) or not len(x):
        return scan(q[:0], qid[:0], x, xid, k, floor)
    rng = np.random.default_rng(11)
    tried = np.arange(len(q)) if len(q) <= sample else rng.choice(len(q), sample, replace=False)
    true = scan(q[tried], qid[tried], x, xid, k, floor)
    width = 2
    if len(true):
        row = {v: i for i, v in enumerate(qid[tried])}
        where = dict(zip(xid, home))
        row, leaf = np.array([row[v] for v in true["vid"]]), np.array([where[v] for v in true["nid"]])
        seen, reached = tree.visit(uq[tried], min(16, tree.leaves)), False
        for width in (*(w for w in WIDTHS if 1 < w < tree.leaves), tree.leaves):
            if reached:
                break
            if width > seen.shape[1]:
                seen = tree.visit(uq[tried], min(4 * width, tree.leaves))
            reached = (seen[row, :width] == leaf[:, None]).any(1).mean() >= recall
    visited = tree.visit(uq, min(width, tree.leaves))
    # rows by leaf, and the queries that visit it
    by = np.argsort(home, kind="stable")
    ends = np.searchsorted(home[by], np.arange(tree.leaves + 1))
    flat = visited.ravel()
    who = np.argsort(flat, kind="stable")
    begins = np.searchsorted(flat[who], np.arange(tree.leaves + 1))
    who = who // visited.shape[1]
    rs, cs, vs = [], [], []
    kth = np.full(len(q), floor - 1e-4 if floor > -1 else -np.inf, np.float32)  # what a row must reach to be among the k of a query, so far
    best = np.full((len(q), k + 1 if floor <= -1 else 0), -np.inf, np.float32)  # one may be the query itself
    for leaf in range(tree.leaves):
        own, asks = by[ends[leaf] : ends[leaf + 1]], who[begins[leaf] : begins[leaf + 1]]
        for a in range(0, len(asks) if len(own) else 0, 4096):
            part = asks[a : a + 4096]
            s = uq[part] @ ux[own].T
            if best.shape[1]:
                n = min(k + 1, s.shape[1])
                near = np.hstack([best[part], np.partition(s, s.shape[1] - n, axis=1)[:, -n:]])
                best[part] = np.partition(near, near.shape[1] - k - 1, axis=1)[:, -k - 1 :]
                kth[part] = best[part].min(1) - 1e-4
            r, c = np.nonzero(s >= kth[part][:, None])
            rs.append(part[r])
            cs.append(own[c])
            vs.append(s[r, c])
    r, c, v = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((rs, int), (cs, int), (vs, np.float32)))
    last = v >= kth[r]
    r, c = r[last], c[last]
    return _best(qid[r], xid[c], _exact(q[r], x[c]), k, floor)


def _searched(records: DataFrame, groups: list[str], compare) -> DataFrame:
    """``vid, nid, cosine`` of groups of ``vid, vec, is_row, is_query`` rows; a pair may come from several groups."""

    def one(table: pa.Table) -> pa.Table:
        raw, vid = _arrow_matrix(table.column("vec")), table.column("vid").to_numpy()
        asks, rows = (np.asarray(table.column(c).to_numpy(), bool) for c in ("is_query", "is_row"))
        return pa.Table.from_pandas(compare(raw[asks], vid[asks], raw[rows], vid[rows]), FOUND, preserve_index=False)

    return records.groupBy(*groups).applyInArrow(one, "vid long, nid long, cosine double")


FOUND = pa.schema([("vid", pa.int64()), ("nid", pa.int64()), ("cosine", pa.float64())])


def _top(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("vid", "nid").agg(F.max("cosine").alias("cosine"))
    w = Window.partitionBy("vid").orderBy(F.desc("cosine"), "nid")
    return once.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def brute_force(index: Index, queries: pd.DataFrame, k: int, floor: float) -> pd.DataFrame:
    """Exact ``vid, nid, cosine, vec`` (of the neighbour) for a bounded set of query rows against all rows, in blocks."""
    asked = {m: (_matrix(own["vec"]), own["vid"].to_numpy()) for m, own in queries.groupby("model")}

    def run(batches):
        kept = None
        for batch in batches:
            raw, vid, model = _arrow_matrix(batch.column("vec")), batch.column("vid").to_numpy(), batch.column("model")
            for m, own in asked.items():
                at = np.asarray(pc.equal(model, m).to_numpy(zero_copy_only=False), bool)
                found = scan(*own, raw[at], vid[at], k, floor)
                found["vec"] = [x.tobytes() for x in raw[pd.Series(np.arange(len(vid)), index=vid)[found["nid"]].to_numpy()]]
                kept = found if kept is None else pd.concat([kept, found])
                if len(kept) > 8 * k * len(queries):
                    kept = kept.sort_values(["cosine", "nid"], ascending=[False, True]).groupby("vid").head(k)
        if kept is not None and len(kept):
            best = kept.sort_values(["cosine", "nid"], ascending=[False, True]).groupby("vid").head(k)[["vid", "nid", "cosine", "vec"]]
            yield pa.RecordBatch.from_pandas(best, FOUND.append(pa.field("vec", pa.binary())), preserve_index=False)

    part = index.items.select("vid", "model", "vec").mapInArrow(run, "vid long, nid long, cosine double, vec binary")
    w = Window.partitionBy("vid").orderBy(F.desc("cosine"), "nid")
    return part.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r").toPandas()


def calibrate(index: Index, k: int, floor: float, recall: float, queries: int = 1024, mutual: bool = False) -> tuple[int, float]:
    """(visits, recall of the buckets on the calibration queries): one width above the least that brings ``recall``.

    ``mutual``: a pair counts if either side visits the other's bucket.
    """
    buckets = index.tree.leaves
    if buckets == 1:
        return 1, 1.0
    share = min(1.0, queries / max(index.rows, 1))
    sample = index.items.filter(F.pmod(F.col("h2"), F.lit(1 << 24)) < int((1 << 24) * share)).select("vid", "model", "vec").limit(2 * queries).toPandas()
    true = brute_force(index, sample, k, floor)
    if not len(true):
        return buckets, 1.0
    row = pd.Series(np.arange(len(sample)), index=sample["vid"])[true["vid"]].to_numpy()
    asked = index.tree.visit(unit(_matrix(sample["vec"])), buckets)[row]
    near = index.tree.visit(unit(_matrix(true["vec"])), buckets if mutual else 1)
    reached = False
    for width in (*(w for w in WIDTHS if w < buckets), buckets):
        met = (asked[:, :width] == near[:, :1]).any(1)
        if mutual:
            met |= (near[:, :width] == asked[:, :1]).any(1)
        if reached:
            break
        reached = met.mean() >= recall
    return width, float(met.mean())


def search(index: Index, asked: DataFrame | None, k: int, floor: float, visits: int, recall: float = 0.99) -> DataFrame:
    """``vid, nid, cosine``: up to k neighbours among distinct vectors for the items in ``asked`` (``vid``; None: all)."""
    tree = index.tree

    def place(batches):
        for batch in batches:
            near = tree.visit(unit(_arrow_matrix(batch.column("vec"))), visits)
            n = near.shape[1]
            first = np.tile(np.arange(n), len(near)) == 0
            asks = np.repeat(np.asarray(batch.column("asked").to_numpy(zero_copy_only=False), bool), n)
            keep = (near.ravel() >= 0) & (asks | first)
            at = pa.array(np.repeat(np.arange(len(near)), n)[keep])
            yield pa.RecordBatch.from_arrays(
                [pa.array(near.ravel()[keep]), *[batch.column(c).take(at) for c in ("model", "vid", "vec")], pa.array(first[keep]), pa.array(asks[keep])],
                names=["bucket", "model", "vid", "vec", "is_row", "is_query"],
            )

    if asked is None:
        items = index.items.select("vid", "model", "vec", F.lit(True).alias("asked"))
    else:
        items = index.items.select("vid", "model", "vec").join(asked.select("vid", F.lit(True).alias("asked")).distinct(), "vid", "left").fillna({"asked": False})
    records = items.mapInArrow(place, "bucket int, model string, vid long, vec binary, is_row boolean, is_query boolean")
    found = _searched(records, ["model", "bucket"], lambda q, qid, x, xid: search_bucket(q, qid, x, xid, k, floor, recall))
    if asked is None:
        pair = F.struct("vid", "nid", "cosine")
        both = F.array(pair, F.struct(F.col("nid").alias("vid"), F.col("vid").alias("nid"), "cosine"))
        found = found.select(F.explode(both).alias("p")).select("p.*")
    return _top(found, k)


def exact(index: Index, asked: DataFrame, k: int, floor: float, block: int = 20_000, part_rows: int = 50_000) -> DataFrame:
    """:func:`search` by comparing the items in ``asked`` with all rows, in blocks of queries and parts of rows."""
    own = asked.select("vid", F.lit(True).alias("asked")).distinct()
    blocks, parts = max(1, -(-own.count() // block)), max(1, -(-index.rows // part_rows))
    items = index.items.select("vid", "model", "vec").join(own, "vid", "left")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    hashed = lambda n, seed: F.pmod(F.xxhash64("vid", F.lit(seed)), F.lit(n)).cast("int")
    rows = items.select("model", "vid", "vec", F.lit(True).alias("is_row"), F.lit(False).alias("is_query"), hashed(parts, 1).alias("part"), every(blocks).alias("block"))
    queries = items.filter("asked").select("model", "vid", "vec", F.lit(False).alias("is_row"), F.lit(True).alias("is_query"), every(parts).alias("part"), hashed(blocks, 2).alias("block"))
    return _top(_searched(rows.unionByName(queries), ["model", "part", "block"], lambda q, qid, x, xid: scan(q, qid, x, xid, k, floor)), k)


def expand(index: Index, near: DataFrame, k: int, floor: float, keep: Column | None = None) -> DataFrame:
    """``id, other, cosine``: the up to k most similar ids of every id (that ``keep`` allows) whose vector is in ``near`` or has copies.

    Copies have cosine 1; ties go to the smaller id. Only the k + 1 smallest ids of a group of
    copies can be anyone's neighbour, so a group is never expanded into all its pairs.
    """
    low = index.items.select("vid", "ids")
    others = near.join(low.withColumnRenamed("vid", "nid"), "nid").select("vid", "cosine", F.explode("ids").alias("other"))
    own = low.filter(F.size("ids") > 1).select("vid", F.lit(1.0).alias("cosine"), F.explode("ids").alias("other"))
    ranked = others.unionByName(own).filter(F.col("cosine") >= floor)
    lists = ranked.groupBy("vid").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "other"))).alias("near")
    )
    best = F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k)
    few = index.items.select("vid", F.explode("ids").alias("id"))
    # groups with more ids than are kept with the vector
    large = index.scratch.put(index.items.filter("last < b").select("vid", "h1", "h2", "last"))
    more = index.ids.join(large, ["h1", "h2"]).filter("id > last").select("vid", "id")
    members = few.unionByName(more)
    members = members.filter(keep) if keep is not None else members
    return members.join(lists, "vid").select("id", F.explode(best).alias("x")).select(
        "id", F.col("x.other").alias("other"), (-F.col("x.far")).alias("cosine")
    )


FLOOR, ASKED = 0.90, "id % 100 = 0"


def _near_found(index: Index) -> DataFrame:
    visits, _ = calibrate(index, 5, FLOOR, recall=0.99, mutual=True)
    return search(index, None, 5, FLOOR, visits, recall=0.96)  # of each side; a pair has two


def _asked(index: Index) -> DataFrame:
    return index.ids.filter(ASKED).join(index.items.select("h1", "h2", "vid"), ["h1", "h2"]).select("vid").distinct()


def _near_asked(index: Index, asked: DataFrame) -> DataFrame:
    visits, _ = calibrate(index, 5, -1.0, recall=0.97, queries=512)
    return search(index, asked, 5, -1.0, visits, recall=0.97)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks with a cosine of at least 0.90, one among the five most similar of the other."""
    index = build(usable(read(spark, sf_dir, "vectors")))
    return expand(index, _near_found(index), 5, FLOOR).select(
        F.least("id", "other").alias("chunk_id_a"), F.greatest("id", "other").alias("chunk_id_b")
    ).filter("chunk_id_a < chunk_id_b").distinct()


def p3_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar chunks of every chunk whose id is divisible by 100, whatever the cosine."""
    index = build(usable(read(spark, sf_dir, "vectors")))
    near = _near_asked(index, _asked(index))
    return expand(index, near, 5, -1.0, F.expr(ASKED)).select(
        F.col("id").alias("chunk_id"), F.col("other").alias("neighbour_id"), F.round("cosine", 6).alias("cosine")
    )


def recalls(index: Index) -> DataFrame:
    """``search, true_pairs, found_pairs, recall`` of both searches against the exact neighbours of the chunks whose id is divisible by 100."""
    asked = index.scratch.put(_asked(index))
    out = None
    for name, near, floor in (("found", _near_found(index), FLOOR), ("knn", _near_asked(index, asked), -1.0)):
        true = exact(index, asked, 5, floor).select("vid", "nid")
        both = true.join(near.select("vid", "nid", F.lit(1).alias("hit")), ["vid", "nid"], "left")
        part = both.agg(F.count(F.lit(1)).alias("true_pairs"), F.count("hit").alias("found_pairs")).select(F.lit(name).alias("search"), "*")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("recall", F.when(F.col("true_pairs") > 0, F.col("found_pairs") / F.col("true_pairs")).otherwise(1.0))


def p3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of ``p3_found`` and ``p3_knn``, measured; below 0.9 it raises."""
    out = recalls(build(usable(read(spark, sf_dir, "vectors"))))
    return out.withColumn("recall", F.when(F.col("recall") >= 0.9, F.col("recall")).otherwise(F.raise_error(F.concat(F.lit("recall of "), "search", F.lit(" is "), F.col("recall").cast("string"))).cast("double")))


_BYTES = "list_transform(range(64), lambda i: (CASE WHEN h[2*i+1] >= '8' THEN -256 ELSE 0 END + ('0x' || h[2*i+1:2*i+2])::INT)::DOUBLE)"
_VECTORS = f"""WITH v AS (SELECT DISTINCT chunk_id, model, hex(vec) AS h FROM vectors WHERE dim = 64 AND octet_length(vec) = 64 AND chunk_id IS NOT NULL AND model IS NOT NULL),
u AS (SELECT chunk_id, model, {_BYTES} AS x FROM v),
w AS (SELECT *, sqrt(list_dot_product(x, x)) AS n FROM u WHERE list_dot_product(x, x) > 0)"""
P3_SQL = f"""{_VECTORS},
p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, max(list_dot_product(a.x, b.x) / (a.n * b.n)) AS c FROM w a JOIN w b ON a.model = b.model AND a.chunk_id <> b.chunk_id
  WHERE list_dot_product(a.x, b.x) >= 0.8999999 * a.n * b.n GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 12) DESC, b) AS k FROM p WHERE round(c, 12) >= 0.9)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM r WHERE k <= 5"""
P3_KNN_SQL = f"""{_VECTORS},
p AS (SELECT a.model, a.chunk_id AS a, b.chunk_id AS b, max(list_dot_product(a.x, b.x) / (a.n * b.n)) AS c FROM w a JOIN w b ON a.model = b.model AND a.chunk_id <> b.chunk_id WHERE a.chunk_id % 100 = 0 GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY model, a ORDER BY round(c, 12) DESC, b) AS k FROM p)
SELECT a AS chunk_id, b AS neighbour_id, round(c, 6) AS cosine FROM r WHERE k <= 5"""
