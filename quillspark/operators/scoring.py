"""BM25 of many queries over documents in parts, in memory: what frequent terms add up to is found once for all queries that share them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The ranking function's constants, and the share of all documents above which a term counts as frequent; answers don't depend on the latter.
K1, B, LEAST_IDF, FREQUENT = 1.2, 0.75, 1e-6, 0.03
# Documents of a part, rows of a batch of results, and what a match adds at least, so that it isn't mistaken for none.
PART_ROWS, BATCH_ROWS, LEAST_SHARE = 32_768, 100_000, 1e-300


class Asked:
    """Queries as lists of term numbers, grouped by their frequent terms; ``df``: documents of each term out of ``n_all``."""

    def __init__(self, qid: np.ndarray, tid: np.ndarray, df: np.ndarray, n_all: int, avg_len: float):
        self.idf = np.maximum(np.log((n_all - df + 0.5) / (df + 0.5)), LEAST_IDF)
        self.avg_len = avg_len
        frequent, found = df > FREQUENT * n_all, df > 0
        order = np.lexsort((tid, qid))
        qid, tid = qid[order], tid[order]
        groups: dict[tuple, list] = {}
        starts = np.flatnonzero(np.r_[True, qid[1:] != qid[:-1]]) if len(qid) else []
        for q, own in zip(qid[starts].tolist(), np.split(tid, starts[1:])) if len(qid) else ():
            rare = own[~frequent[own] & found[own]].tolist()
            if rare or frequent[own].any():
                groups.setdefault(tuple(own[frequent[own]].tolist()), []).append((q, rare))
        self.groups = list(groups.items())


class Part:
    """Documents with the share of the score that each of their terms gives them, by term."""

    def __init__(self, table: pa.Table, asked: Asked):
        if "page_id" in table.column_names:
            codes = pc.dictionary_encode(table["page_id"].combine_chunks()).indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            table, self.page = table.take(pa.array(order)), codes[order]
            self.starts = np.flatnonzero(np.r_[True, self.page[1:] != self.page[:-1]])
        self.table, self.n = table, len(table)
        self.chunk, size = table["chunk_id"].to_numpy(), table["len"].to_numpy()
        tids, fs = table["tids"].combine_chunks(), table["fs"].combine_chunks()
        doc = np.repeat(np.arange(self.n), pc.list_value_length(tids).to_numpy())
        key, f = tids.flatten().to_numpy().astype(np.int64) * self.n + doc, fs.flatten().to_numpy()
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        f = np.add.reduceat(f[order], first) if len(key) else f
        tid, self.doc = np.divmod(key[first], self.n)
        part = asked.idf[tid] * f * (K1 + 1) / (f + K1 * (1 - B + B * size[self.doc] / asked.avg_len))
        self.share = np.maximum(part, LEAST_SHARE)
        self.at = np.searchsorted(tid, np.arange(len(asked.idf) + 1))

    def of(self, tids) -> tuple[np.ndarray, np.ndarray]:
        """Documents and shares of the terms, one after the other."""
        if not tids:
            return self.doc[:0], self.share[:0]
        cut = [slice(self.at[t], self.at[t + 1]) for t in tids]
        return np.concatenate([self.doc[c] for c in cut]), np.concatenate([self.share[c] for c in cut])

    def summed(self, tids) -> np.ndarray:
        doc, share = self.of(tids)
        return np.bincount(doc, share, minlength=self.n).astype(float)  # of nothing it has integers

    def with_rare(self, base: np.ndarray, tids, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """The documents that have any of the terms, and their whole scores, if these are ``least`` or more; ``base`` is as before afterwards."""
        cut = [slice(self.at[t], self.at[t + 1]) for t in tids]
        doc = np.concatenate([self.doc[c] for c in cut]) if cut else self.doc[:0]
        before = base[doc]
        for c in cut:
            base[self.doc[c]] += self.share[c]  # a term has a document once
        docs = doc[base[doc] >= least - 1e-6]
        docs = np.unique(docs) if len(cut) > 1 else docs
        scores = base[docs].round(6)
        base[doc] = before
        keep = scores >= least
        return docs[keep], scores[keep]

    def best(self, docs: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The best document of each of the ``most`` best pages; ties go to the smaller chunk id."""
        order = np.lexsort((self.chunk[docs], -scores))
        _, first = np.unique(self.page[docs[order]], return_index=True)
        pick = order[np.sort(first)[:most]]
        return docs[pick], scores[pick]

    def best_of_all(self, base: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
        """:meth:`best` of all documents with a score, and the least score a further one needs to be among them."""
        top = np.maximum.reduceat(base, self.starts)
        n = min(most, np.count_nonzero(top))
        if not n:
            return np.zeros(0, np.int64), base[:0], 0.0
        top = top.round(6)
        least = np.partition(top, len(top) - n)[len(top) - n]
        docs = np.flatnonzero((base > 0) & (base >= least - 1e-6))
        return *self.best(docs, base[docs].round(6), most), least if n == most else 0.0


def parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about so many rows. With a ``page_id`` by which the rows are sorted, no page is divided."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if held and (batch is None or sum(map(len, held)) >= rows):
            table, last = pa.Table.from_batches(held), 0
            if batch is not None and "page_id" in table.column_names:
                last = pc.sum(pc.equal(table["page_id"], table["page_id"][-1])).as_py()
            if last < len(table):
                yield table.slice(0, len(table) - last)
                held = table.slice(len(table) - last).to_batches() if last else []
        if batch is not None and len(batch):
            held.append(batch)


def _batches(part: Part, rows, columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Batches of ``qid, columns, score`` from (qid, documents, scores)."""
    held, n = [], 0
    for x in chain(rows, [None]):
        if held and (x is None or n >= BATCH_ROWS):
            docs = np.concatenate([d for _, d, _ in held])
            qid = np.repeat(np.array([q for q, _, _ in held], np.int64), [len(d) for _, d, _ in held])
            own = [pa.array(part.chunk[docs]) if c == "chunk_id" else part.table[c].combine_chunks().take(pa.array(docs)) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(qid), *own, pa.array(np.concatenate([s for _, _, s in held]))], ["qid", *columns, "score"])
            held, n = [], 0
        if x is not None and len(x[1]):
            held.append(x)
            n += len(x[1])


def all_scores(batches: Iterator[pa.RecordBatch], asked: Asked) -> Iterator[pa.RecordBatch]:
    """``qid, chunk_id, score`` of every document that has a term of a query."""

    def rows(part: Part):
        for frequent, queries in asked.groups:
            base = part.summed(frequent)
            docs, rounded = np.flatnonzero(base), base.round(6)
            common = rounded[docs]
            for q, rare in queries:
                more, scores = part.with_rare(base, rare)
                if len(more):
                    whole = rounded.copy()
                    whole[more] = scores
                    own = np.concatenate([docs, more[base[more] == 0]])
                    yield q, own, whole[own]
                else:
                    yield q, docs, common

    for part in (Part(table, asked) for table in parts(batches, PART_ROWS)):
        yield from _batches(part, rows(part), ("chunk_id",))


def best_pages(batches: Iterator[pa.RecordBatch], asked: Asked, most: int) -> Iterator[pa.RecordBatch]:
    """``qid, chunk_id, nth, score``: the ``most`` best pages of each query in each part, each by its best document.

    Shares are never negative, so a page that is among the best of a query either has a document with one of its rare terms, or is
    among the best by the frequent terms alone; the latter are the same for all queries with these.
    """

    def rows(part: Part):
        for frequent, queries in asked.groups:
            base = part.summed(frequent)
            docs, scores, least = part.best_of_all(base, most)
            for q, rare in queries:
                more, whole = part.with_rare(base, rare, least)
                if len(more):
                    yield q, *part.best(np.concatenate([docs, more]), np.concatenate([scores, whole]), most)
                else:
                    yield q, docs, scores

    for part in (Part(table, asked) for table in parts(batches, PART_ROWS)):
        yield from _batches(part, rows(part), ("chunk_id", "nth"))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``chunk_id, w, tids`` (terms that a posting stands for) to ``chunk_id, len, tids, fs``, a row per chunk of each batch."""
    for batch in batches:
        known = pc.is_valid(batch["chunk_id"])
        for own in (batch.filter(known), batch.filter(pc.invert(known))):
            if not len(own):
                continue
            chunk = own["chunk_id"].fill_null(0).to_numpy()
            order = np.argsort(chunk, kind="stable")
            if (np.diff(order) < 0).any():
                own, chunk = own.take(pa.array(order)), chunk[order]
            n = pc.list_value_length(own["tids"]).fill_null(0).to_numpy()
            starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
            ends = pa.array(np.r_[0, np.cumsum(np.add.reduceat(n, starts))].astype(np.int32))
            size = np.diff(np.r_[starts, len(chunk)])
            yield pa.RecordBatch.from_arrays(
                [own["chunk_id"].take(pa.array(starts)), pa.array(size), pa.ListArray.from_arrays(ends, own["tids"].flatten()),
                 pa.ListArray.from_arrays(ends, pa.array(np.repeat(own["w"].to_numpy(), n)))], ["chunk_id", "len", "tids", "fs"],
            )
