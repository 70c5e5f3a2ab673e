"""BM25 of a block of queries against every document, in Arrow.

A document is read once: its counts of the queries' terms are written as short lists. A second pass over these makes the
scores of all pairs with a common term, and hands on all of them, or the first k a query and partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs that are scored at once.
PAIRS = 1_000_000


def count(terms, lists: int) -> Callable:
    """``lists`` leading columns, the number of words, places of the vocabulary ``terms`` that a text has, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(terms.value, pa.string())
        width = max(len(vocabulary), 1)
        for batch in batches:
            size = batch.column(lists).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            place = pc.fill_null(pc.index_in(batch.column(lists).flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(batch)), size)
            key, n = np.unique((row * width + place)[place >= 0], return_counts=True)
            at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(key // width, minlength=len(batch)))]).astype(np.int32))
            made = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (key % width, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:lists], pa.array(size), *made], [*batch.schema.names[:lists], "dl", "place", "tf"])

    return run


def score(shared, positive: bool, digits: int, k: int | None) -> Callable:
    """(query_id, item_id, score, tier) of documents' counts; with ``k``, those that may be among a query's first k by (tier,
    score) of the partition. Columns of a batch: item_id, dl, place, tf, the item's location."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, size, limit = shared.value[0], [], 0, 4 * (k or 0) * len(shared.value[0]) + 200_000
        for rows in pairs(batches):
            if k is None:
                yield named(ids, rows)
                continue
            found.append(rows)
            size += len(rows)
            if size > limit:
                found = [first(pa.Table.from_batches(found), k)]
                size = len(found[0])
                limit = max(limit, 2 * size)
        if found:
            yield named(ids, first(pa.Table.from_batches(found), k))

    def named(ids: pa.Array, rows: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids.take(rows.column(0)), *rows.columns[1:]], ["query_id", *rows.schema.names[1:]])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, start, owners, idf, mean, k1, b, tiers = shared.value
        width, most = max(len(ids), 1), np.diff(start)
        for big in batches:
            places = big.column(2).flatten().to_numpy(zero_copy_only=False)
            sizes = big.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            work = np.bincount(np.repeat(np.arange(len(big)), sizes), most[places], len(big))
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(work) // PAIRS)) + 1).tolist(), len(big)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                batch = big.slice(a, z - a)
                place, tf = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 3))
                row = np.repeat(np.arange(len(batch)), sizes[a:z])
                dl = batch.column(1).to_numpy(zero_copy_only=False)[row]
                w = idf[place] * tf / (tf + k1 * (1 - b + b * dl / mean))
                n = most[place]
                query = owners[np.repeat(start[place] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                key = np.repeat(row, n) * width + query
                cells = len(batch) * width
                if cells <= 8 * max(len(key), 1):
                    total = np.bincount(key, np.repeat(w, n), cells)
                    key = np.flatnonzero(np.bincount(key, minlength=cells))
                    total = total[key]
                else:
                    key, inverse = np.unique(key, return_inverse=True)
                    total = np.bincount(inverse, np.repeat(w, n), len(key))
                total = np.round(total, digits)
                if positive:
                    key, total = key[total > 0], total[total > 0]
                row, query = key // width, key % width
                tier = tiers(query, batch.column(4).to_numpy(zero_copy_only=False)[row]) if tiers is not None else np.zeros(len(key), np.int64)
                made = pa.RecordBatch.from_arrays([pa.array(query), batch.column(0).take(pa.array(row)), pa.array(total), pa.array(tier)], ["query", "item_id", "score", "tier"])
                yield made if k is None else first(pa.Table.from_batches([made]), k)

    return run


def first(table: pa.Table, k: int) -> pa.RecordBatch:
    """The rows that are among the first ``k`` of their query by (tier, score), and those equal to the last of these."""
    query, tier, score = (table[c].to_numpy() for c in ("query", "tier", "score"))
    order = np.lexsort((-score, tier, query))
    q, t, s = query[order], tier[order], score[order]
    last = np.minimum(np.searchsorted(q, q, "left") + k, np.searchsorted(q, q, "right")) - 1
    kept = table.take(pa.array(order[(t < t[last]) | ((t == t[last]) & (s >= s[last]))])).combine_chunks()
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) and c.num_chunks != 1 else c.chunk(0) for c in kept.columns], kept.column_names)


class Tiers:
    """The tier of an item's location for a query."""

    def __init__(self, loc: np.ndarray, asked: np.ndarray, near: np.ndarray, tier: np.ndarray):
        from .dense import _Pool

        places, self.place = np.unique(loc, return_inverse=True)
        self.pool = _Pool(places, near, tier, asked)

    def __call__(self, query: np.ndarray, loc: np.ndarray) -> np.ndarray:
        locs, at = np.unique(loc, return_inverse=True)
        return self.pool.table(locs)[self.place[query], at]
