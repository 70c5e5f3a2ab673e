"""Removal of repeated passages: windows of words counted exactly by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Its minimiser is the least hash among its ``anchor``-word
runs; equal windows have equal minimisers. Consecutive windows with one minimiser travel together, packed in one
string, to the minimiser's bucket; there the distinct strings' windows are sorted, and of equal windows the first
occurrence (document, then start) is the one that stays. Nothing is decided by hashes: they only choose buckets.

Passes over the texts (joined by document id, in one plan, so the exchange of the texts is shared):

1. the hashes of all minimisers are counted, twice where they stand in a document more than once, and joined back to
   their documents; those seen once in the corpus cannot belong to a repeated window, and their windows are not sent
   anywhere. A frequent minimiser is combined before the shuffle, and its join can be split;
2. documents send the packed strings of the other windows. Equal strings are reduced to their first occurrence before
   and after the shuffle, so copies do not pile up in a bucket. Where a minimiser occurs in more than ``hot`` documents
   each of its windows is a string of its own, in the bucket of the whole window's hash: a frequent line in many
   contexts is dealt over many buckets;
3. the windows that are first occurrences return to their documents; all others sent in pass 2 are repeats.

Exact copies of a whole text are found by digest beforehand, and need no strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .textcore import chunks, gram_hashes, signed, word_hashes, words

#: A run of windows longer than this is cut, so that no string grows with a repetitive document.
LONGEST_RUN = 64


def _sliding(x: np.ndarray, w: int, least: np.ufunc = np.minimum) -> np.ndarray:
    if len(x) < w:
        return np.empty(0, x.dtype)
    out, have = x, 1
    while have * 2 <= w:
        out = least(out[:-have], out[have:])
        have *= 2
    return least(out[: len(x) - w + 1], out[w - have :]) if have < w else out


class Layout:
    """Words, minimiser and runs of the windows of a chunk of texts."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, window: int, anchor: int):
        self.starts, self.ends, self.first = words(buf, offsets)
        self.hashes = word_hashes(buf, self.starts, self.ends)
        grams, width = gram_hashes(self.hashes, anchor), window - anchor + 1
        least = _sliding(grams, width)
        counts = np.diff(self.first)
        text = np.repeat(np.arange(len(counts)), counts)
        whole = text[: len(least)] == text[window - 1 :] if len(least) else np.empty(0, bool)
        self.at = np.flatnonzero(whole)  # windows by their first word
        self.minimiser, self.text = least[self.at], text[self.at]
        # Anchors: the runs of words that are the minimiser of some window over them.
        padded = np.zeros(len(grams) + width - 1, np.uint64)
        padded[width - 1 : width - 1 + len(least)] = np.where(whole, least, np.uint64(0))
        chosen = np.flatnonzero(_sliding(padded, width, np.maximum) == grams) if len(least) else np.empty(0, int)
        self.anchor, self.anchor_text = grams[chosen], text[chosen]
        new = np.ones(len(self.at), bool)
        new[1:] = (self.minimiser[1:] != self.minimiser[:-1]) | (self.text[1:] != self.text[:-1])
        begin = np.flatnonzero(new)
        within = np.arange(len(self.at)) - np.repeat(begin, np.diff(np.append(begin, len(self.at))))
        new |= within % LONGEST_RUN == 0
        self.run = np.flatnonzero(new)  # a run's first window, as an index of self.at
        self.run_end = np.append(self.run[1:], len(self.at))
        self.run_text = self.text[self.run]


def _anchors(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, buf, offsets in chunks(batch.column(1)):
                lay = Layout(buf, offsets, window, anchor)
                text, value = lay.anchor_text, lay.anchor
                order = np.lexsort((value, text))
                text, value = text[order], value[order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
                at = np.flatnonzero(new)
                several = np.diff(np.append(at, len(text))) > 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first + text[at]]), pa.array(signed(value[at])), pa.array(several)], ["key", "anchor", "several"]
                )

    return run


def _flagged(lay: Layout, text: int, hot: list | None, shared: list | None) -> tuple[np.ndarray, np.ndarray]:
    """The text's runs whose minimiser occurs elsewhere too, and of these which are hot."""
    low, high = np.searchsorted(lay.run_text, [text, text + 1])
    mine = signed(lay.minimiser[lay.run[low:high]])
    is_hot = np.isin(mine, np.array(hot or [], np.int64))
    sent = is_hot | np.isin(mine, np.array(shared or [], np.int64))
    return low + np.flatnonzero(sent), is_hot[sent]


def _pieces(window: int, anchor: int):
    """Packed strings of the shared windows: bucket, string, document, first word's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            ids, size = batch.column(0), 0
            for first, last, buf, offsets in chunks(batch.column(1)):
                lay, raw = Layout(buf, offsets, window, anchor), buf.tobytes()
                whole = gram_hashes(lay.hashes, window) if any(x.as_py() for x in batch.column(3)[first:last]) else None
                for k in range(first, last):
                    doc, shared, hot = ids[k].as_py(), batch.column(2)[k].as_py(), batch.column(3)[k].as_py()
                    if not shared and not hot:
                        continue
                    seen, base = set(), lay.first[k - first]
                    for r, is_hot in zip(*_flagged(lay, k - first, hot, shared), strict=True):
                        a, b = lay.at[lay.run[r]], lay.at[lay.run_end[r] - 1]
                        spans = [(i, i) for i in range(a, b + 1)] if is_hot else [(a, b)]
                        for x, y in spans:
                            piece = b" ".join(raw[lay.starts[x] : lay.ends[y + window - 1]].split())
                            if piece in seen:  # the document's own earlier occurrence stands for it
                                continue
                            seen.add(piece)
                            key = whole[x] if is_hot else lay.minimiser[lay.run[r]]
                            for o, v in zip(out, (int(key.view(np.int64)), piece, doc, int(x - base)), strict=True):
                                o.append(v)
                            size += len(piece)
                    if size > 4_000_000:
                        yield _packed(out)
                        out, size = ([], [], [], []), 0
            yield _packed(out)

    def _packed(out):
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], ["bucket", "piece", "key", "at"])

    return run


def _winners(window: int):
    """Of the sorted windows of each key the first occurrences, as runs: document, first window, number of windows."""

    def settle(group: list[tuple[bytes, int, int]]) -> Iterator[tuple[int, int, int]]:
        occurrences = []
        for piece, doc, at in group:
            ends, pos = [], -1
            while (pos := piece.find(b" ", pos + 1)) >= 0:
                ends.append(pos)
            ends.append(len(piece))
            begins = [0, *(e + 1 for e in ends[:-1])]
            occurrences += [(piece[begins[i] : ends[i + window - 1]], doc, at + i) for i in range(len(ends) - window + 1)]
        occurrences.sort()
        last, won = None, []
        for content, doc, at in occurrences:
            if content != last:
                won.append((doc, at))
                last = content
        won.sort()
        doc = at = n = None
        for d, a in won:
            if d == doc and a <= at + n:
                n = max(n, a - at + 1)
            else:
                if n:
                    yield doc, at, n
                doc, at, n = d, a, 1
        if n:
            yield doc, at, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for k, *row in zip(*columns, strict=True):
                if k != key:
                    out += settle(group)
                    key, group = k, []
                group.append(tuple(row))
            if len(out) > 50_000:
                yield _packed(out)
                out = []
        out += settle(group)
        yield _packed(out)

    def _packed(out):
        d, a, n = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(a, pa.int32()), pa.array(n, pa.int32())], ["key", "at", "n"])

    return run


def _apply(window: int, anchor: int):
    """What is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, texts = [], [], []
            for first, last, buf, offsets in chunks(batch.column(1)):
                lay, raw = Layout(buf, offsets, window, anchor), buf.tobytes()
                for k in range(first, last):
                    t = k - first
                    a, b = lay.first[t], lay.first[t + 1]
                    own = raw[offsets[t] : offsets[t + 1]].split()
                    shared, hot, copy, kept = (batch.column(c)[k].as_py() for c in (2, 3, 4, 5))
                    gone = np.zeros(b - a, bool)
                    if copy and b - a >= window:
                        gone[:] = True
                    elif shared or hot:
                        repeats = np.zeros(b - a + 1, bool)
                        for r in _flagged(lay, t, hot, shared)[0]:
                            repeats[lay.at[lay.run[r]] - a : lay.at[lay.run_end[r] - 1] - a + 1] = True
                        for x in kept or ():
                            repeats[x["at"] : x["at"] + x["n"]] = False
                        at = np.flatnonzero(repeats)
                        cover = np.zeros(b - a + 1, np.int32)
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + window, -1)
                        gone = np.cumsum(cover)[:-1] > 0
                    n_words.append(b - a)
                    n_removed.append(int(gone.sum()))
                    texts.append(b" ".join(own) if not gone.any() else b" ".join(w for w, g in zip(own, gone.tolist(), strict=True) if not g))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return run


def _keys(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``texts`` with key, digests): key orders the documents, null where the id is; digests have digest and key.

    Where no id stands over different texts the key is the id; else it numbers the distinct (id, digest) in order.
    """
    digest = F.sha2("text", 256)
    ids = materialise(texts.where("doc_id IS NOT NULL").select("doc_id", digest.alias("digest")), "digests")
    if ids.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").isEmpty():
        return texts.withColumn("key", F.col("doc_id")), ids.withColumnRenamed("doc_id", "key")
    # Sorted by ranges and written once, so that the numbers ascend over all partitions and never change.
    numbered = materialise(ids.distinct().orderBy("doc_id", "digest").withColumn("key", F.monotonically_increasing_id()), "keys")
    keyed = texts.withColumn("digest", digest).join(numbered, ["doc_id", "digest"], "left").select("doc_id", "text", "key")
    return keyed, numbered.select("digest", "key")


def remove_repeats(docs: DataFrame, window: int = 20, anchor: int = 8, hot: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the words that stay, joined by one space) per row of ``docs``.

    A word goes if a window over it has the same words as a window that starts earlier: in a document with a smaller
    id, or before it in the same document. Null and empty texts have no words; a text shorter than a window loses
    nothing. A row with a null id is neither earlier nor later than any other and loses nothing. Equal rows are one
    document: what stands in both is no repeat. Rows with one id and different texts are documents of their own, the
    text with the lesser SHA-256 first. Other columns are ignored; empty tables give no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts, digests = _keys(texts)
    originals = digests.groupBy("digest").agg(F.min("key").alias("key")).select("key").withColumn("original", F.lit(True))
    anchors = texts.where("key IS NOT NULL").select("key", "text").mapInArrow(_anchors(window, anchor), "key long, anchor long, several boolean")
    # Counted apart and joined: counts are combined before the shuffle, and the join of a frequent anchor can be split.
    counts = anchors.groupBy("anchor").agg(F.sum(F.when(F.col("several"), 2).otherwise(1)).alias("c")).where("c > 1")
    lists = anchors.select("key", "anchor").join(counts, "anchor").groupBy("key").agg(
        F.collect_list(F.when(F.col("c") <= hot, F.col("anchor"))).alias("shared"), F.collect_list(F.when(F.col("c") > hot, F.col("anchor"))).alias("hot")
    )
    marked = texts.join(lists, "key", "left").join(originals, "key", "left")
    marked = marked.select("key", "doc_id", "text", "shared", "hot", (F.col("original").isNull() & F.col("key").isNotNull()).alias("copy"))
    # A filter here would be pushed below the join, and a missing column would be pruned there: either makes another
    # exchange of the texts. So all rows stay, without text, and all columns.
    wanted = F.coalesce(~F.col("copy") & ((F.size("shared") > 0) | (F.size("hot") > 0)), F.lit(False))
    sent = marked.select("key", F.when(wanted, F.col("text")).alias("text"), F.when(wanted, F.col("shared")).alias("shared"), F.when(wanted, F.col("hot")).alias("hot"), "doc_id")
    pieces = sent.mapInArrow(_pieces(window, anchor), "bucket long, piece binary, key long, at int")
    distinct = pieces.groupBy("bucket", "piece").agg(F.min_by("at", "key").alias("at"), F.min("key").alias("key"))
    sorted_ = distinct.select("bucket", "piece", "key", "at").repartition("bucket").sortWithinPartitions("bucket")
    kept = sorted_.mapInArrow(_winners(window), "key long, at int, n int")
    kept = kept.groupBy("key").agg(F.collect_list(F.struct("at", "n")).alias("kept"))
    final = marked.join(kept, "key", "left").select("doc_id", "text", "shared", "hot", "copy", "kept")
    return final.mapInArrow(_apply(window, anchor), "doc_id long, n_words long, n_removed long, kept_text string")
