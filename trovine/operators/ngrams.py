"""TF-IDF vectors of word and character n-grams, counted in Arrow.

The character n-grams of a word are numbered once for some hundred texts, and added up by number; no n-gram of a text becomes
a row. Only sums of distinct n-grams are shuffled, to choose the vocabularies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import spaced_words, tokens

#: Character n-grams have LOW to HIGH characters, word n-grams one or two words.
LOW, HIGH = 3, 5
#: Characters of the texts whose n-grams are counted at once.
CHARS = 2_000_000
WORD, CHAR = 0, 1


def words_of(c: str) -> list[Column]:
    return [tokens(c).alias("_w"), spaced_words(c).alias("_c")]


def _slices(batch: pa.RecordBatch, *lists: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``CHARS`` characters in both columns of words, one row at least."""
    weight = np.zeros(len(batch), np.int64)
    for name in lists:
        column = batch.column(name)
        row = np.repeat(np.arange(len(batch)), column.value_lengths().to_numpy(zero_copy_only=False))
        size = pc.utf8_length(column.flatten()).to_numpy(zero_copy_only=False)
        weight += np.bincount(row, size + 2, len(batch)).astype(np.int64)
    part = np.cumsum(weight) // (2 * CHARS)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _coded(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and code of each word, and the distinct words."""
    row = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
    coded = column.flatten().dictionary_encode()
    return row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _words_and_pairs(column: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words and pairs of neighbours, and (row, place among these) of each that stands in a text."""
    row, code, words = _coded(column)
    first, n = np.flatnonzero(row[1:] == row[:-1]), max(len(words), 1)
    pairs, pair = np.unique(code[first] * n + code[first + 1], return_inverse=True)
    both = pc.binary_join_element_wise(words.take(pa.array(pairs // n)), words.take(pa.array(pairs % n)), " ")
    return pa.concat_arrays([words, both]), np.concatenate([row, row[first]]), np.concatenate([code, len(words) + pair])


def _chars(column: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct character n-grams of words with a space on both sides, and (row, place among these) of each."""
    row, code, words = _coded(column)
    body = "".join(f" {w} " for w in words.to_pylist())
    points = np.frombuffer(body.encode("utf-32-le"), np.uint32).astype(np.int64)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    end = np.repeat(np.cumsum(size), size)
    names, owner, gram = [], [], []
    # An n-gram is the number of its first n - 1 characters and the last one: exact in 64 bits.
    at, key = np.arange(len(points)), points
    for n in range(2, HIGH + 1):
        own = at + n <= end[at]
        at = at[own]
        distinct, first, key = np.unique(key[own] << 21 | points[at + n - 1], return_index=True, return_inverse=True)
        if n >= LOW:
            gram.append(key + sum(map(len, names)))
            owner.append(at)
            names.append([body[i : i + n] for i in at[first].tolist()])
    word = np.repeat(np.arange(len(words)), size)[np.concatenate(owner)]
    order = np.argsort(word, kind="stable")
    flat, size = np.concatenate(gram)[order], np.bincount(word, minlength=len(words))
    start, count = np.cumsum(size) - size, size[code]
    place = np.repeat(start[code] - np.cumsum(count) + count, count) + np.arange(count.sum())
    return pa.array([x for part in names for x in part], pa.string()), np.repeat(row, count), flat[place]


GRAMS = {"_w": _words_and_pairs, "_c": _chars}


def _counts(row: np.ndarray, gram: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, how often), sorted."""
    key, n = np.unique(row * max(width, 1) + gram, return_counts=True)
    return key // max(width, 1), key % max(width, 1), n


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, gram, tf, df) of a partition, an n-gram once for each slice."""
    for big in batches:
        for batch in _slices(big, *GRAMS):
            for kind, (name, make) in enumerate(GRAMS.items()):
                names, row, gram = make(batch.column(name))
                _, gram, n = _counts(row, gram, len(names))
                tf, df = np.bincount(gram, n, len(names)).astype(np.int64), np.bincount(gram, minlength=len(names))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), kind, np.int32)), names, pa.array(tf), pa.array(df)], ["kind", "gram", "tf", "df"])


class Weigher:
    """Makes the vectors of a batch's rows, with the vocabularies that were sent out."""

    def __init__(self, found: tuple):
        self.parts = [(pa.array(grams, pa.string()), idf) for grams, idf in found]
        self.width = sum(len(idf) for _, idf in found)

    def slices(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """Slices of the batches with (row, place, value), sorted."""
        for big in batches:
            for batch in _slices(big, *GRAMS):
                parts, before = [], 0
                for (vocabulary, idf), (name, make) in zip(self.parts, GRAMS.items(), strict=True):
                    names, row, gram = make(batch.column(name))
                    gram = pc.fill_null(pc.index_in(names, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)[gram]
                    row, gram, n = _counts(row[gram >= 0], gram[gram >= 0], len(idf))
                    value = (1 + np.log(n)) * idf[gram]
                    norm = np.sqrt(np.bincount(row, value * value, len(batch)))
                    parts.append((row, gram + before, value / np.where(norm > 0, norm, 1)[row]))
                    before += len(idf)
                row, gram, value = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(row, kind="stable")
                yield batch, row[order], gram[order], value[order]


def _vectors(shared: Broadcast, rest: int):
    """The first ``rest`` columns and the vector of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher = Weigher(shared.value)
        for batch, row, gram, value in weigher.slices(batches):
            at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(batch)))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (gram.astype(np.int32), value)]
            plain = [pa.array(np.zeros(len(batch), np.int8)), pa.array(np.full(len(batch), weigher.width, np.int32))]
            vector = pa.StructArray.from_arrays([*plain, *lists], ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:rest], vector], [*batch.schema.names[:rest], "_x"])

    return run


@dataclass
class Vectorizer:
    """The commonest word and character n-grams of texts with their IDF, and the vectors: 1 + ln tf times IDF, of unit length
    for each of the two kinds. N-grams in fewer than ``least`` texts are left out; equally common ones go by their text."""

    sizes: tuple[int, int]
    least: tuple[int, int] = (2, 3)

    def fit(self, texts: DataFrame, c: str, folder: str) -> Vectorizer:
        """``folder``: where the sums are written. The vocabularies, of bounded size, are on the driver."""
        from ..sources.io import stage

        sums = texts.select(*words_of(c)).mapInArrow(_sums, "kind int, gram string, tf long, df long")
        sums = sums.groupBy("kind", "gram").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
        sums = stage(sums.where(F.col("df") >= F.when(F.col("kind") == WORD, self.least[WORD]).otherwise(self.least[CHAR])), f"{folder}/grams")
        n, found = texts.count(), []
        for kind in (WORD, CHAR):
            own = sums.where(F.col("kind") == kind).orderBy(F.desc("tf"), "gram").limit(self.sizes[kind]).select("gram", "df").toArrow()
            found.append((own["gram"].to_pylist(), np.log((n + 1) / (own["df"].to_numpy() + 1))))
        self.width, self.shared = sum(len(g) for g, _ in found), texts.sparkSession.sparkContext.broadcast(tuple(found))
        return self

    def transform(self, texts: DataFrame, c: str) -> DataFrame:
        """``texts`` with the column _x."""
        schema = T.StructType([*texts.schema.fields, T.StructField("_x", VectorUDT())])
        return texts.select("*", *words_of(c)).mapInArrow(_vectors(self.shared, len(texts.columns)), schema)
