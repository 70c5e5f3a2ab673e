"""Word-piece lengths by one pass of an automaton per word (linear-time longest match).

The vocabulary is a trie. Every node has a failure link: where the match goes on after the pieces that are certain by
then have been popped; the number of those pieces is stored with the link. A word's length in pieces is the sum of the
popped counts on its way, so no piece is built and no character is read twice.
"""

from __future__ import annotations

import json
import uuid
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words whose counts a worker remembers.
REMEMBERED = 200_000


class Pieces:
    """Greedy longest-match piece counts of byte strings under a vocabulary of byte strings.

    ``inner`` (default: the same) are the pieces allowed after a word's first piece.
    """

    def __init__(self, vocabulary: Iterable[bytes], inner: Iterable[bytes] | None = None):
        self.next: list[dict[int, int]] = [{}]
        self.piece = [False]
        self.start = self._add(vocabulary, 0)
        self.inner = 0
        if inner is not None:
            self.next.append({})
            self.piece.append(False)
            self.inner = self._add(inner, len(self.next) - 1)
        self.link = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        # A node that is a piece pops it and goes on at the inner root. Any other pops what its parent's links pop
        # until one of them has the character.
        queue = deque((root, c, v) for root in {self.start, self.inner} for c, v in self.next[root].items())
        while queue:
            u, c, v = queue.popleft()
            if self.piece[v]:
                self.link[v], self.popped[v] = self.inner, 1
            else:
                z, n = self.link[u], self.popped[u]
                while z >= 0 and c not in self.next[z]:
                    n += self.popped[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[v], self.popped[v] = self.next[z][c], n
            queue.extend((v, d, w) for d, w in self.next[v].items())

    def _add(self, vocabulary: Iterable[bytes], root: int) -> int:
        for word in vocabulary:
            u = root
            for c in word:
                if c not in self.next[u]:
                    self.next[u][c] = len(self.next)
                    self.next.append({})
                    self.piece.append(False)
                u = self.next[u][c]
            if word:
                self.piece[u] = True
        return root

    def count(self, word: bytes) -> int:
        """The number of pieces; -1 if the word has no such pieces."""
        nodes, link, popped = self.next, self.link, self.popped
        u, n = self.start, 0
        for c in word:
            while c not in nodes[u]:
                n += popped[u]
                u = link[u]
                if u < 0:
                    return -1
            u = nodes[u][c]
        while u != self.inner and u != self.start:
            n += popped[u]
            u = link[u]
            if u < 0:
                return -1
        return n


def byte_level_vocabulary(path: str) -> list[bytes]:
    """Pieces of a byte-level tokenizer file, as bytes: its characters stand for bytes, by the rule of such files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    return [bytes(byte_of[c] for c in piece) for piece in model["vocab"] if all(c in byte_of for c in piece)]


#: The automaton that this worker process has built last, by the name of its call.
_built: dict[str, Pieces] = {}


def _counts(shared, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:
            _built.clear()
            _built[name] = Pieces(shared.value)
        pieces = _built[name]

        class Known(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= REMEMBERED:
                    self.clear()
                self[word] = n = pieces.count(b" " + word)
                return n

        known = Known()
        for batch in batches:
            n_words, n_tokens, unknown = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                words = text.as_py().split()
                each = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                bad = each < 0
                n_words.append(len(words))
                n_tokens.append(int(each[~bad].sum()) + int(bad.sum()))
                unknown.append(int(bad.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, unknown))], ["doc_id", "n_words", "n_tokens", "n_unknown"]
            )

    return run


def count_tokens(docs: DataFrame, vocabulary_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown per row of ``docs``.

    Words are parted by white space, and each is matched with a space before it, as the vocabulary's words begin with
    one. A word that the vocabulary cannot make counts as one token and one unknown. Null and empty texts count 0;
    repeated rows count each for itself. The vocabulary, of a size fixed by its file, is read on the driver and
    broadcast. Other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(byte_level_vocabulary(vocabulary_file))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(_counts(shared, uuid.uuid4().hex), "doc_id long, n_words long, n_tokens long, n_unknown long")
