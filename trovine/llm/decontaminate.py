"""Benchmark passages in documents, found by a CGK embedding and bit-sampling LSH, confirmed by edit distance.

The embedding of Chakraborty, Goldenberg and Koucky walks over a sequence: step j emits the word it stands on and
moves on by a random bit of (j, word). Two sequences at a small edit distance walk in step again soon after an edit, so
their emissions differ in few places (Hamming distance). Sampling a few steps gives a hash under which an item and a
window of its size collide; ``rounds`` independent walks and samples bring the chance of at least one collision to the
target recall. How many that takes is simulated for the sizes at hand. Items of a few words, whose first samples must lie
close together, stand in tables of their own and change nothing for the others; a long item is looked up by its pieces,
one of which has at most the item's share of edits; a single word is looked up as it is.

All windows of all texts are embedded lazily: the steps of a sample are taken in order, and a window is dropped at the
first sampled step whose emission no item has there, which is all that the table lookup would tell. Words outside the
benchmark's vocabulary are one symbol, which changes no distance to an item. The bit of (step, word) is a hash of both,
so a table holds nothing for each step and word. The benchmark is broadcast in parts of a checked size, one part a pass.
"""

from __future__ import annotations

import math
import random
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .textcore import chunks, mix, word_hashes, words

#: Bytes that are no letters or digits part words; bytes beyond ASCII belong to words.
_PARTS = np.array([not (chr(c).isalnum() or c >= 128) for c in range(256)])
#: Steps that every item has, and samples in the first of them.
HEAD, SAMPLES = 6, 4
#: Items in one block of the benchmark.
BLOCK_ITEMS = 20_000
#: Rounds of items that may have edits: at least, and at most. Items simulated for a size.
FEWEST, MOST, TRIALS = 16, 64, 100
#: Words of an item's piece: a longer item is cut into equal pieces.
PIECE = 96


def _fold(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and, in UTF-8, of the Latin-1 letters; blanks for the marks of Latin-1 and of U+2000 to 207F."""
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    latin = np.zeros(len(buf), bool)
    latin[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    out[latin] += 32
    two = np.flatnonzero((buf[:-1] == 0xC2) & (buf[1:] >= 0xA0))
    three = np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] >= 0x80) & (buf[1:-1] <= 0x81))
    for at, size in ((two, 2), (three, 3)):
        for k in range(size):
            out[at + k] = 32
    return out


def normal_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the folded words and the first word's number of each text."""
    buf = _fold(buf)
    starts, ends, first = words(buf, offsets, _PARTS)
    return word_hashes(buf, starts, ends), first


def allowed(n_words: int, percent: int) -> int:
    """Edits of words up to which a window counts as the item."""
    return n_words * percent // 100


def edit_distance(item: list[int], window: list[int]) -> int:
    """The least number of word edits between the item and any part of the window, by Myers' bit vectors."""
    m, peq = len(item), defaultdict(int)
    for k, w in enumerate(item):
        peq[w] |= 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for w in window:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        best = min(best, score)
    return best


def _bit(codes: np.ndarray, factor: np.uint64) -> np.ndarray:
    """The walk's bit of each word in the step whose multiplier is ``factor``."""
    return (codes * factor >> np.uint64(63)).view(np.int64)


class Singles:
    """Items of one word, which are in a text if the word is."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = items
        hashed = np.array([normal_words(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0][0] for _, t in items], np.uint64)
        self.order = np.argsort(hashed, kind="stable")
        self.sorted = hashed[self.order]

    def matches(self, hashes: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], int]:
        low, high = np.searchsorted(self.sorted, hashes, "left"), np.searchsorted(self.sorted, hashes, "right")
        at = np.flatnonzero(high > low)
        text = np.searchsorted(first, at, "right") - 1
        spans = set(zip(text.tolist(), low[at].tolist(), high[at].tolist(), strict=True))
        return {(t, int(self.order[k])): 0 for t, a, b in spans for k in range(a, b)}


class Table:
    """The pieces of a block's items, their vocabulary, and for each round the walks' multipliers and the pieces' samples."""

    def __init__(self, items: list[tuple[int, bytes]], rounds: int, percent: int, seed: int = 11):
        self.percent = percent
        hashed = [(i, normal_words(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]) for i, t in items]
        self.items = [(i, h) for i, h in hashed if len(h) > 1]
        self.vocabulary = np.unique(np.concatenate([h for _, h in self.items])) if self.items else np.empty(0, np.uint64)
        # A code for each word, one for words outside, and one for the end of a window, whose bits are 0.
        self.codes = np.append(mix(self.vocabulary), np.array([0x9E3779B97F4A7C15, 0], np.uint64))
        self.words = [self.encode(h) for _, h in self.items]
        cuts = [(k, n * j // m, n * (j + 1) // m) for k, n in enumerate(map(len, self.words)) for m in [-(-n // PIECE)] for j in range(m)]
        self.owner, self.offset, ends = np.array(cuts, np.int64).reshape(-1, 3).T
        self.sizes = ends - self.offset
        pieces = [self.words[k][a:b] for k, a, b in cuts]
        longest = int(self.sizes.max(initial=1))
        # The first two samples lie within the shortest piece, where no walk can have reached an end.
        head = min(2 * HEAD, max(2, int(self.sizes.min(initial=2 * HEAD))))
        rng = np.random.Generator(np.random.PCG64(seed))
        self.rounds = []
        for r in range(rounds):
            steps_of = rng.integers(0, 2**63, 2 * longest + HEAD, np.uint64) * np.uint64(2) + np.uint64(1)
            one = r % min(HEAD, head - 1)
            two = int(rng.integers(one + 1, head))
            late = np.sort(rng.random(SAMPLES - 2) * 0.9 + 0.1)
            steps = np.array([[one, two, *np.maximum(two + 1, (late * 2 * n).astype(int))] for n in self.sizes], np.int64).reshape(-1, SAMPLES)
            seen = np.array([self.walk(w, steps_of, s) for w, s in zip(pieces, steps, strict=True)], np.int64).reshape(-1, SAMPLES)
            heads = defaultdict(list)
            for k, row in enumerate(seen):
                heads[int(row[0]) * (len(self.vocabulary) + 2) + int(row[1])].append(k)
            keys = np.array(sorted(heads), np.int64)
            begin = np.cumsum([0, *(len(heads[k]) for k in keys)])
            members = np.array([x for k in keys for x in heads[k]], np.int64)
            starts = np.zeros(len(self.vocabulary) + 2, bool)
            starts[seen[:, 0]] = True
            self.rounds.append((steps_of, one, two, steps, seen, starts, keys, begin, members))

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the vocabulary's words; for others the vocabulary's size."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int32)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at, len(self.vocabulary)).astype(np.int32)

    def walk(self, w: np.ndarray, steps_of: np.ndarray, steps: np.ndarray) -> list[int]:
        out, i, end, j, size = [], 0, len(self.vocabulary) + 1, 0, len(w)
        codes, factors = self.codes[w].tolist(), steps_of.tolist()
        for goal in steps.tolist():  # ascending
            while j < goal:
                i += (codes[i] * factors[j] & 2**64 - 1) >> 63 if i < size else 0
                j += 1
            out.append(int(w[i]) if i < size else end)
        return out

    @staticmethod
    def steps_on(codes: np.ndarray, steps_of: np.ndarray, start: np.ndarray, state: np.ndarray, step: int, goal: np.ndarray) -> np.ndarray:
        """Where the walks from ``start`` (ascending), at ``state`` in ``step``, stand in the steps ``goal``.

        A walk does not depend on the item, so it is made once for each start, as far as its furthest goal; walks are
        sorted by that, and fewer go on with each step. Past an item's or a text's end a walk may go on: it stays past it.
        """
        first = np.flatnonzero(np.append(True, start[1:] != start[:-1]))
        far = np.maximum.reduceat(goal, first)
        order = np.argsort(-far, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        walker = place[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(start))))]
        now, far = state[first][order].astype(np.int64), far[order]
        by_goal = np.argsort(goal, kind="stable")
        ends = np.searchsorted(goal[by_goal], np.arange(step, int(far[0]) + 2))
        active = np.searchsorted(-far, -np.arange(step, int(far[0]) + 1), "left")
        out = np.empty(len(start), np.int64)
        for k, j in enumerate(range(step, int(far[0]))):
            n = active[k]
            now[:n] += _bit(codes.take(now[:n]), steps_of[j])
            if ends[k + 2] > ends[k + 1]:
                due = by_goal[ends[k + 1] : ends[k + 2]]
                out[due] = now[walker[due]]
        due = by_goal[: ends[1]]  # goals in the step itself
        out[due] = state[due]
        return out

    def candidates(self, ids: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each round (its number, window starts, pieces) that collide. left: words from each position to its text's end."""
        n, end = len(ids), len(self.vocabulary) + 1
        known = np.flatnonzero(ids < len(self.vocabulary))
        if not n or not len(self.items) or not len(known):
            return
        # One step beyond the last word of the chunk stands for the end.
        more = np.append(ids, np.full(2 * HEAD + 2, end, np.int32))
        codes = self.codes.take(more)
        for number, (steps_of, one, two, steps, seen, starts, keys, begin, members) in enumerate(self.rounds):
            at = np.arange(n, dtype=np.int64)
            for j in range(one):
                at += _bit(codes.take(at) if j else codes[:n], steps_of[j])
            keep = np.flatnonzero(starts.take(more.take(at) if one else ids))
            at = at[keep]
            first = more.take(at)
            for j in range(one, two):
                at += _bit(codes.take(at), steps_of[j])
            key = first.astype(np.int64) * (end + 1) + more[at]
            found = np.searchsorted(keys, key)
            found[found == len(keys)] = 0
            ok = np.flatnonzero(keys[found] == key)
            if not len(ok):
                continue
            found = found[ok]
            count = begin[found + 1] - begin[found]
            start, state = np.repeat(keep[ok], count), np.repeat(at[ok], count)
            which = members[np.repeat(begin[found] - np.cumsum(count) + count, count) + np.arange(count.sum())]
            for s in range(2, SAMPLES):
                stood = self.steps_on(codes, steps_of, start, state, two, steps[which, s])
                over = (stood - start >= self.sizes[which]) | (stood - start >= left[start])
                same = np.flatnonzero(np.where(over, end, more[stood]) == seen[which, s])
                start, state, which = start[same], state[same], which[same]
                if not len(start):
                    break
            if len(start):
                yield number, start, which

    def matches(self, hashes: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], int]:
        """{(text, item's number): edits} of confirmed items."""
        ids = self.encode(hashes)
        counts = np.diff(first)
        text = np.repeat(np.arange(len(counts)), counts)
        left = first[1:][text] - np.arange(len(ids))
        found: dict[tuple[int, int], int] = {}
        tried: set[tuple[int, int]] = set()
        for _, start, which in self.candidates(ids, left):
            for p, k, before in zip(start.tolist(), self.owner[which].tolist(), self.offset[which].tolist(), strict=True):
                key = (int(text[p]), k)
                p -= before
                if key in found and not found[key] or (p, k) in tried:
                    continue
                tried.add((p, k))
                size = len(self.words[k])
                slack = allowed(size, self.percent)
                a, b = max(int(first[key[0]]), p - slack), min(int(first[key[0] + 1]), p + size + slack)
                if b - a < size - slack:
                    continue
                window = ids[a:b].tolist()
                if len(set(self.words[k].tolist()) - set(window)) > slack:
                    continue
                edits = edit_distance(self.words[k].tolist(), window)
                if edits <= slack:
                    found[key] = min(edits, found.get(key, edits))
        return found


def first_rounds(size: int, percent: int, head: bytes = b"", seed: int = 5) -> list[int]:
    """For made-up items of ``size`` words, with as many random edits as are allowed, the round that finds each, ascending.

    ``MOST`` for those that no round finds. ``head``: an item that stands in the same table.
    """
    rng = random.Random(seed)
    items = [[f"{k}x{n}" for n in range(size)] for k in range(TRIALS)]
    table = Table([(k, " ".join(w).encode()) for k, w in enumerate(items)] + ([(TRIALS, head)] if head else []), MOST, percent)
    texts = []
    for w in items:
        w = w.copy()
        for _ in range(allowed(size, percent)):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            w[at : at + (kind > 0)] = [] if kind == 1 else ["other"]
        texts.append(" ".join(["before", *w, "behind"]).encode())
    hashes, first = normal_words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    text = np.repeat(np.arange(TRIALS), np.diff(first))
    found = [MOST] * TRIALS
    for number, start, which in table.candidates(table.encode(hashes), first[1:][text] - np.arange(len(text))):
        for k in which[text[start] == which].tolist():
            found[k] = min(found[k], number)
    return sorted(found)


def rounds_for(sizes: list[int], percent: int, recall: float) -> int:
    """Rounds after which the target is reached by items of the least, the median and the largest of ``sizes``."""
    if not allowed(max(sizes), percent):
        return 1  # without edits the walks are equal
    least = " ".join(f"y{n}" for n in range(min(sizes))).encode()
    cut = sorted(n // -(-n // PIECE) for n in sizes)
    probes = {cut[0], cut[len(cut) // 2], cut[-1]}
    last = [first_rounds(s, percent, least)[math.ceil(recall * TRIALS) - 1] for s in sorted(probes)]
    return min(MOST, max(FEWEST, *(k + 1 for k in last)))


def by_length(items: list[tuple[int, bytes]], percent: int) -> list[list[tuple[int, bytes]]]:
    """The items in groups for tables: without edits, with edits but shorter than the samples' head, and the others.

    Items of one word come first, in a group of their own; items without words are in none.
    """
    groups = defaultdict(list)
    for i, t in items:
        n = len(normal_words(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0])
        if n:
            groups[-1 if n == 1 else 0 if not allowed(n, percent) else 1 if n < 2 * HEAD else 2].append((i, t))
    return [groups[k] for k in sorted(groups)]


def plan(items: list[tuple[int, bytes]], percent: int, recall: float, rounds: int | None = None) -> list[tuple[list[tuple[int, bytes]], int]]:
    """The tables' items, ``BLOCK_ITEMS`` at most in each, and their rounds (0: single words); ``rounds`` instead of the
    simulated number."""
    out = []
    for group in by_length(items, percent):
        sizes = [len(normal_words(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]) for _, t in group]
        n = 0 if max(sizes) == 1 else rounds or rounds_for(sizes, percent, recall)
        out += [(group[k : k + BLOCK_ITEMS], n) for k in range(0, len(group), BLOCK_ITEMS)]
    return out


#: The tables that this worker process has built last, by the name of their part.
_built: dict[str, list[Singles | Table]] = {}


def build(name: str, blocks: list, percent: int) -> list[Singles | Table]:
    """The tables of a part: built once in a worker process, which keeps one part's at a time."""
    if name not in _built:
        _built.clear()
        _built[name] = [Table(items, rounds, percent) if rounds else Singles(items) for items, rounds in blocks]
    return _built[name]


def _scan(blocks, name: str, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = build(name, blocks.value, percent)
        for batch in batches:
            n_words, item_ids, edits = [], [], []
            for first, last, buf, offsets in chunks(batch.column(1)):
                hashes, begin = normal_words(buf, offsets)
                hits: list[dict[int, int]] = [{} for _ in range(last - first)]
                for table in tables:
                    for (t, k), e in table.matches(hashes, begin).items():
                        item = table.items[k][0]
                        hits[t][item] = min(e, hits[t].get(item, e))
                n_words += np.diff(begin).tolist()
                item_ids += [sorted(h) for h in hits]
                edits += [[h[i] for i in sorted(h)] for h in hits]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(item_ids, pa.list_(pa.int64())), pa.array(edits, pa.list_(pa.int32())), batch.column(2)],
                ["doc_id", "n_words", "item_ids", "edits", "digest"],
            )

    return run


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, percent: int = 15, rounds: int | None = None, part_mb: float = 64, id_col: str = "doc_id", text_col: str = "text", recall: float = 0.9
) -> DataFrame:
    """doc_id, n_words, item_ids (ascending), edits (of each item) and contaminated, per row of ``docs``.

    An item is in a text if some part of the text is within ``percent`` % of the item's words in word edits (insert,
    delete, replace), after folding case and dropping punctuation. ``recall`` is the share of such items, with all the edits
    that are allowed, to be found; ``rounds`` sets the number of walks instead. Items without room for an edit are all
    found. Items without a word match nothing; items with one id count as one; null and empty texts hold nothing; repeated
    rows get equal results. A benchmark of more than ``part_mb`` MB is split by a hash of the item's id, and the texts are
    read once for each part. Other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    parts = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / (part_mb * 1e6)))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("digest", F.sha2("text", 256) if parts > 1 else F.lit(None).cast("string"))

    def scanned(part: int) -> DataFrame:
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        rows = sorted((r.item_id, r.text.encode()) for r in own.collect())
        blocks = spark.sparkContext.broadcast(plan(rows, percent, recall, rounds))
        return texts.mapInArrow(_scan(blocks, uuid.uuid4().hex, percent), "doc_id long, n_words long, item_ids array<long>, edits array<int>, digest string")

    found = scanned(0)
    if parts > 1:
        found = materialise(found, "part")
        hits = reduce(DataFrame.unionByName, [found, *(materialise(scanned(k).where("size(item_ids) > 0"), "part") for k in range(1, parts))])
        pairs = hits.select("doc_id", "digest", F.explode(F.arrays_zip("item_ids", "edits")).alias("h")).groupBy("doc_id", "digest", "h.item_ids").agg(F.min("h.edits").alias("edits"))
        merged = pairs.groupBy(F.col("doc_id").alias("d"), F.col("digest").alias("g")).agg(F.array_sort(F.collect_list(F.struct(F.col("item_ids").alias("i"), F.col("edits").alias("e")))).alias("h"))
        joined = found.select("doc_id", "n_words", "digest").join(merged, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left")
        found = joined.select("doc_id", "n_words", *(F.coalesce(F.expr(f"transform(h, x -> x.{x})"), F.array().cast(t)).alias(n) for x, n, t in (("i", "item_ids", "array<long>"), ("e", "edits", "array<int>"))))
    return found.drop("digest").withColumn("contaminated", F.size("item_ids") > 0)
