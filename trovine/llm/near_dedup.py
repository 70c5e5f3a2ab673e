"""Near duplicates: MinHash bands propose, a sequential Bayesian test prunes, full shingle sets decide.

1. Texts with equal shingle sets form a class; only its smallest id goes on.
2. Banded MinHash signatures give buckets. In each bucket all members are compared with one leader, the member that
   shares most buckets with others (a near copy with few edits), so a bucket costs as many pairs as it has members.
3. A pair's signatures are compared batch by batch; it is dropped as soon as the posterior probability of the wanted
   similarity falls below ``miss``. Survivors are confirmed on the full sets, from the texts.
4. Confirmed links give components. Where a bucket still holds members of different components, these are compared
   across components, in blocks of bounded size, by the same steps: first by signatures, which tells the members that
   need their texts, then by texts; only a link that joins two components is emitted. So no candidate of the bands is
   left out, no bucket emits its square, and a text travels only if it may have a link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .textcore import chunks, gram_hashes, mix, signed, word_hashes, words

HASHES, BANDS, BATCH = 128, 32, 32
_A = np.random.Generator(np.random.PCG64(7)).integers(0, 2**31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
_B = np.random.Generator(np.random.PCG64(8)).integers(0, 2**32, HASHES, np.uint32)
_C = np.random.Generator(np.random.PCG64(9)).integers(1, 2**63, BANDS, np.uint64)


def _lower(buf: np.ndarray) -> np.ndarray:
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    return out


def _shingles(buf: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; of a shorter text its whole sequence, if there is a word."""
    buf = _lower(buf)
    starts, ends, first = words(buf, offsets)
    hashes = word_hashes(buf, starts, ends)
    grams = gram_hashes(hashes, size)
    for t in range(len(offsets) - 1):
        a, b = first[t], first[t + 1]
        yield np.unique(grams[a : b - size + 1]) if b - a >= size else mix(gram_hashes(hashes[a:b], b - a) + np.uint64(b - a)) if b > a else np.empty(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), 4096):
        y = (x[k : k + 4096, None] ^ _B) * _A
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(out, y.min(0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, -1).astype(np.uint64)
    out = _C.copy()
    for k in range(rows.shape[1]):
        out = mix(out + rows[:, k])
    return out


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, sig, bands = [], [], [], []
            for _, _, buf, offsets in chunks(batch.column(1)):
                for s in _shingles(buf, offsets, size):
                    n.append(len(s))
                    if len(s):
                        full = signature(s)
                        low = np.array([mix(s).sum(), mix(s ^ _C[0]).sum()], np.uint64)
                        key.append(low.tobytes())
                        sig.append((full & np.uint32(255)).astype(np.uint8).tobytes())
                        bands.append(signed(band_keys(full)))
                    else:
                        key.append(None), sig.append(None), bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "sig", "bands"],
            )

    return run


@cache
def thresholds(similarity: float, miss: float) -> tuple[int, ...]:
    """For each batch of signature values, the fewest matches with which a pair goes on.

    The prior of the similarity is uniform; a match of two 8-bit values has the chance s + (1 - s) / 256. A pair is
    dropped where the posterior probability of s >= ``similarity`` is below ``miss``.
    """
    grid = (np.arange(2000) + 0.5) / 2000
    p = grid + (1 - grid) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        least = n
        for m in range(n, -1, -1):
            like = np.exp(m * np.log(p) + (n - m) * np.log1p(-p) + math.lgamma(n + 1) - math.lgamma(m + 1) - math.lgamma(n - m + 1))
            if like[grid >= similarity].sum() < miss * like.sum():
                break
            least = m
        out.append(least)
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, limits: tuple[int, ...]) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (signatures) pass every batch."""
    alive, matched = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, least in enumerate(limits):
        cols = slice(k * BATCH, (k + 1) * BATCH)
        matched[alive] += (a[alive, cols] == b[alive, cols]).sum(1, dtype=np.int32)
        alive = alive[matched[alive] >= least]
    return alive


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _prune(limits: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = survivors(_matrix(batch.column(2)), _matrix(batch.column(3)), limits) if len(batch) else []
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def word_shingles(text: str, size: int) -> set[bytes]:
    w = text.encode().translate(_LOWER).split()
    return {b" ".join(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def linked(a: str, b: str, size: int, percent: int) -> bool:
    """100 x intersection >= percent x union of the texts' shingles, compared as words."""
    x, y = word_shingles(a, size), word_shingles(b, size)
    both = len(x & y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(size: int, percent: int):
    """The linked pairs (a, b) of rows with both texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(x.as_py(), y.as_py(), size, percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Part:
    """The rows of a bucket's part: id, component, signature, left, right, bands, own band, one, and perhaps the text.

    ``left`` members are compared with ``right`` ones of other components, in the first band that the two share.
    """

    def __init__(self, rows: list[tuple], limits: tuple[int, ...]):
        self.ids, self.comps, self.limits = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), limits
        self.left, self.right = np.array([r[3] for r in rows], bool), np.array([r[4] for r in rows], bool)
        self.sigs = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, HASHES)
        self.bands, self.band = np.array([r[5] for r in rows]), rows[0][6]
        self.most = np.array([not r[7] for r in rows], bool)  # of the bucket's largest component

    def partners(self, i: int) -> np.ndarray:
        """The members that may be linked with member ``i``."""
        other = np.flatnonzero(self.right & (self.comps != self.comps[i]) & (self.most | (self.ids > self.ids[i])))
        ok = other[survivors(np.broadcast_to(self.sigs[i], (len(other), HASHES)), self.sigs[other], self.limits)]
        return ok[(self.bands[ok] == self.bands[i]).argmax(1) == self.band] if len(ok) else ok

    def compared(self) -> np.ndarray:
        return np.flatnonzero(self.left) if (self.comps != self.comps[0]).any() else np.empty(0, int)


def _hopeful(limits: tuple[int, ...]):
    """Of each part (rows sorted by part) the members that a signature allows a link across components."""

    def settle(key: list, rows: list[tuple]) -> Iterator[tuple]:
        part, found = _Part(rows, limits), np.zeros(len(rows), bool)
        for i in part.compared():
            ok = part.partners(i)
            found[ok] = True
            found[i] |= len(ok) > 0
        return ((*key, int(i)) for i in part.ids[found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [x for key, rows in _parts(batches) for x in settle(key, rows)]
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["band", "key", "i", "j", "id"])

    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[tuple]]]:
    """(part, rows) of parts with two rows or more."""
    key, group = None, []
    for batch in batches:
        for *k, a, b, c, d, e, f, g, h, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if k != key:
                if len(group) > 1:
                    yield key, group
                key, group = k, []
            group.append((a, b, c, d, e, f, g, h, text))
    if len(group) > 1:
        yield key, group


def _across(limits: tuple[int, ...], size: int, percent: int):
    """Links between a part's members in different components, one for each two components that it joins.

    Signatures first, then hashed sets, then the shingles as words. Two components that a link has joined are one for
    the rest of the part.
    """

    def settle(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        part, hashed = _Part(rows, limits), {}

        def shingles(k: int) -> np.ndarray:
            if k not in hashed:
                raw = np.frombuffer(rows[k][8].encode(), np.uint8)
                hashed[k] = next(_shingles(raw, np.array([0, len(raw)]), size))
            return hashed[k]

        for i in part.compared():
            for j in part.partners(i):
                if part.comps[i] == part.comps[j]:
                    continue
                x, y = shingles(i), shingles(j)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both) and linked(rows[i][8], rows[j][8], size, percent):
                    yield min(int(part.ids[i]), int(part.ids[j])), max(int(part.ids[i]), int(part.ids[j]))
                    part.comps[part.comps == part.comps[j]] = part.comps[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _pairs([x for _, rows in _parts(batches) for x in settle(rows)])

    return run


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id of ``edges`` (a, b), by minima and pointer jumps.

    Each round is written to the shared folder. A hub's edges are reduced before the shuffle; its label is a join that
    Spark can split.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        stepped = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("far"))
        stepped = stepped.join(jump, "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("component"), F.col("component").alias("was"))
        stepped = materialise(stepped, "labels")
        labels = stepped.select("id", "component")
        if stepped.where("component <> was").limit(1).count() == 0:
            return labels


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 75, miss: float = 0.001, part: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept per row of ``docs``.

    Two texts are linked if 100 x intersection >= ``percent`` x union of their sets of ``shingle``-word runs (A-Z in
    lower case). Null, empty and blank texts have empty sets and no links. Rows with one id are one document, which has
    the links of each row; a row with a null id has no links and its component is null, and it is kept.
    Bands of four values miss a pair at 0.75 with a chance of 6e-6; the test drops one with a chance near ``miss``.
    Other columns are ignored; empty tables give no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed_ = texts.mapInArrow(_sign(shingle), "doc_id long, n_shingles long, set_key binary, sig binary, bands array<long>")
    signed_ = materialise(signed_, "signatures")
    sets = signed_.where("n_shingles > 0 AND doc_id IS NOT NULL")
    limits = thresholds(percent / 100, miss)
    class_ids = sets.groupBy("set_key").agg(F.min("doc_id").alias("id"))
    # Written, so that the join of a class of very many copies has an exchange of its own and can be split.
    several = materialise(sets.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("last")).where("id < last").select("set_key", "id"), "several")
    # of rows with one id and one set, any will do: they are equal
    members = sets.groupBy("doc_id", "set_key").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    reps = materialise(members.join(class_ids.withColumnRenamed("id", "doc_id"), ["doc_id", "set_key"]).select(F.col("doc_id").alias("id"), "sig", "bands", "set_key"), "classes")
    rows = reps.select("id", F.posexplode("bands").alias("band", "key"))
    sizes = rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(rows.join(sizes, ["band", "key"]), "buckets")
    rank = shared.groupBy("id").agg(F.sum("n").alias("rank"))
    ranked = shared.join(rank, "id")
    leaders = ranked.groupBy("band", "key").agg(F.max_by("id", F.struct("rank", -F.col("id"))).alias("leader"))
    star = shared.join(leaders, ["band", "key"]).where("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()

    def pruned(pairs: DataFrame) -> DataFrame:
        with_sigs = pairs.join(reps.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(reps.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
        return with_sigs.select("a", "b", "sa", "sb").mapInArrow(_prune(limits), "a long, b long")

    def confirmed(pairs: DataFrame, label: str) -> DataFrame:
        own = texts.where("doc_id IS NOT NULL")
        left, right = own.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), own.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
        ok = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(_confirm(shingle, percent), "a long, b long")
        return materialise(ok.distinct(), label)

    def copies(linked: DataFrame) -> DataFrame:
        return sets.select("doc_id", "set_key").join(several, "set_key").select(F.col("id").alias("a"), F.col("doc_id").alias("b")).where("a <> b").union(linked)

    links = [confirmed(materialise(pruned(star), "candidates"), "links")]
    labels = components(links[0])
    # Members of one bucket in different components; one with a unique component is its own.
    now = shared.join(labels, "id", "left").select("band", "key", "id", F.coalesce("component", "id").alias("component"))
    mixed = now.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high")
    largest = now.join(mixed.select("band", "key", "n"), ["band", "key"]).groupBy("band", "key", "component", "n").agg(F.count("*").alias("m"))
    largest = largest.groupBy("band", "key", "n").agg(F.max_by("component", F.struct("m", "component")).alias("most"))
    inside = now.join(largest, ["band", "key"]).select("band", "key", "id", "component", "n", (F.col("component") != F.col("most")).alias("one"))
    # A large bucket is a square of parts: members outside the largest component, by block, against all, by block.
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / part)).cast("int")
    inside = inside.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    rows_ = F.transform(every, lambda k: F.struct(k.alias("i"), F.col("own").alias("j"), (F.col("one") & (k == F.col("own"))).alias("left"), F.lit(True).alias("right")))
    columns = F.transform(F.filter(every, lambda k: k != F.col("own")), lambda k: F.struct(F.col("own").alias("i"), k.alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right")))
    inside = inside.withColumn("cell", F.explode(F.when(F.col("one"), F.concat(rows_, columns)).otherwise(rows_)))
    bucket = ["band", "key", "i", "j"]
    inside = inside.select("band", "key", "cell.i", "cell.j", "id", "component", "cell.left", "cell.right", "one")

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.join(reps.select("id", "sig", "bands"), "id").repartition(*bucket).sortWithinPartitions(*bucket)
        return rows.select(*bucket, "id", "component", "sig", "left", "right", "bands", F.col("band").alias("own_band"), "one", "text")

    inside = materialise(inside, "parts")
    hopeful = dealt(inside.withColumn("text", F.lit(None).cast("string"))).mapInArrow(_hopeful(limits), "band int, key long, i int, j int, id long")
    inside = inside.join(materialise(hopeful, "hopeful"), [*bucket, "id"]).join(texts.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text"), "id")
    links.append(materialise(dealt(inside).mapInArrow(_across(limits, shingle, percent), "a long, b long").distinct(), "links"))
    labels = components(copies(reduce(DataFrame.union, links)))
    return (
        signed_.select("doc_id", "n_shingles")
        .join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
