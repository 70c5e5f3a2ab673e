"""Words, repeats, near duplicates, quality rules and benchmark passages against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trovine.llm import decontaminate as DC
from trovine.llm import near_dedup as ND
from trovine.llm import quality_rules as QR
from trovine.llm import queries as Q
from trovine.llm.substring_dedup import remove_repeats
from trovine.llm.textcore import chunks, gram_hashes, word_hashes, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string"


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, passages, repetitive, empty, blank and null texts, clashing column names."""
    rng = random.Random(5)
    base = [sentence(rng, n) for n in (60, 90, 200, 25, 40)]
    passage = sentence(rng, 55)
    out = [*base, *base[:3], None, "", " \t\n ", "one two", "one two", "A b C d e", "a B c D E", "word", "x " * 120, "a b c d e " * 30, "a b c d e " * 30]
    for k in range(30):
        w = base[2].split()
        for _ in range(k % 12):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    out += [sentence(rng, 30) + " " + passage + "\n" + sentence(rng, rng.randrange(5, 40)) for _ in range(12)]
    out += ["Ünïcode stays one  word\x0bnext\x85same " * 8, sentence(rng, 3000, 50)]
    return [(3 * k + 1, t, ("en", "de", None)[k % 3], "s", None, "clash") for k, t in enumerate(out)]


@given(st.lists(st.text(alphabet="ab \t\n\x0b\x0c\r\x1c é", max_size=12), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_words_of_many_texts(texts):
    got = []
    for first, last, buf, offsets in chunks(pa.array(texts), size=7):
        starts, ends, at = words(buf, offsets)
        raw = buf.tobytes()
        own = [raw[a:b] for a, b in zip(starts, ends, strict=True)]
        hashes = word_hashes(buf, starts, ends)
        assert len({(w, h) for w, h in zip(own, hashes.tolist(), strict=True)}) == len(set(own)) == len(set(hashes.tolist()))
        got += [own[at[k] : at[k + 1]] for k in range(last - first)]
    assert got == [t.encode().split() for t in texts]


def test_gram_hashes_differ_by_order():
    h = np.array([1, 2, 3, 1, 2, 3, 2, 1], np.uint64)
    g = gram_hashes(h, 2)
    assert g[0] == g[3] and g[1] == g[4] and len(set(g.tolist())) == 5 and len(gram_hashes(h, 9)) == 0


def brute_repeats(rows, window=20):
    seen, out = set(), {}
    for doc, text in sorted((r[0], r[1]) for r in rows):
        w = split(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[doc] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 3, 0])
def test_repeats_equal_brute_force(spark, rows, hot):
    df = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), hot=hot).withColumn("kept_sha256", F.sha2("kept_text", 256))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()} == brute_repeats(rows)


def test_repeats_with_null_and_equal_ids(spark):
    text = sentence(random.Random(1), 40)
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed) for r in remove_repeats(df).collect())
    assert got == [(-1, 0), (-1, 0), (1, 0), (1, 0), (2, 40)]
    assert remove_repeats(df.where("false")).count() == 0


def test_repeats_of_different_texts_with_one_id(spark):
    rng = random.Random(3)
    one, two, shared = sentence(rng, 40), sentence(rng, 50), sentence(rng, 30)
    texts = [(7, f"{one} {shared}"), (7, f"{shared} {two}"), (7, f"{one} {shared}"), (8, shared), (3, two)]
    order = sorted({(d, hashlib.sha256(t.encode()).hexdigest(), t) for d, t in texts})
    want = brute_repeats([(k, t) for k, (_, _, t) in enumerate(order)])
    got = remove_repeats(spark.createDataFrame(texts, "doc_id long, text string").repartition(2)).collect()
    where = {(d, t): k for k, (d, _, t) in enumerate(order)}
    by_words = sorted((r.doc_id, r.n_words, r.n_removed) for r in got)
    assert by_words == sorted((d, *want[where[d, t]][:2]) for d, t in texts)


@pytest.mark.parametrize("hot", [4096, 100])
def test_repeats_of_a_line_that_all_documents_have(spark, hot):
    rng = random.Random(6)
    line = sentence(rng, 24)
    rows = [(k, f"{sentence(rng, 12)} {line} {sentence(rng, 12)}") for k in range(600)]
    df = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), hot=hot).withColumn("kept_sha256", F.sha2("kept_text", 256))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()} == brute_repeats(rows)


def brute_components(rows, size=5, percent=75):
    def shingles(t):
        w = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return frozenset(tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))) if w else frozenset()

    sets = {r[0]: shingles(r[1]) for r in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), d == find(d)) for d in ids}


@pytest.mark.parametrize("part", [1024, 4])
def test_near_duplicates_equal_brute_force(spark, rows, part):
    got = ND.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), part=part).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_components(rows)


def test_near_duplicates_with_null_and_equal_ids(spark):
    t = sentence(random.Random(2), 30)
    df = spark.createDataFrame([(None, t), (5, t), (3, t), (5, t), (4, None), (9, " ")], "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept) for r in ND.near_duplicates(df).collect())
    assert got == [(-1, None, True), (3, 3, True), (4, 4, True), (5, 3, False), (5, 3, False), (9, 9, True)]
    assert ND.near_duplicates(df.where("false")).count() == 0


def test_bayes_limits_miss_few():
    limits = ND.thresholds(0.75, 0.001)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (4000, ND.HASHES), np.uint8)
    for s, low, high in ((0.75, 0.98, 1.0), (0.9, 0.999, 1.0), (0.4, 0.0, 0.01)):
        b = np.where(rng.random(a.shape) < s, a, rng.integers(0, 256, a.shape, np.uint8))
        assert low <= len(ND.survivors(a, b, limits)) / len(a) <= high


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(10, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = dict(ND.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: 10 for k in range(10, 41)} | {k: 100 for k in range(100, 140)} | {7: 7}


def brute_base(text):
    w = split(text)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def test_base_metrics_equal_brute_force(spark, rows):
    more = [*rows, (9001, "a\nb\na\n\n \na b #*$%&|<> \r\nb", "en", None, None, None), (None, "x y", None, None, None, None)]
    got = QR.base_metrics(spark.createDataFrame(more, SCHEMA), "lang").collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == {r[0]: brute_base(r[1]) for r in more}


def binomial(k, n, p):
    from math import comb

    return sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


def test_binomial_bound(spark):
    cases = [(0, 300), (1, 300), (2, 500), (7, 2000), (30, 5000), (0, 1), (5, 100)]
    df = spark.createDataFrame(cases, "k long, n long").withColumn("p", QR.binomial_cdf("k", "n", 0.01))
    for r in df.collect():
        want = 1.0 if r.k >= r.n * 0.01 else binomial(r.k, r.n, 0.01)
        assert r.p == pytest.approx(want, rel=1e-9)


def test_cutoffs_need_evidence_and_are_per_stratum(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for k in range(1200):
        bad = k % 6 == 0
        lang = "en" if k % 5 else "de"
        docs.append((k, " ".join(f"v{rng.randrange(10**6)}{'###' if bad else ''}" for _ in range(30)), lang))
        labels.append((k, 0 if bad else 1, 0))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in QR.quality_rules(d, lab).collect()}
    assert all(got[k] == (k % 6 > 0 or k % 5 == 0) for k in range(1200))  # de has too few labels for a proof
    assert QR.quality_rules(d.where("false"), lab).count() == 0
    assert all(r.kept for r in QR.quality_rules(d, lab.where("false")).collect())


@pytest.fixture(scope="module")
def labelled():
    """Documents of four strata with symbols, repeated lines and repeats; enough labels in two strata for certified cutoffs."""
    rng, docs, labels = random.Random(9), [], []
    for k in range(4000):
        lang = ("en", "de", "fr", None)[0 if k % 2 else 1 if k % 4 else 2 if k % 8 else 3]
        good = rng.random() < 0.8
        words = [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(11, 60))]
        if rng.random() < (0.003 if good else 0.6):
            words = [w + "##" for w in words]
        lines = [" ".join(words[a : a + 6]) for a in range(0, len(words), 6)]
        if rng.random() < (0.002 if good else 0.4):
            lines += ["same"] * rng.randrange(1, 9)
        docs.append((k, "\n".join(lines), lang))
        if rng.random() < 0.9:
            labels.append((k, int(good), 0))
    return docs, labels


def brute_cutoffs(docs, labels, alpha=0.05, delta=0.05, cost=10.0):
    from fractions import Fraction
    from math import comb

    known, ratios = {}, defaultdict(lambda: [0.0, 0.0, 0.0])
    for d, q, _ in labels:
        if d is not None and q is not None:
            known[d] = max(q, known.get(d, 0))
    for d, t, lang in docs:
        n, _, symbols, dup, repeat, failed = brute_base(t)
        lines = sum(bool(split(x)) for x in (t or "").split("\n"))
        if not failed and d in known:
            own = ratios[lang or "", d]
            own[:] = map(max, own, (symbols / max(n, 1), dup / max(lines, 1), repeat / max(n, 1)))
    strata, out = {s for s, _ in ratios}, {}
    for s in strata:
        for r, rule in enumerate(QR.RULES):
            good = [x[r] for (st_, d), x in ratios.items() if st_ == s and known[d] == 1]
            bad = [x[r] for (st_, d), x in ratios.items() if st_ == s and known[d] == 0]
            best = None
            for c in QR.CUTOFFS:
                k, hits, n = sum(x >= c for x in good), sum(x >= c for x in bad), len(good)
                p = Fraction(alpha / len(QR.RULES))
                bound = 1 if k >= n * p else float(sum(Fraction(comb(n, j)) * p**j * (1 - p) ** (n - j) for j in range(k + 1)))
                if bound <= delta / (len(strata) * len(QR.RULES)) and hits - cost * k > 0:
                    best = max(best or (-1, 0), (hits - cost * k, c))
            if best:
                out[s, rule] = best[1]
    return out


@pytest.mark.parametrize("times", [1, 5])
def test_certified_cutoffs_equal_brute_force_and_sql(spark, labelled, times):
    """Repeated rows are no more evidence than one."""
    import duckdb

    from trovine.llm.oracles import QUALITY

    docs, labels = labelled
    want = brute_cutoffs(docs, labels)
    assert {s for s, _ in want} >= {"en", "de"} and ("", "symbols") not in want and len(want) >= 3
    df, lab = spark.createDataFrame(docs * times, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.stratum, r.rule): r.cutoff for r in QR.calibrate(QR.base_metrics(df, "lang"), lab).collect()}
    assert got == want
    if times == 1:
        kept = {r.doc_id: r.kept for r in QR.quality_rules(df, lab).collect()}
        assert 100 < sum(not x for x in kept.values())
        with duckdb.connect() as con:
            con.register("documents", df.toPandas())
            con.register("labels", lab.toPandas())
            assert dict(con.execute(f"SELECT doc_id, kept FROM ({QUALITY}) x").fetchall()) == kept


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@given(st.lists(st.integers(0, 4), min_size=1, max_size=20), st.lists(st.integers(0, 4), max_size=25))
@settings(max_examples=200, deadline=None)
def test_edit_distance(item, text):
    assert DC.edit_distance(item, text) == distance(item, text)


def test_edited_passages_are_found(spark):
    rng = random.Random(11)
    items = [(k, sentence(rng, rng.randrange(14, 60), 3000).capitalize() + ".") for k in range(60)]
    docs, want = [], {}
    for d in range(600):
        w = sentence(rng, rng.randrange(20, 200), 3000).split()
        if d % 2:
            k, t = items[d % 60]
            p = t.split()
            edits = rng.randrange(0, DC.allowed(len(p), 15) + 1)
            for _ in range(edits):
                at = rng.randrange(len(p))
                p[at : at + 1] = rng.choice([[], [p[at], "inserted"], ["changed!"]])
            at = rng.randrange(len(w))
            w[at:at] = p
            want[d] = k
        docs.append((d, " ".join(w)))
    df = DC.find_benchmark(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (99, None), (98, "?")], "item_id long, text string"))
    got = {r.doc_id: r.item_ids for r in df.collect()}
    missed = [d for d, k in want.items() if k not in got[d]]
    assert len(missed) <= 0.04 * len(want)
    assert all(not got[d] for d in range(0, 600, 2))


def test_benchmark_edges(spark):
    items = spark.createDataFrame([(1, "Éclair du matin, très beau ici"), (1, "alpha beta gamma delta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x ÉCLAIR DU MATIN — TRÈS beau (ici) y"), (2, None), (3, ""), (4, "alpha beta gamma delta"), (None, "beta gamma")], "doc_id long, text string")
    got = {r.doc_id: (r.item_ids, r.contaminated) for r in DC.find_benchmark(docs, items).collect()}
    assert got == {1: ([1], True), 2: ([], False), 3: ([], False), 4: ([1], True), None: ([], False)}
    assert DC.find_benchmark(docs, items.where("false")).where("contaminated").count() == 0


def with_edits(rng, words, edits):
    w = list(words)
    for at in sorted(rng.sample(range(len(w)), edits), reverse=True):
        w[at : at + 1] = rng.choice([[], [w[at], "inserted"], ["changed"]])
    return w


@pytest.fixture(scope="module")
def planted():
    """Items of 1 to 400 words, one document for each with all allowed edits, and documents without any."""
    rng = random.Random(12)
    sizes = [1, 2, 3, 5, 6, 7, 8, 10, 11, 12, 14, 20, 33, 50, 80, 96, 97, 150, 400]
    items = [(100 * n + k, [f"i{n}x{rng.randrange(300)}y{k if n < 7 else 0}" for _ in range(n)]) for n in sizes for k in range(30)]
    docs = [(i, [*(f"f{rng.randrange(500)}" for _ in range(rng.randrange(40))), *with_edits(rng, w, DC.allowed(len(w), 15)), *(f"f{rng.randrange(500)}" for _ in range(20))]) for i, w in items]
    docs += [(-k, [f"f{rng.randrange(500)}" for _ in range(200)]) for k in range(1, 30)]
    return items, docs


@pytest.mark.parametrize("part_mb", [64, 0.05])
def test_items_equal_brute_force_at_every_length(spark, planted, part_mb):
    items, docs = planted
    extra = [(None, None, 0), (999_999, "", 1), (docs[0][0], " ".join(docs[0][1]), 2)]
    table = spark.createDataFrame([*((i, " ".join(w), 0) for i, w in docs), *extra], "doc_id long, text string, item_ids int").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w), 1) for i, w in items], "item_id long, text string, edits int")
    got = DC.find_benchmark(table, bench, part_mb=part_mb).collect()
    assert len(got) == len(docs) + 3 and all(not r.item_ids for r in got if r.doc_id is None or r.doc_id == 999_999 or r.doc_id < 0)
    found = {r.doc_id: dict(zip(r.item_ids, r.edits, strict=True)) for r in got}
    words, missed = dict(items), defaultdict(int)
    for d, w in docs:
        near = {i for i, x in items if len(set(x) - set(w)) <= DC.allowed(len(x), 15)}
        want = {i: e for i in near if (e := distance(words[i], w)) <= DC.allowed(len(words[i]), 15)}
        assert set(found[d]) <= set(want) and all(found[d][i] >= want[i] for i in found[d])
        for i in set(want) - set(found[d]):
            missed[len(words[i])] += 1
    total = defaultdict(int)
    for _, w in items:
        total[len(w)] += 1
    assert all(not missed[n] for n in (1, 2, 3, 5, 6)), "without room for an edit nothing is missed"
    assert all(missed[n] <= 0.1 * total[n] + 1 for n in total), dict(missed)


def test_queries_on_the_small_tables(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    own = Q.queries()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in own["op7_substring_dedup"](spark, sf).collect()} == brute_repeats(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in own["op4_near_dedup"](spark, sf).collect()} == brute_components(docs)
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in own["op1_quality_rules"](spark, sf).drop("kept").collect()} == {d: brute_base(t) for d, t in docs}


def test_a_short_item_leaves_the_recall_of_long_ones():
    rng = random.Random(4)
    items = [(k, [f"v{rng.randrange(3000)}" for _ in range(50)]) for k in range(120)]
    tables = [DC.Table(group, rounds, 15) for group, rounds in DC.plan([(10**6, b"Thank you"), *((k, " ".join(w).encode()) for k, w in items)], 15, 0.9)]
    texts = []
    for _, w in items:
        w = ["other", *w[1:]]  # the first word is always replaced
        for k in rng.sample(range(1, 50), 5):
            w[k] = "other"
        texts.append(" ".join(["before", *w, "behind"]).encode())
    hashes, first = DC.normal_words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    found = {t for table in tables for t, k in table.matches(hashes, first) if table.items[k][0] == t}
    assert len(found) >= 0.8 * len(items)
    assert len(tables) == 2


def test_rounds_follow_the_target_recall():
    assert DC.rounds_for([5], 15, 0.9) == 1
    assert DC.rounds_for([20, 50, 100], 15, 0.97) > DC.rounds_for([20, 50, 100], 15, 0.9) >= DC.FEWEST
