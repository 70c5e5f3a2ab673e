"""Pseudonyms, mixing, token counts, page text, chats, shards and the pipeline."""

import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from trovine.llm import html_extract as HX
from trovine.llm import mixing as MX
from trovine.llm import pii
from trovine.llm import queries as Q
from trovine.llm.sharding import Conflict, ShardStore, shard_documents
from trovine.llm.token_count import Pieces, byte_level_vocabulary, count_tokens

KEY = b"k"


@given(st.integers(1, 5000), st.binary(min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_feistel_is_a_permutation_with_inverse(size, key):
    f = pii.Feistel(key, "x", size)
    xs = range(0, size, max(1, size // 200))
    ys = [f(x) for x in xs]
    assert all(0 <= y < size for y in ys) and len(set(ys)) == len(ys) and [f.inverse(y) for y in ys] == list(xs)


VALUES = {
    "card": ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004"],
    "iban": ["GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00"],
    "ssn": ["123-45-6789", "665-01-0001"],
    "phone": ["+1 (017) 555-7713", "+49 30 1234 5678", "(212) 555-0100", "212-555-0100"],
    "ip": ["192.168.0.1", "8.8.8.8"],
    "date": ["2024-02-29", "31/12/1999", "12/31/1999", "3.4.2020", "1999/01/02"],
    "email": ["jane.doe42@mail7.example.com"],
}


@pytest.mark.parametrize("kind", VALUES)
def test_pseudonyms_keep_format_and_have_inverse(kind):
    p = pii.Pseudonyms(KEY)
    for v in VALUES[kind]:
        text, found = p.text(f"see {v}, or {v}!")
        new = text[4:].split(", or ")[0]
        assert found == Counter({kind: 2}) and text == f"see {new}, or {new}!" and new != v, (kind, v, text)
        assert p.replace(kind, new) is not None, "a pseudonym is valid in its format"
        back = p.replace(kind, new, back=True)
        assert back == v or kind == "date" and [int(x) for x in back.replace("/", ".").split(".")] == [int(x) for x in v.replace("/", ".").split(".")]
        if kind not in ("date", "ip"):
            assert [c.isalpha() for c in new] == [c.isalpha() for c in v]
            assert [c.isdigit() for c in new] == [c.isdigit() for c in v]


def test_equal_values_link_and_invalid_ones_stay():
    p = pii.Pseudonyms(KEY)
    plain, spaced = p.replace("card", "4111111111111111"), p.replace("card", "4111 1111 1111 1111")
    assert spaced.replace(" ", "") == plain
    assert pii.Pseudonyms(b"other").replace("card", "4111111111111111") != plain
    for t in ("4111111111111112", "300.1.1.1", "2023-02-30", "99/99/2020", "000-12-3456", "version 3.0.1", "1.2.3.4.5", "abc@def", "price 12345"):
        assert p.text(t) == (t, Counter())


@pytest.mark.parametrize("text,value,kind", [
    ("card 4111 1111 1111 1111 123 end", "4111 1111 1111 1111", "card"),
    ("card 4111 1111 1111 1111 12/25", "4111 1111 1111 1111", "card"),
    ("7 4111 1111 1111 1111", "4111 1111 1111 1111", "card"),
    ("pay to AT61 1904 3002 3457 3201 BIC now", "AT61 1904 3002 3457 3201", "iban"),
    ("at 1984-05-12T08:00:00Z", "1984-05-12", "date"),
])
def test_values_beside_other_numbers(text, value, kind):
    new, found = pii.Pseudonyms(KEY).text(text)
    before, after = text.split(value)
    assert found == {kind: 1} and value not in new and new.startswith(before) and new.endswith(after)


def test_a_date_has_one_pseudonym_in_all_forms():
    p = pii.Pseudonyms(KEY)
    for y, m, d in ((2020, 12, 25), (2020, 5, 6), (1987, 1, 31), (2024, 2, 29), (1999, 11, 12)):
        forms = {f"{y}-{m:02d}-{d:02d}": "ymd", f"{y}/{m:02d}/{d:02d}": "ymd", f"{m:02d}/{d:02d}/{y}": "mdy", f"{d:02d}.{m:02d}.{y}": "dmy", f"{d:02d}-{m:02d}-{y}": "dmy"}
        if d > 12:
            forms[f"{d:02d}/{m:02d}/{y}"] = "dmy"
        seen = set()
        for text, order in forms.items():
            new = p.replace("date", text)
            parts = dict(zip(order, map(int, new.replace("/", "-").replace(".", "-").split("-")), strict=True))
            seen.add((parts["y"], parts["m"], parts["d"]))
            assert p.replace("date", new, back=True) == text
        assert len(seen) == 1 and seen != {(y, m, d)}


def test_ibans_hide_letters_too():
    new = pii.Pseudonyms(KEY).replace("iban", "GB82WEST12345698765432")
    assert new[:2] == "GB" and new[4:8] != "WEST" and new[4:8].isalpha() and new[8:].isdigit() and pii.iban_check("GB", new[4:]) == new[2:4]


def test_whole_table_comes_back_and_links(spark, sf):
    """Against the table itself: every document is restored by the key, equal values have equal pseudonyms, others different ones."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in Q.op3_pii(spark, sf).collect()}
    p, pairs, total = pii.Pseudonyms(Q.TEST_KEY), defaultdict(set), Counter()
    assert got.keys() == docs.keys()
    for d, text in docs.items():
        back, found = p.text(got[d].text, back=True)
        assert back == text and all(found[k] == getattr(got[d], f"n_{k}") for k in pii.KINDS)
        total += found
        old, new = pii._PATTERN.finditer(text), pii._PATTERN.finditer(got[d].text)
        for a, b in zip(old, new, strict=True):
            if a[0] != b[0]:
                pairs[a.lastgroup].add((a[0].strip(), b[0].strip()))
    assert sum(total.values()) > 20
    for kind, both in pairs.items():
        assert len({a for a, _ in both}) == len({b for _, b in both}) == len(both), kind


def test_long_texts_clashing_names_and_repeats(spark):
    long = "word " * 300_000 + "1984-05-12"
    df = spark.createDataFrame([(1, long, 0, "a"), (1, long, 0, "a"), (2, "", 1, None), (3, None, None, None)], "doc_id long, text string, n_date int, n_card string")
    got = pii.pseudonymise(df, KEY).collect()
    assert sorted((r.doc_id, r.n_date) for r in got) == [(1, 1), (1, 1), (2, 0), (3, 0)] and len({r.text for r in got}) == 2 and len(got[0].text) in (0, len(long))


def test_pii_rows(spark):
    df = spark.createDataFrame([(1, "mail a.b@x.org"), (2, None), (3, ""), (1, "mail a.b@x.org"), (None, "10.0.0.1")], "doc_id long, text string")
    got = pii.pseudonymise(df, KEY).collect()
    assert len(got) == 5 and sum(r.n_email for r in got) == 2 and len({r.text for r in got if r.n_email}) == 1
    assert all("a.b@x.org" not in r.text and "10.0.0.1" not in r.text for r in got)
    assert pii.pseudonymise(df.where("false"), KEY).count() == 0




def test_schedule_reaches_weights_and_covers(spark):
    rng = random.Random(1)
    rows = [(k, "hot" if k % 3 == 0 else f"s{k % 7}", rng.randrange(1, 50)) for k in range(3000)] + [(9000, "empty", 0), (9001, None, 0), (9002, "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    for options in ({"entropy": 0.97}, {"repetition": 1.5}, {"repetition": 1.0}, {"entropy": 0.0}):
        got = MX.schedule(df.withColumn("source", F.coalesce("source", F.lit(""))), block_tokens=5000, rows_per_range=64, **options).collect()
        assert {r.doc_id for r in got} == {r[0] for r in rows}, "without a budget every document occurs"
        tokens, total = Counter(), Counter()
        for r in got:
            tokens[r.source] += r.n_tokens
        for r in rows:
            total[r[1] or ""] += r[2]
        epochs = {s: tokens[s] / total[s] for s in total if total[s]}
        weight = {r.source: r.weight for r in got if r.weight is not None}
        scale = sum(tokens.values())
        assert sum(weight.values()) == pytest.approx(1)
        assert all(abs(tokens[s] / scale - weight[s]) < 0.01 for s in weight)
        if "repetition" in options:
            assert max(epochs.values()) / min(epochs.values()) <= options["repetition"] * 1.1
        else:
            share = [w for w in weight.values()]
            assert -sum(w * math.log(w) for w in share) / math.log(len(share)) >= options["entropy"] - 1e-3
        streams = defaultdict(list)
        for r in got:
            if r.weight:
                streams[r.source].append((r.at, r.n_tokens, r.block))
        for s, x in streams.items():
            x.sort(key=lambda v: (v[0], v[1] > 0))
            assert all(b[0] == a[0] + a[1] for a, b in zip(x, x[1:])), "positions are sums of what stands before"
            assert all(b == int(at / (weight[s] * 5000)) for at, _, b in x)
        assert max(Counter((r.doc_id, r.epoch) for r in got).values()) == 1


def test_schedule_with_budget_and_edges(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2], 10) for k in range(100)], "doc_id long, source string, n_tokens long")
    got = MX.schedule(df, entropy=1.0, budget=300).collect()
    assert sum(r.n_tokens for r in got) == 300 and {r.epoch for r in got} == {0}
    assert MX.schedule(df.where("false"), entropy=0.5).count() == 0
    twice = MX.schedule(df.union(df), repetition=1.0).groupBy("doc_id").count().collect()
    assert {r["count"] for r in twice} == {2}
    with pytest.raises(ValueError):
        MX.schedule(df)


def spark_hash(*values):
    """Spark's xxhash64 of ints (as tuples of value and bytes) and strings."""
    import xxhash

    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else int(v[0]).to_bytes(v[1], "little", signed=True)
        h = xxhash.xxh64_intdigest(data, h)
    return h


def brute_schedule(rows, weight, tokens, block_tokens, rows_per_range, seed=17):
    total = Counter()
    for _, s, n in rows:
        total[s] += n
    bits = max(6, (max(1, len(rows) // rows_per_range) - 1).bit_length())
    out = []
    for s in {r[1] for r in rows}:
        goal = weight[s] * tokens if s in weight else None
        if goal and abs(goal / total[s] - 1) < 1e-9:
            goal = float(total[s])
        at = 0
        for epoch in range(max(1, math.ceil(goal / total[s])) if goal else 1):
            hashed = [(spark_hash((seed, 4), s, (epoch, 4), (d, 8)), d, n) for d, x, n in rows if x == s]
            for h, d, n in sorted(hashed, key=lambda x: (x[0] >> 64 - bits, x[0] - (x[0] >> 63 << 64), *x[1:])):
                if goal is None or at < goal or n == 0 and at == goal:
                    block = int(at // (weight[s] * block_tokens)) if goal else (h - (h >> 63 << 64)) % max(1, math.ceil(tokens / block_tokens))
                    out.append((block, d, s, epoch, n, at))
                at += n
    where, done = Counter(), []
    for block, d, s, epoch, n, at in sorted(out, key=lambda x: (x[0], (v := spark_hash((seed + 1, 4), x[2], (x[3], 4), (x[1], 8))) - (v >> 63 << 64), x[1], x[4], x[5])):
        done.append((d, s, epoch, n, block, at, where[block]))
        where[block] += 1
    return done


def own_exponent(shares, entropy=None, repetition=None):
    low, high = 0.0, 1.0
    for _ in range(60):
        x = (low + high) / 2
        z = [p**x for p in shares]
        w = [v / sum(z) for v in z]
        if entropy is not None:
            fits = -sum(v * math.log(v) for v in w) / math.log(len(w)) >= entropy
            low, high = (x, high) if fits else (low, x)
        else:
            epochs = [v / p for v, p in zip(w, shares, strict=True)]
            low, high = (low, x) if max(epochs) / min(epochs) <= repetition else (x, high)
    return low if entropy is not None else high


@pytest.mark.parametrize("options", [{"entropy": 0.9}, {"repetition": 3.0}, {"entropy": 0.95, "budget": 9000}])
def test_schedule_equals_brute_force(spark, options):
    rng = random.Random(8)
    rows = [(k % 1900, "hot" if k % 3 == 0 else f"s{k % 5}", rng.choice([0, 1, rng.randrange(1, 60)])) for k in range(2000)] + [(5000 + k, "none", 0) for k in range(40)] + [(6000, "one", 3)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").repartition(3)
    got = MX.schedule(df, block_tokens=700, rows_per_range=16, **options).collect()
    total = Counter()
    for _, s, n in rows:
        total[s] += n
    shares = {s: n / sum(total.values()) for s, n in total.items() if n}
    weight = {r.source: r.weight for r in got if r.weight is not None}
    x = own_exponent(list(shares.values()), **{k: v for k, v in options.items() if k != "budget"})
    z = sum(p**x for p in shares.values())
    assert all(weight[s] == pytest.approx(p**x / z, rel=1e-4) for s, p in shares.items())
    tokens = options.get("budget") or max(total[s] / weight[s] for s in weight)
    want = brute_schedule(rows, weight, tokens, 700, 16)
    assert sorted((r.doc_id, r.source, r.epoch, r.n_tokens, r.block, r.at, r.position) for r in got) == sorted(want)
    first = [r.source for r in sorted(got, key=lambda r: (r.block, r.position)) if r.block == 1]
    assert sum(a != b for a, b in zip(first, first[1:])) > len(first) / 4, "sources are interleaved"


def test_many_epochs_of_one_document(spark):
    df = spark.createDataFrame([(1, "rare", 1), *((k, "big", 50) for k in range(2, 120))], "doc_id long, source string, n_tokens long")
    got = MX.schedule(df, entropy=1.0)
    assert got.where("source = 'rare'").agg(F.count("*"), F.count_distinct("epoch"), F.max("epoch")).first() == (5900, 5900, 5899)


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "a b\nc", "s"), (2, None, None), (3, " ", "t")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.source, r.n_tokens) for r in MX.token_sizes(df).collect()) == [(1, "s", 3), (2, "", 0), (3, "t", 0)]


def greedy(word, first, inner):
    n, at = 0, 0
    while at < len(word):
        pieces = first if at == 0 else inner
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        n, at = n + 1, end
    return n


@given(st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.text("abc", max_size=15))
@settings(max_examples=400, deadline=None)
def test_piece_counts_equal_greedy(first, inner, word):
    a, b = {x.encode() for x in first}, {x.encode() for x in inner}
    assert Pieces(a).count(word.encode()) == greedy(word.encode(), a, a)
    assert Pieces(a, b).count(word.encode()) == greedy(word.encode(), a, b)


def test_piece_counts_equal_a_public_implementation():
    vocabulary = ["un", "aff", "##aff", "##able", "##ab", "##le", "able", "a", "##a", "##f", "u", "##n"]
    tok = Tokenizer(models.WordPiece({v: k for k, v in enumerate([*vocabulary, "[UNK]"])}, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    mine = Pieces([v.encode() for v in vocabulary if v[:2] != "##"], [v[2:].encode() for v in vocabulary if v[:2] == "##"])
    for w in ("unaffable", "affable", "unable", "affle", "una", "able", "ab"):
        pieces = tok.encode(w).tokens
        assert mine.count(w.encode()) == (-1 if pieces == ["[UNK]"] else len(pieces)), w


def test_token_counts_of_rows(spark):
    path = Q.tokenizer_file("byte_bpe_50k.json")
    vocabulary = set(byte_level_vocabulary(path))
    texts = ["Hello wörld, hello  again", "", None, "tokenization\nis fun " * 5, "日本語 x" + "y" * 500]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in count_tokens(df, path).collect()}
    for k, t in enumerate(texts):
        words = (t or "").encode().split()
        assert got[k] == (len(words), sum(greedy(b" " + w, vocabulary, vocabulary) for w in words), 0)


PAGES = [
    ("<html><body><nav><a href=x>Home</a></nav><article><h1>Title &amp; more</h1><p>First  <b>bold</b>text\n here.<br>Next</p><p>Be.</p></article><footer>&copy; x</footer></body></html>", "Title & more First boldtext here. Next Be."),
    ("<body><header><p>Site</p></header><main><p>Body one.<p>Body two.<aside>Ad here</aside><form><label>Mail</label><input></form><p>Three</main><div id='comments'><article><p>A reader said.</p></article></div>", "Body one. Body two. Three"),
    ("<div class='cookie-notice'>We use cookies</div><div class=\"post-content\"><p>Only this.</p><div class='share-buttons'>Share</div><script>if (a<b) x()</script><style>p{}</style></div><div class=sidebar>Links</div>", "Only this."),
    (None, ""),
    ("", ""),
    ("<article><p><b>Open and cut off<br><p>Second &amp", "Open and cut off Second &"),
    ("<article><p>kept</p><!-- not this --><p hidden>no</p><template><p>no</p></template></article>", "kept"),
    ("<p>No article element, but a long enough paragraph of plain text that stands alone on the page.</p>", "No article element, but a long enough paragraph of plain text that stands alone on the page."),
]


@pytest.mark.parametrize("html,want", PAGES)
def test_main_text(html, want):
    assert HX.main_text(html) == want


def test_main_text_without_marks_uses_ratios():
    links = "".join(f"<li><a href='/{k}'>Link number {k}</a></li>" for k in range(12))
    paragraphs = "".join(f"<p>{'A long sentence of the story goes on and on. ' * 6}</p>" for _ in range(5))
    got = HX.main_text(f"<body><ul>{links}</ul><div>{paragraphs}</div><ul>{links}</ul></body>")
    assert got == " ".join([("A long sentence of the story goes on and on. " * 6).strip()] * 5)


LONG = ("A long sentence of the story goes on and on. " * 6).strip()


def test_a_small_mark_does_not_hide_the_body():
    body = "".join(f"<p>{LONG}</p>" for _ in range(5))
    got = HX.main_text(f'<body><div class="post-title">T</div><div class="text">{body}</div></body>')
    assert got.endswith(" ".join([LONG] * 5))


def test_clusters_decide_inside_a_broad_mark():
    body = "".join(f"<p>{LONG}</p>" for _ in range(5))
    links = "".join(f"<li><a href='/{k}'>Link number {k}</a></li>" for k in range(12))
    tiles = "".join(f"<div class=x{k}><span><i></i></span><b>Buy</b> <b>{k}</b></div>" for k in range(12))
    assert HX.main_text(f"<body><div id=main><h1>Title</h1>{body}<ul class=zz>{links}</ul></div></body>") == " ".join(["Title", *[LONG] * 5])
    got = HX.main_text(f"<body><div class=content><h1>Title</h1>{body}<div>{tiles}</div></div></body>")
    assert got.startswith(" ".join(["Title", *[LONG] * 5])) and "Buy 11" not in got


WORDED = [
    (f"<article><h2 id='discussion'>Discussion</h2><p>{LONG}</p></article>", f"Discussion {LONG}"),
    (f"<article><p>{LONG}</p><section id='related-work'><h2>Related work</h2><p>{LONG}</p><p>{LONG}</p></section></article>", f"{LONG} Related work {LONG} {LONG}"),
    (f"<article><div class='article-header'><h1>Title</h1></div><p>{LONG}</p></article>", f"Title {LONG}"),
    (f"<article><p>{LONG}</p><div class='share'><p>Share this</p></div><p>{LONG}</p></article>", f"{LONG} {LONG}"),
    (f"<div class='related'><p>{LONG}</p></div><article><p>{LONG}</p></article>", LONG),
    (f"<html><head><title>T</title><meta charset=x><body><p>{LONG}</p></body></html>", LONG),
    (f"<html><head><title>T</title><script>x()</script><p>{LONG}</p><p>{LONG}</p></html>", f"{LONG} {LONG}"),
    (f"<html><head><title>T</title>{LONG}</html>", LONG),
]


@pytest.mark.parametrize("html,want", WORDED)
def test_words_of_class_and_id_weigh_only_inside_an_article(html, want):
    assert HX.main_text(html) == want


WHOLE = [
    (f"<article><p>{LONG}</p><![foo bar><p>after</p><p>{LONG}</p></article>", f"{LONG} after {LONG}"),
    (f"<article><p>{LONG}</p><!DOCTYPE [<!ELEMENT x><p>{LONG} two</p></article>", None),
    (f"<article><p>where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds. {LONG}</p></article>", f"where x=1 holds. {LONG}"),
    (f"<body><article class=teaser><p>Teaser</p></article><div>{f'<p>{LONG}</p>' * 4}</div></body>", " ".join([LONG] * 4)),
    (f"<div class=content><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG} {LONG}"),
    (f"<article><div class=popular-science><p>{LONG}</p></div><div class=share-price><p>{LONG}</p></div></article>", f"{LONG} {LONG}"),
    (f"<article><p>{LONG}</p><p>{LONG}</p><section id=comments><h3>Comments</h3><p>{LONG}</p></section></article>", f"{LONG} {LONG}"),
    (f"<article class='post no-comments'><div class='has-comments'><p>{LONG}</p></div></article>", LONG),
]


@pytest.mark.parametrize("html,want", WHOLE)
def test_nothing_of_the_article_is_lost(html, want):
    got = HX.main_text(html)
    assert got.endswith(want or f"{LONG} two") and got in (want, f"Teaser {want}", got if want is None else want)


def brute_content(lines):
    """The regions by matrices: ratios, a Gaussian matrix for each of the two sequences, two means."""
    import numpy as np

    def ratios(rows):
        return np.array([min(HX.FULL_RATIO, len(t) / max(1, n)) * (1 - min(1, a / len(t))) for t, n, a, *_ in rows])

    def smoothed(x):
        k = np.arange(len(x))
        d = k[:, None] - k
        w = np.where(abs(d) <= math.ceil(3 * HX.SIGMA), np.exp(-0.5 * (d / HX.SIGMA) ** 2), 0)
        return (w @ x) / w.sum(1) if len(x) else x

    rows, out = [x for x in lines if x[0] and not x[3]], [x for x in lines if x[0] and x[3]]
    r, raw = smoothed(ratios(rows)), ratios(rows)
    both = np.append(r, smoothed(ratios(out)))
    cut = 0.0
    if len(both) and both.max() > 0:
        low, high = both.min(), both.max()
        for _ in range(50):
            up = both > (low + high) / 2
            if up.all() or not up.any():
                low = high = 0.0
                break
            low, high = both[~up].mean(), both[up].mean()
        cut = (low + high) / 2 if high > 3 * low else 0.0
    plain = {m: sum(max(0, len(t) - a) for t, _, a, _, y, _ in rows if y == m) for m in (True, False)}
    odds = min(16.0, max(1.0, plain[True] / plain[False])) if plain[False] else 16.0 if plain[True] else 1.0
    links = [a >= 0.9 * len(t) for t, _, a, *_ in rows]
    kept = []
    for n, (t, _, _, _, marked, block) in enumerate(rows):
        beside = any(links[k] for k in (n - 1, n + 1) if 0 <= k < len(rows))
        own = [k for k, x in enumerate(rows) if x[5] == block]
        rest = [k for k, x in enumerate(rows) if x[5] == 0]
        size = np.array([len(x[0]) for x in rows], float)
        mean = (raw[own] * size[own]).sum() / size[own].sum()
        least = 2 / 3 * (raw[rest] * size[rest]).sum() / size[rest].sum() if rest else 0.0
        if links[n]:
            ok = marked and not block and r[n] >= cut / odds and r[n] > 0 and not beside
        elif block:
            ok = mean >= min(cut or math.inf, least) and (block > 0 or size[own].sum() > size.sum() / 2)
        else:
            ok = (r[n] * odds if marked else r[n] / odds) >= cut if cut else marked or odds == 1
        kept.append(bool(ok))
    it = iter(kept)
    return [next(it) if x[0] and not x[3] else False for x in lines]


def test_regions_equal_brute_force():
    rng = random.Random(5)
    decided = Counter()
    for _ in range(400):
        lines = []
        for _ in range(rng.randrange(1, 30)):
            text = "x" * rng.choice([0, 3, 20, 80, 300, 900])
            marked = rng.random() < 0.5
            lines.append((text, rng.randrange(0, 9), rng.choice([0, 0, len(text), len(text) // 3]), rng.random() < 0.3, marked, rng.choice([0, 0, 0, 1, -2]) if marked else 0))
        got = HX.content(lines)
        assert got == brute_content(lines)
        decided.update(got)
    assert min(decided.values()) > 500


def test_pages_with_repeats_long_texts_and_clashing_names(spark):
    long = f"<article>{f'<p>{LONG}</p>' * 3000}</article>"
    rows = [(1, "u", long, 0, "t"), (1, "u", long, 0, "t"), (2, None, None, 1, None), (None, "v", "<p>plain", 2, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = HX.extract_pages(df).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 5), (1, 3000 * len(LONG) + 2999), (1, 3000 * len(LONG) + 2999), (2, 0)]
    assert HX.extract_pages(df.where("false")).count() == 0


def test_pages_of_the_table(spark, sf):
    got = {r.page_id: r for r in Q.op10_html_extract(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inside = p.html[p.html.index("<article>") + 9 : p.html.index("</article>")]
        import html as H
        import re

        want = " ".join(re.sub(r"\s+", " ", H.unescape(x)).strip() for x in re.split(r"</?(?:p|h\d|br)[^>]*>", re.sub(r"</?b>", "", inside)))
        assert got[p.page_id].text == re.sub(r" +", " ", want).strip() and got[p.page_id].n_chars == len(got[p.page_id].text)


def test_shards_of_several_tiers(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=60_000)
    rng = random.Random(2)

    def batch(a, b):
        return spark.createDataFrame([(k, "".join(rng.choices("abcdefgh", k=200)), None) for k in range(a, b)], "doc_id long, text string, extra string")

    assert store.version() == 0 and store.shards() == []
    assert store.append(batch(0, 0)) == 0
    for k in range(6):
        store.append(batch(k * 100, k * 100 + 100).repartition(3))
    before = store.shards()
    version = store.version()
    with pytest.raises(Conflict):
        store.commit(version - 1, before, store.schema())
    reader = store.read(version)
    store.compact()
    after = store.shards()
    assert len(after) < len(before) and sum(s.rows for s in after) == 600 and sum(s.bytes * 2 < 60_000 for s in after) <= 1
    assert all(s.bytes < 2 * 60_000 for s in after)
    assert reader.count() == 600, "an old version stays readable until vacuum"
    assert store.vacuum() == len(before) + 1, "the merged files, and the file of the batch without rows"
    assert store.vacuum() == 0 and sorted(r.doc_id for r in store.read().collect()) == list(range(600))
    assert store.compact() == store.version()


def test_shard_documents_keeps_every_row(spark, tmp_path):
    rows = [(k if k % 9 else None, f"t{k}", k, None, k) for k in range(200)] + [(5, "again " * 50_000, 0, 1, 2)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, tier int, _metadata int")
    got = shard_documents(df, f"file://{tmp_path}/d", target_bytes=1 << 20)
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in df.collect())
    store = ShardStore(spark, f"file://{tmp_path}/d", 1 << 20)
    assert {r.version for r in got.collect()} == {store.version()} and store.version() >= 4
    assert {(r.file, r.rows, r.tier) for r in store.listed().collect()} == {(s.file, s.rows, store.tier(s.bytes)) for s in store.shards()}
    back = store.read()
    assert back.columns == [*df.columns, "_shard"] and Counter(map(tuple, back.drop("_shard").collect())) == Counter(map(tuple, df.collect()))
    assert shard_documents(df.where("false"), f"file://{tmp_path}/e").count() == 0


def test_columns_of_later_batches_stay(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 20)
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    store.append(spark.createDataFrame([("x", 2, 7.5)], "extra string, doc_id long, score double"))
    with pytest.raises(TypeError):
        store.append(spark.createDataFrame([(3, 1)], "doc_id long, text int"))
    want = [(1, "a", None, None), (2, None, "x", 7.5)]
    assert sorted(map(tuple, store.read().drop("shard").collect())) == want
    store.compact()
    store.vacuum()
    assert len(store.shards()) == 1 and sorted(map(tuple, store.read().drop("shard").collect())) == want


def test_of_two_writers_each_version_has_one(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from trovine.llm.sharding import Shard

    store = ShardStore(spark, f"file://{tmp_path}/s")
    schema = spark.range(1).schema

    def race(k):
        try:
            return store.commit(0, [Shard(f"data/x/part-{k}", 1, 1, 1)], schema)
        except Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [k for k, v in enumerate(pool.map(race, range(16))) if v]
    assert len(won) == 1 and [s.file for s in store.shards()] == [f"data/x/part-{won[0]}"] and store.version() == 1

    other = ShardStore(spark, f"file://{tmp_path}/t")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: ShardStore(spark, f"file://{tmp_path}/t").append(spark.range(k * 10, k * 10 + 10)), range(4)))
    assert other.version() == 4 and sorted(r.id for r in other.read().collect()) == list(range(40))


def brute_plan(store, shards):
    """Each small shard is merged once at most; groups hold one tier and what waited of smaller ones; none is far over the target."""
    groups = store.plan(shards)
    flat = [s for g in groups for s in g]
    assert len(flat) == len(set(flat)) and all(len(g) > 1 for g in groups) and all(s.bytes * 2 < store.target for s in flat)
    assert all(sum(s.bytes for s in g[:-1]) <= store.target * 5 // 4 for g in groups)
    return groups


@given(st.lists(st.integers(1, 3000), max_size=40))
@settings(max_examples=100, deadline=None)
def test_plans_end_with_few_small_files(spark_store, sizes):
    from trovine.llm.sharding import Shard

    store, live, rounds = spark_store, [Shard(f"f{k:03d}", 1, b, k) for k, b in enumerate(sizes)], 0
    while groups := brute_plan(store, live):
        rounds += 1
        gone = {s for g in groups for s in g}
        merged = [Shard(f"m{rounds:03d}-{k:03d}", sum(s.rows for s in g), sum(s.bytes for s in g), 1000 + rounds) for k, g in enumerate(groups)]
        live = [s for s in live if s not in gone] + merged
        assert rounds < 50
    assert sum(s.bytes for s in live) == sum(sizes) and sum(s.bytes * 2 < store.target for s in live) <= 1


@pytest.fixture(scope="module")
def spark_store(spark, tmp_path_factory):
    return ShardStore(spark, f"file://{tmp_path_factory.mktemp('plans')}/s", target_bytes=1000)


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    quality = docs.transform(lambda d: P.quality(spark, d, sf))
    assert quality.columns == columns
    near = P.near_dedup(spark, quality, sf)
    texts = [r.text for r in near.collect()]
    assert near.columns == columns and len(texts) == len(set(texts)) < seen[0]
    clean = P.decontaminate(spark, near, sf)
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = [r.text for r in clean.collect()]
    assert clean.columns == columns and not any(b in t for b in bench for t in left)
    assert all(any(b in t for b in bench) or t in left for t in texts if not any(b[:40].lower() in t.lower() for b in bench))
    mixed = P.mix(spark, clean, sf)
    assert mixed.columns == columns and {r.doc_id for r in mixed.select("doc_id").collect()} == {r.doc_id for r in clean.select("doc_id").collect()}
    assert P.shard(spark, mixed, sf).count() == mixed.count()
    clash = spark.createDataFrame([(k if k % 5 else None, f"text {k}", "s", k, "x", None) for k in [*range(40), 3]], "doc_id long, text string, source string, _copies int, block string, _place int")
    odd = P.mix(spark, clash, sf)
    assert odd.columns == clash.columns and sorted(map(str, odd.collect())) == sorted(map(str, clash.collect()))
    assert P.mix(spark, clash.where("false"), sf).count() == 0
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
