"""Scalar functions on small fixtures with known results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trovine.functions import filters as P
from trovine.functions import numeric as M
from trovine.functions import stem as S
from trovine.functions import text as X


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,want",
    [("  Ёлка  НА дровах ", "елка на дровах"), (None, ""), ("", ""), ("A\tB\n C", "a b c")],
)
def test_normalise(spark, text, want):
    assert one(spark, X.normalise(F.col("t")), t=F.lit(text).cast("string")) == want


def test_normalise_variants(spark):
    assert one(spark, X.normalise("t", fold_yo=False), t="Ёж") == "ёж"
    assert one(spark, X.normalise("t", collapse=False), t=" a  b ") == "a  b"


def test_clean_params(spark):
    got = one(spark, X.clean_params("t"), t="Вид услуги Ремонт Опыт работы 4–6 лет Начальная цена 1 500 часе ч пн. дом")
    assert got == "Ремонт лет часе дом"


def test_document_variants(spark):
    parts = F.lit("T"), F.lit("p"), F.lit("d  e" * 300)
    a, b, c = (one(spark, X.item_text(*parts, variant=v)) for v in "abc")
    assert a.startswith("T. p. d e") and len(a) == len("T. p. ") + 500 and b == "T. " + a and c == "T. p"
    with pytest.raises(ValueError):
        X.item_text(*parts, variant="z")


def test_tokens_and_prefixes(spark):
    assert one(spark, X.tokens("t"), t="Ёж-2, foo_bar!") == ["еж", "2", "foo_bar"]
    assert one(spark, X.prefix_tokens("t"), t="Строительство я дома") == ["строи", "дома"]
    assert one(spark, X.word_ngrams("t", 2), t="a b c") == ["a", "b", "c", "a b", "b c"]
    assert one(spark, X.char_ngrams("t", 3, 4), t="ab") == [" ab", "ab ", " ab "]
    assert one(spark, X.word_count("t"), t=" a  b ") == 2 and one(spark, X.word_count("t"), t="") == 0


def test_query_forms(spark):
    assert one(spark, X.query_text(F.lit("q"), F.lit("f"))) == "q (f)"
    assert one(spark, X.query_text(F.lit("q"), F.lit(None).cast("string"))) == "q"
    assert one(spark, X.query_key(F.lit("t"), F.lit(None).cast("int"), F.lit(None).cast("string"))) == "t||"
    assert one(spark, X.has_filter("t"), t="  ") is False
    assert one(spark, X.cut_words("t", 2), t=" a  b c") == "a b"
    assert one(spark, X.prompt(F.lit("q"), F.lit("d"), "do")) == "Instruct: do\nQuery: q\nd"
    assert one(spark, X.contains_phrase(F.lit("abc"), F.lit(""))) is False


@pytest.mark.parametrize("word,want", [("ремонта", "ремонт"), ("красивый", "красив"), ("бежавшая", "бежа"), ("важность", "важност"), ("делается", "дела"), ("widget", "widget"), ("ёлка", "елк"), ("", "")])
def test_stem(word, want):
    assert S.stem(word) == want


def test_term_schemes(spark):
    rows = spark.createDataFrame([(1, "окна"), (1, "vip")], "id int, token string")
    stems = S.stem_table(rows)
    lemmas = spark.createDataFrame([("окна", "окно")], "word string, lemma string")

    def terms(scheme):
        return sorted(r.term for r in X.terms(rows, "id", scheme, stems, lemmas).collect())

    assert terms("stem") == ["vip", "окн"] and terms("lemma") == ["vip", "окно"] and terms("lemma+stem") == ["L:vip", "L:окно", "S:vip", "S:окн"]
    with pytest.raises(ValueError):
        X.terms(rows, "id", "none")


KEYS = ("K1", "K1 long", "K2")


@pytest.mark.parametrize(
    "text,want",
    [("K1 long v1 K2 v2 w", [("K1 long", "v1"), ("K2", "v2 w")]), ("zzz", [("<other>", "zzz")]), ("zzz K2", [("<other>", "zzz"), ("K2", "")]), ("", []), (None, []), ("K1x y", [("<other>", "K1x y")])],
)
def test_parse_filters(spark, text, want):
    df = spark.createDataFrame([(text,)], "s string")
    got = df.select(P.parse_filters("s", KEYS).alias("x")).first()["x"]
    assert [(p["key"], p["value"]) for p in got] == want


def scan(s, keys, core, values):
    """Word by word: a key begins wherever it stands and a blank or the end follows."""
    out, at = [], 0
    while at < len(s):
        key = next((k for k in sorted(keys, key=len, reverse=True) if s.startswith(k, at) and (s[at + len(k) :] + " ")[0].isspace()), None)
        if key is None:
            if not out:
                out.append([P.OTHER, ""])
            out[-1][1] += s[at]
            at += 1
            continue
        if out and out[-1][0] in core and key in values and not out[-1][1].strip():
            out[-1][1] += key
        else:
            out.append([key, ""])
        at += len(key)
    return [(k, v.strip()) for k, v in out] if s.strip() else []


def test_parse_filters_equals_a_scan(spark):
    rng = random.Random(3)
    words = ["Вид услуги", "Тип услуги", "Услуги", "Услуга", "Аренда авто", "Гарантия", "ремонт", "1 год", "x", "\t", "  ", "авто", "Вид"]
    texts = [rng.choice(["", " "]).join([""] + [rng.choice(words) + rng.choice([" ", " ", ""]) for _ in range(rng.randrange(7))]) for _ in range(1500)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, s string")
    got = {r.k: [(p["key"], p["value"]) for p in r.x] for r in df.select("k", P.parse_filters("s").alias("x")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == scan(t, P.FILTER_KEYS, P.KIND_KEYS + P.TYPE_KEYS, P.VALUES_AFTER_CORE), repr(t)


def test_selectivity_of_kinds_and_types(spark):
    items = spark.createDataFrame([(1, "Вид услуги A Тип услуги X"), (2, "Вид услуги A Тип услуги Y Место оказания дом"), (3, "Вид услуги B"), (4, None)], "item_id int, params string")
    q = [(1, "Вид услуги A"), (2, "Вид услуги A Вид услуги B"), (3, "Тип услуги X"), (4, "Вид услуги A Вид услуги B Тип услуги Y"), (5, "Вид услуги Z"), (6, "Гарантия"), (7, None)]
    got = dict(P.selectivity(spark.createDataFrame(q, "query_id int, filters string"), items).collect())
    assert got == {1: 0.5, 2: 0.75, 3: 0.25, 4: 0.25, 5: 0.0}


def test_value_after_core_key(spark):
    df = spark.createDataFrame([("Тип услуги Аренда авто Гарантия 1 год",)], "s string")
    got = df.select(P.parse_filters("s").alias("x")).first()["x"]
    assert [(p["key"], p["value"]) for p in got] == [("Тип услуги", "Аренда авто"), ("Гарантия", "1 год")]


def test_core_filters_and_match(spark):
    s = "Вид услуги Ремонт Тип услуги Другое Вид услуги Уборка"
    assert one(spark, P.core_filters(P.parse_filters("t")), t=s) == {"vid": ["Вид услуги Ремонт", "Вид услуги Уборка"], "tip": []}
    cands = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "a"), ("z", "a")], "query_id string, item_id string")
    queries = spark.createDataFrame([("q", s), ("r", None)], "query_id string, filters string")
    items = spark.createDataFrame([("a", "Вид услуги Уборка окон"), ("b", None)], "item_id string, params string")
    got = {(r.query_id, r.item_id): (r.q_vid, r.q_tip, r.m_vid, r.m_all) for r in P.filter_match(cands, queries, items).collect()}
    assert got == {("q", "a"): (True, False, True, True), ("q", "b"): (True, False, False, False), ("r", "a"): (False, False, False, False), ("z", "a"): (False, False, False, False)}


def test_numbers(spark):
    assert one(spark, M.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(111.194927, abs=1e-6)
    assert one(spark, M.haversine(F.lit(55.75), F.lit(37.62), F.lit(59.94), F.lit(30.31))) == pytest.approx(635.069760, abs=1e-6)
    assert one(spark, M.number("t"), t="x1") is None and one(spark, M.number("t"), t="1.5") == 1.5
    assert [one(spark, M.round_even(F.lit(v))) for v in (2.5, 3.5)] == [2, 4]
    assert one(spark, M.zero_nan(F.lit(float("nan")))) == 0.0 and one(spark, M.clip(F.lit(5), 6, 9)) == 6
    assert one(spark, M.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 11.0
    assert [one(spark, M.bucket(F.lit(v), [1, 5])) for v in (1, 2, 6)] == [0, 1, 2]
    assert math.isclose(one(spark, F.length(M.seeded_order(F.lit("a")))), 32)
