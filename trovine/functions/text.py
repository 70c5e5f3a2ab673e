"""Text normalisation, tokens and document texts, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys and values of listing parameters that say nothing about the service, in the order of the source.
BOILERPLATE = (
    "Время для связи, дни недели", "Время для связи от", "Время для связи до", "Время для связи",
    "Место оказания услуг", "Где вы оказываете услуги", "Кто оказывает услуги", "Как вы работаете",
    "Тип стоимости за услугу", "Тип стоимости за час", "Тип стоимости", "Начальная цена", "Стоимость",
    "Работаете с юрлицами и ИП", "Работа по договору", "Берёте ли срочные заказы", "Опыт работы",
    "Рабочие дни", "Ваши клиенты", "Продолжительность", "Предоплата", "Гарантия",
    "Название услуги", "Специальность или сфера", "Чем вы занимаетесь", "Предмет или специальность",
    "Тип услуги автосервиса", "Вид услуги", "Тип услуги", "Направление", "Услуги", "Услуга",
    "Понедельник", "Вторник", "Среда", "Четверг", "Пятница", "Суббота", "Воскресенье",
    "пн.", "вт.", "ср.", "чт.", "пт.", "сб.", "вс.",
    "Удалённо", "У себя", "У заказчика дома", "В салоне", "Женщины", "Мужчины", "Женщина", "Мужчина",
    "Частный исполнитель", "Компания",
    "График работы, дни недели", "График работы от", "График работы до", "График работы", "дни недели",
    "Минимальное время заказа", "Куда выезжаете", "По всему городу", "Готов закупить материалы",
    "Есть портфолио", "Учебное учреждение", "Год окончания", "Число мест", "Бригада", "человека", "человек",
    "Дополнительно", "Производители", "Марка", "Модель", "Своя", "лет и больше", "ч", "мин",
)

#: Letters, digits and underscore in any script: what Python calls a word character, legal in Java and RE2 alike.
TOKEN = r"[\p{L}\p{N}_]+"


def text(c: str | Column) -> Column:
    """Null stands for the empty text."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of white space, no-break spaces too, to one space; trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalise(c: str | Column, fold_yo: bool = True, collapse: bool = True) -> Column:
    """Lower case, ё to е, one space between words. The flags give the two narrower variants of the reference."""
    out = F.lower(text(c))
    out = F.translate(out, "ё", "е") if fold_yo else out
    return squeeze(out) if collapse else F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def clean_params(c: str | Column) -> Column:
    """Parameters without boilerplate phrases (longest first, whole words) and without numbers and ranges."""
    phrases = "|".join(re.escape(p).replace(r"\ ", " ") for p in sorted(BOILERPLATE, key=len, reverse=True))
    out = F.regexp_replace(text(c), rf"(?U)(?<!\w)(?:{phrases})(?!\w)", " ")
    out = F.regexp_replace(out, r"(?U)\b\d[\d\s.,–-]*\b", " ")
    return squeeze(out)


def item_text(title: Column, params: Column, description: Column, desc_chars: int = 500, variant: str = "a") -> Column:
    """Document text: title, parameters, start of the description. Variant b has the title twice, c no description."""
    if variant not in ("a", "b", "c"):
        raise ValueError(f"no variant {variant!r}")
    head = [text(title), F.lit(". ")] * (2 if variant == "b" else 1)
    body = [text(params)] + ([] if variant == "c" else [F.lit(". "), F.substring(squeeze_runs(text(description)), 1, desc_chars)])
    return F.concat(*head, *body)


def squeeze_runs(c: Column) -> Column:
    """Runs of white space to one space, without trimming."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def query_text(query: Column, filters: Column) -> Column:
    """The query, with its filters in parentheses if there are any."""
    return F.when(text(filters) == "", text(query)).otherwise(F.concat(text(query), F.lit(" ("), text(filters), F.lit(")")))


def tokens(c: str | Column) -> Column:
    return F.regexp_extract_all(F.translate(F.lower(text(c)), "ё", "е"), F.lit(TOKEN), F.lit(0))


def prefix_tokens(c: str | Column, size: int = 5) -> Column:
    """Tokens of more than one letter or digit, cut to ``size`` characters."""
    found = F.regexp_extract_all(F.translate(F.lower(text(c)), "ё", "е"), F.lit("[а-яa-z0-9]+"), F.lit(0))
    return F.transform(F.filter(found, lambda x: F.length(x) > 1), lambda x: F.substring(x, 1, size))


def title_key(c: str | Column) -> Column:
    """A title without punctuation and case, for twins."""
    return squeeze(F.regexp_replace(F.lower(text(c)), r"[^\p{L}\p{N}_]+", " "))


def word_count(c: str | Column) -> Column:
    return F.size(F.filter(F.split(text(c), r"(?U)\s+"), lambda x: x != "")).cast("long")


def char_count(c: str | Column) -> Column:
    return F.length(text(c)).cast("long")


def has_latin(c: str | Column) -> Column:
    return text(c).rlike("[A-Za-z]")


def has_digit(c: str | Column) -> Column:
    return text(c).rlike("[0-9]")


def contains_phrase(body: Column, phrase: Column) -> Column:
    return (F.length(text(phrase)) > 0) & F.contains(text(body), text(phrase))


def has_filter(c: str | Column) -> Column:
    return F.trim(text(c)) != ""


def query_key(text_norm: Column, location: Column, filters: Column) -> Column:
    """Identity of a query: text, location and filters; null counts as empty and is not skipped."""
    return F.concat_ws("|", text(text_norm), F.coalesce(location.cast("string"), F.lit("")), text(filters))


def cut_words(c: str | Column, n: int) -> Column:
    """The first ``n`` words, for models with a limited input."""
    return F.array_join(F.slice(F.split(squeeze(text(c)), " "), 1, n), " ")


def prompt(query: Column, document: Column, instruction: str = "") -> Column:
    head = F.concat(F.lit(f"Instruct: {instruction}\n"), F.lit("Query: ")) if instruction else F.lit("")
    return F.concat(head, text(query), F.lit("\n"), text(document))


def spaced_words(c: str | Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(squeeze(text(c)), " "), lambda x: x != "")


def char_ngrams(c: str | Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of words padded with a space on both sides; of a shorter word, the padded word once."""
    words = spaced_words(c)

    def of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))

        def size(n: Column) -> Column:
            return F.when(F.length(padded) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substr(padded, i, n))).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high)), size))

    return F.flatten(F.transform(words, of))


def word_ngrams(c: str | Column, n: int = 2) -> Column:
    """Word 1-grams to n-grams."""
    return F.flatten(F.array(*(word_runs(tokens(c), k) for k in range(1, n + 1))))


def word_runs(words: Column, k: int) -> Column:
    """Runs of ``k`` consecutive words, joined by a space.

    The words are bound once, as the variable of an outer function: as an expression they would be made anew for each run.
    """

    def runs(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(F.size(w) >= k, made).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(words), runs), F.lit(0))


def terms(tokens_df: DataFrame, id_col: str, scheme: str = "stem", stems: DataFrame | None = None, lemmas: DataFrame | None = None) -> DataFrame:
    """(id, term) per token of ``tokens_df`` (id, token): stems, lemmas, or both with the prefixes S: and L:.

    ``stems`` and ``lemmas`` are (token, stem) and (word, lemma); a token without an entry stands for itself.
    """
    out = tokens_df.select(id_col, "token")
    if stems is not None:
        out = out.join(stems.select("token", "stem"), "token", "left")
    if lemmas is not None:
        out = out.join(lemmas.select(F.col("word").alias("token"), "lemma"), "token", "left")
    stem = F.coalesce("stem", "token") if stems is not None else F.col("token")
    lemma = F.translate(F.coalesce("lemma", "token"), "ё", "е") if lemmas is not None else F.col("token")
    if scheme == "stem":
        return out.select(id_col, stem.alias("term"))
    if scheme == "lemma":
        return out.select(id_col, lemma.alias("term"))
    if scheme == "lemma+stem":
        return out.select(id_col, F.explode(F.array(F.concat(F.lit("L:"), lemma), F.concat(F.lit("S:"), stem))).alias("term"))
    raise ValueError(f"no scheme {scheme!r}")
