"""The published Snowball algorithm for Russian, over distinct tokens only."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOWELS = "аеиоуыэюя"
# The algorithm's published ending lists.
_GERUND_1, _GERUND_2 = ("вшись", "вши", "в"), ("ывшись", "ившись", "ывши", "ивши", "ыв", "ив")
_ADJECTIVE = ("ими", "ыми", "его", "ого", "ему", "ому", "ее", "ие", "ые", "ое", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
_PARTICIPLE_1, _PARTICIPLE_2 = ("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ")
_REFLEXIVE = ("ся", "сь")
_VERB_1 = ("ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно")
_VERB_2 = (
    "ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ило", "ыло", "ено", "ят", "ует", "уют", "ит", "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю",
)
_NOUN = (
    "а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й", "иям", "ям", "ием", "ем", "ам", "ом", "о", "у", "ах", "иях", "ях", "ы", "ь", "ию", "ью", "ю", "ия", "ья", "я",
)
_SUPERLATIVE, _DERIVATIONAL = ("ейше", "ейш"), ("ость", "ост")


def _longest(word: str, start: int, plain: tuple[str, ...], after_a: tuple[str, ...] = ()) -> str | None:
    """``word`` without its longest ending of the lists; one of ``after_a`` must follow а or я. None: no ending."""
    best = max((e for e in plain + after_a if word.endswith(e) and len(word) - len(e) >= start), key=len, default=None)
    if best is None:
        return None
    cut = len(word) - len(best)
    if best in after_a and best not in plain and (cut - 1 < start or word[cut - 1] not in "ая"):
        return None
    return word[:cut]


def stem(word: str) -> str:
    """The stem of a lower-case word; words without Cyrillic vowels stay as they are."""
    word = word.replace("ё", "е")
    rv = next((k + 1 for k, c in enumerate(word) if c in _VOWELS), len(word))
    regions, k = [], 0
    for _ in range(2):
        while k < len(word) and word[k] not in _VOWELS:
            k += 1
        while k < len(word) and word[k] in _VOWELS:
            k += 1
        k = min(k + 1, len(word))
        regions.append(k)
    r2 = regions[1]
    if (new := _longest(word, rv, _GERUND_2, _GERUND_1)) is not None:
        word = new
    else:
        word = new if (new := _longest(word, rv, _REFLEXIVE)) is not None else word
        if (new := _longest(word, rv, _ADJECTIVE)) is not None:
            word = new
            word = new if (new := _longest(word, rv, _PARTICIPLE_2, _PARTICIPLE_1)) is not None else word
        elif (new := _longest(word, rv, _VERB_2, _VERB_1)) is not None or (new := _longest(word, rv, _NOUN)) is not None:
            word = new
    if word.endswith("и") and len(word) > rv:
        word = word[:-1]
    if (new := _longest(word, r2, _DERIVATIONAL)) is not None:
        word = new
    if word.endswith("нн") and len(word) - 2 >= rv:
        return word[:-1]
    if (new := _longest(word, rv, _SUPERLATIVE)) is not None:
        word = new
        return word[:-1] if word.endswith("нн") and len(word) - 2 >= rv else word
    return word[:-1] if word.endswith("ь") and len(word) > rv else word


def stem_table(tokens: DataFrame) -> DataFrame:
    """(token, stem) of the distinct tokens of a column ``token``: the UDF sees each word form once."""

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(stem)

    return tokens.select("token").distinct().withColumn("stem", stems("token"))
