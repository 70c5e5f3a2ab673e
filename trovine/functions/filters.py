"""Filter strings without delimiters: ``key value key value``, with a closed list of keys."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import text

# The keys of the filter language, those that matter for matching, and catch-all values.
FILTER_KEYS = (
    "Тип услуги автосервиса", "Вид услуги", "Тип услуги", "Онлайн-запись", "Онлайн-бронирование",
    "Кто оказывает услуги", "Срочная услуга (мультистатус)", "Рейтинг пользователя", "Поиск по слотам",
    "Сортировка для URL", "Где вы оказываете услуги", "Предмет или специальность", "Чем вы занимаетесь",
    "Ваши клиенты", "Специальность или сфера", "Слова в описании", "Услуги", "Услуга",
    "Участие в пилоте CPL", "Аренда авто", "Гарантия", "Коробка передач", "Класс авто",
)
KIND_KEYS, TYPE_KEYS = ("Вид услуги",), ("Тип услуги", "Тип услуги автосервиса")
VALUES_AFTER_CORE = ("Услуги", "Услуга", "Аренда авто")
IGNORED = ("", "Другое")
VALUE_STOPS = ("Место оказания", "Вид услуги", "Тип услуги", "Тип стоимости")
OTHER = "<other>"
PAIRS = "array<struct<key: string, value: string>>"
_MARK, _SEP = "\u0001", "\u0002"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def parse_filters(c: str | Column, keys: Sequence[str] = FILTER_KEYS, core: Sequence[str] = KIND_KEYS + TYPE_KEYS, values: Sequence[str] = VALUES_AFTER_CORE) -> Column:
    """[(key, value)]: the longest key counts, white space or the end follows it; text before the first is of key ``OTHER``.

    A key of ``values`` right after a key of ``core`` is that one's value. In the JVM: the keys are marked and the text is
    split at the marks; then each part joins the part before it, if that is a core key without a value yet, or stands alone.
    """
    pattern = "(" + "|".join(re.escape(k).replace(r"\ ", " ").replace(r"\-", "-") for k in sorted(keys, key=len, reverse=True)) + r")(?=(?U:\s)|$)"
    marked = F.regexp_replace(F.translate(text(c), _MARK + _SEP, "  "), pattern, f"{_MARK}$1{_SEP}")
    parts = F.split(marked, _MARK)
    none = F.array().cast(PAIRS)

    def pair(key: Column, value: Column) -> Column:
        return F.struct(key.alias("key"), value.alias("value"))

    def joined(found: Column, part: Column) -> Column:
        key = F.substring_index(part, _SEP, 1)
        value = F.substring_index(part, _SEP, -1)
        last = F.get(found, F.size(found) - 1)
        is_value = F.coalesce(last["key"].isin(*core) & key.isin(*values) & (strip(last["value"]) == ""), F.lit(False))
        grown = F.concat(F.slice(found, F.lit(1), F.size(found) - 1), F.array(pair(last["key"], F.concat(last["value"], key, value))))
        return F.when(is_value, grown).otherwise(F.concat(found, F.array(pair(key, value))))

    keyed = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), none, joined)
    head = F.when((F.get(parts, F.lit(0)) != "") & ((F.size(parts) > 1) | (strip(text(c)) != "")), F.array(pair(F.lit(OTHER), F.get(parts, F.lit(0))))).otherwise(none)
    return F.transform(F.concat(head, keyed), lambda p: pair(p["key"], strip(p["value"])))


def core_filters(pairs: Column, kind: Sequence[str] = KIND_KEYS, types: Sequence[str] = TYPE_KEYS, ignored: Sequence[str] = IGNORED) -> Column:
    """Map of ``vid`` and ``tip`` to the texts ``key value`` that an item may contain; several values mean any."""

    def of(names: Sequence[str]) -> Column:
        kept = F.filter(pairs, lambda p: p["key"].isin(*names) & ~p["value"].isin(*ignored))
        return F.transform(kept, lambda p: F.concat(p["key"], F.lit(" "), p["value"]))

    return F.create_map(F.lit("vid"), of(kind), F.lit("tip"), of(types))


def filter_match(cands: DataFrame, queries: DataFrame, items: DataFrame, **keys: Sequence[str]) -> DataFrame:
    """Candidates with q_vid, q_tip (the query asks), m_vid, m_tip (the item has it), m_all (all that it asks for).

    ``queries``: query_id, filters (text); ``items``: item_id, params (text).
    """
    asked = queries.select("query_id", core_filters(parse_filters("filters", keys.get("all_keys", FILTER_KEYS)), *(keys[k] for k in ("kind", "types") if k in keys)).alias("_f"))
    both = cands.join(asked, "query_id", "left").join(items.select("item_id", text("params").alias("_p")), "item_id", "left")
    for name in ("vid", "tip"):
        wanted = F.coalesce(F.col("_f")[name], F.array().cast("array<string>"))
        both = both.withColumn(f"q_{name}", F.size(wanted) > 0).withColumn(f"m_{name}", F.exists(wanted, lambda v: F.contains(F.coalesce("_p", F.lit("")), v)))
    any_, all_ = F.col("q_vid") | F.col("q_tip"), (F.col("m_vid") | ~F.col("q_vid")) & (F.col("m_tip") | ~F.col("q_tip"))
    return both.withColumn("m_all", any_ & all_).drop("_f", "_p")


def stated(c: str | Column, key: str, stops: Sequence[str]) -> Column:
    """The value of ``key`` in a parameter text: what follows it up to one of ``stops`` or the end; '' without the key."""
    ends = "|".join(" " + re.escape(x).replace(r"\ ", " ") for x in stops if x != key)
    return F.regexp_extract(text(c), f"{key} (.*?)(?={ends}|$)", 1)


def selectivity(queries: DataFrame, items: DataFrame, kind: str = KIND_KEYS[0], of_type: str = TYPE_KEYS[0], stops: Sequence[str] = VALUE_STOPS) -> DataFrame:
    """query_id, share of ``items`` (item_id, params) that pass the query's core filters; queries without such are left out.

    An item passes if it states one of the asked kinds, where kinds are asked, and one of the asked types, where types
    are. The items are counted by what they state, alone and together, and joined on equal values.
    """
    pairs = parse_filters("filters")

    def asked(key: str) -> Column:
        own = F.filter(pairs, lambda p: (p["key"] == key) & ~p["value"].isin(*IGNORED))
        return F.array_distinct(F.transform(own, lambda p: p["value"]))

    rows = queries.select("query_id", asked(kind).alias("k"), asked(of_type).alias("t")).where("size(k) > 0 OR size(t) > 0")
    one = F.array(F.lit(None).cast("string"))
    rows = rows.select("query_id", F.explode(F.when(F.size("k") > 0, F.col("k")).otherwise(one)).alias("k"), "t")
    rows = rows.select("query_id", "k", F.explode(F.when(F.size("t") > 0, F.col("t")).otherwise(one)).alias("t"))
    cells = items.select(stated("params", kind, stops).alias("k"), stated("params", of_type, stops).alias("t")).cube("k", "t").agg(F.count("*").alias("n"))
    total = cells.where("k IS NULL AND t IS NULL").select(F.col("n").alias("_all"))
    wanted = rows.join(cells.select(F.col("k").alias("_k"), F.col("t").alias("_t"), "n"), F.col("k").eqNullSafe(F.col("_k")) & F.col("t").eqNullSafe(F.col("_t")), "left")
    kept = wanted.groupBy("query_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("kept"))
    return kept.crossJoin(F.broadcast(total)).select("query_id", (F.col("kept") / F.col("_all")).alias("share"))  # one row


def audit(chosen: DataFrame, minimum: int = 1500) -> DataFrame:
    """Per key and value of (filters, params) rows: rows, violations, undeterminable; values with few rows together.

    A row violates a filter if its item states the key with another value; without the key nothing can be said.
    """
    rows = chosen.select(F.explode(parse_filters("filters")).alias("f"), text("params").alias("params")).select("f.key", "f.value", "params").where(F.col("key") != OTHER)
    has = F.contains("params", F.concat("key", F.lit(" "), "value"))
    states = F.contains("params", F.col("key"))
    per = rows.groupBy("key", "value").agg(F.count("*").alias("rows"), F.count_if(states & ~has).alias("violations"), F.count_if(~states).alias("undeterminable"))
    return per.withColumn("value", F.when(F.col("rows") >= minimum, F.col("value")).otherwise(F.lit("<rare>"))).groupBy("key", "value").agg(*(F.sum(c).alias(c) for c in ("rows", "violations", "undeterminable")))
