"""Location maps, pool rules and cities named in queries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import EARTH_KM, haversine, seeded_order
from ..functions.text import text, word_runs

# The rule names of the catalogue and the id that stands for the whole country.
REGION_RULES = ("R1", "R2_0.003", "R2_0.01", "R2_0.02", "R2_0.05", "R2t_0.01", "R32_0.01", "R3", "R4a", "R4b", "R3_4b", "R5", "RSOFT_0.005", "RSOFT_0.01", "RSOFT_0.02", "RSOFT_0.03", "RSOFT_0.05")
CITY_RULES = ("C1_30", "C1_100", "C2", "C2s", "C3", "C3s", "C4", "C4all", "SOFT_0.003", "SOFT_0.006", "SOFT_0.01", "SOFT_0.015", "SOFT_0.02", "SOFT_0.03")
RULES = ("C0R0", *REGION_RULES, *CITY_RULES)
COUNTRY = 621540
# Endings of inflected city names, and everyday names of cities.
ENDINGS = ("", "а", "е", "у", "ом", "ым", "ой", "и", "ы", "ах", "ам", "ского", "ском", "ской", "ске")
ALIASES = {"спб": "санкт-петербург", "питер": "санкт-петербург", "мск": "москва", "екб": "екатеринбург", "нск": "новосибирск", "нижний": "нижний новгород"}
# Big cities, known with or without items there, and city names that are common words of services.
BIG_CITIES = (
    "москва", "санкт-петербург", "новосибирск", "екатеринбург", "казань", "нижний новгород", "челябинск",
    "самара", "омск", "ростов-на-дону", "уфа", "красноярск", "воронеж", "пермь", "волгоград", "краснодар",
    "саратов", "тюмень", "тольятти", "ижевск", "барнаул", "ульяновск", "иркутск", "хабаровск", "ярославль",
    "владивосток", "махачкала", "томск", "оренбург", "кемерово", "сочи", "тбилиси", "владикавказ", "минск",
)
STOP_NAMES = (
    "мирный", "белый", "вывоз", "ремонт", "свобода", "мир", "октябрьский", "советский", "заречный",
    "новый", "лесной", "пушкин", "луч", "бор", "радужный", "победа", "северный", "южный", "центральный",
    "восточный", "западный", "кировский", "первомайский", "ленинский", "московский", "раменское",
    "дружба", "звездный", "солнечный", "садовый", "полевой", "зеленый", "степной", "берег", "озерный",
)
# Where an address ends, and words of regions and of streets; the names found depend on them.
PLACE = r"Место оказания услуг (.+?)(?: Тип | Вид | Как вы | Работаете | Опыт | Где вы | Кто | График |  Время | Специальность | Гарантия | Начальная | Куда | Услуга | Стоимость |$)"
REGION_WORDS = r"(?iu)(область|край|республик|округ|район|р-н|ао$|автономн)"
STREET_WORDS = (
    r"(?iu)(^ул\.|улица|пр-т|проспект|пер\.|переулок|шоссе|ш\.|бульвар|б-р|наб\.|набережная|площадь|пл\.|мкр|микрорайон|проезд|\d|тупик|аллея|снт|тсн|днт|"
    r"товарищество|посёлок|поселок|пос\.|жилой комплекс|жк|территория|квартал|станица|село|деревня|тер\.|линия)"
)
DEFAULTS = {"city": "SOFT_0.015", "region": "RSOFT_0.02", "country": "RSOFT_0.005"}


def regions(searches: DataFrame, items: DataFrame) -> DataFrame:
    """Search locations that no item has: regions (search_location_id)."""
    return searches.select("search_location_id").distinct().join(items.select(F.col("item_location_id").alias("search_location_id")).distinct(), "search_location_id", "left_anti")


def centroids(items: DataFrame) -> DataFrame:
    """Exact median coordinates and number of distinct items per location (item_id, item_location_id, lat, lon).

    Of an item with several rows that with the least location, latitude and longitude counts.
    """
    least = items.groupBy("item_id").agg(F.min(F.struct("item_location_id", "lat", "lon")).alias("x")).select("item_id", "x.*")
    return least.groupBy("item_location_id").agg(F.median("lat").alias("clat"), F.median("lon").alias("clon"), F.count("*").alias("n_items"))


def pair_share(log: DataFrame) -> DataFrame:
    """(search_location_id, item_location_id, n, share of the search location's rows)."""
    n = log.groupBy("search_location_id", "item_location_id").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("search_location_id")))


def region_map(log: DataFrame, region_ids: DataFrame, items: DataFrame) -> DataFrame:
    """Shares of regions' rows by item location. Locations without items go after the shares are taken."""
    shares = pair_share(log.join(region_ids, "search_location_id", "left_semi"))
    return shares.join(items.select("item_location_id").distinct(), "item_location_id", "left_semi")


def city_pairs(log: DataFrame, region_ids: DataFrame, items: DataFrame, least: float = 0.0) -> DataFrame:
    """Shares of cities' rows by other item locations; own city and absent locations go after the shares are taken."""
    shares = pair_share(log.join(region_ids, "search_location_id", "left_anti")).where(F.col("search_location_id") != F.col("item_location_id"))
    return shares.join(items.select("item_location_id").distinct(), "item_location_id", "left_semi").where(F.col("share") >= least)


def main_city(shares: DataFrame) -> DataFrame:
    """The location with the largest share; the smaller id of equals."""
    return shares.groupBy("search_location_id").agg(F.max_by("item_location_id", F.struct("share", -F.col("item_location_id"))).alias("main_city"))


def neighbours(cent: DataFrame, km: float, origins: DataFrame | None = None) -> DataFrame:
    """Pairs of locations within ``km`` (inclusive): (loc, near, km), without the location itself.

    Locations are joined on cells of a latitude band, and within it of a longitude band as wide as the radius is at the
    band's far edge; so the join is on keys, not a cross product.
    """
    step = max(km / (EARTH_KM * 3.141592653589793 / 180), 1e-6) * 1.0001
    points = cent.where("clat IS NOT NULL AND clon IS NOT NULL").select(F.col("item_location_id").alias("near"), "clat", "clon", F.floor(F.col("clat") / step).alias("band"))
    start = (origins if origins is not None else cent).where("clat IS NOT NULL AND clon IS NOT NULL").select(F.col("item_location_id").alias("loc"), F.col("clat").alias("lat0"), F.col("clon").alias("lon0"))
    start = start.withColumn("band", F.explode(F.transform(F.array(*(F.lit(d) for d in (-1, 0, 1))), lambda d: F.floor(F.col("lat0") / step) + d)))
    edge = F.least(F.greatest(F.abs(F.col("band") * step), F.abs((F.col("band") + 1) * step)), F.lit(89.9))
    # Near the poles and for wide radii a single cell takes the whole band.
    cells = F.floor(F.lit(360.0) / (F.lit(step) / F.cos(F.radians(edge))))
    cells = F.when(cells < 3, F.lit(1)).otherwise(cells)

    def cell(lon: Column) -> Column:
        return F.pmod(F.floor((lon + 180) / (F.lit(360.0) / cells)), cells)

    points = points.withColumn("cell", cell(F.col("clon")))
    start = start.withColumn("cell", F.explode(F.array_distinct(F.transform(F.array(*(F.lit(d) for d in (-1, 0, 1))), lambda d: F.pmod(cell(F.col("lon0")) + d, cells)))))
    found = start.join(points, ["band", "cell"]).withColumn("km", haversine(F.col("lat0"), F.col("lon0"), F.col("clat"), F.col("clon")))
    return found.where((F.col("km") <= km) & (F.col("loc") != F.col("near"))).select("loc", "near", "km")


def classify(location: Column, is_region: Column, rules: dict[str, str] = DEFAULTS, country: int = COUNTRY) -> Column:
    """Which rule a query gets: country, region or city."""
    return F.when(location == country, rules["country"]).when(is_region, rules["region"]).otherwise(rules["city"])


def base_rule(rule: str) -> str:
    """The pool that a soft rule searches in."""
    return "R1" if rule.startswith("RSOFT") else "C4" if rule.startswith("SOFT") else rule


def pool(rule: str, searches: DataFrame, region_ids: DataFrame, region_shares: DataFrame, pairs: DataFrame, cent: DataFrame, items: DataFrame) -> DataFrame:
    """(search_location_id[, named], item_location_id, tier) of a rule; tiers are disjoint, the lowest counts.

    ``searches``: search_location_id and, for the rules with a city named in the query, named (nullable). Only locations
    with items are in a pool.
    """
    keys = ["search_location_id"] + (["named"] if "named" in searches.columns else [])
    places = searches.select(*keys).distinct()
    city, region = places.join(region_ids, "search_location_id", "left_anti"), places.join(region_ids, "search_location_id", "left_semi")

    def own(tier: int = 0) -> DataFrame:
        return city.select(*keys, F.col("search_location_id").alias("item_location_id"), F.lit(tier).alias("tier"))

    def shares(low: float, tier: int = 0, high: float = 2.0) -> DataFrame:
        return region.join(region_shares.where((F.col("share") >= low) & (F.col("share") < high)), "search_location_id").select(*keys, "item_location_id", F.lit(tier).alias("tier"))

    def named(tier: int = 0) -> DataFrame:
        if "named" not in keys:
            raise ValueError(f"{rule} needs the column named")
        return region.where("named IS NOT NULL").select(*keys, F.col("named").alias("item_location_id"), F.lit(tier).alias("tier"))

    def near(km: float, tier: int) -> DataFrame:
        start = cent.join(city.select(F.col("search_location_id").alias("item_location_id")).distinct(), "item_location_id", "left_semi")
        return city.join(neighbours(cent, km, start), city.search_location_id == F.col("loc")).select(*keys, F.col("near").alias("item_location_id"), F.lit(tier).alias("tier"))

    def paired(least: float, tier: int) -> DataFrame:
        return city.join(pairs.where(F.col("share") >= least), "search_location_id").select(*keys, "item_location_id", F.lit(tier).alias("tier"))

    def by_share(first: int) -> list[DataFrame]:
        return [shares(0.1, first), shares(0.01, first + 1, 0.1), shares(0.0, first + 2, 0.01)]

    name, _, number = base_rule(rule).partition("_")
    least = float(number) if re.fullmatch(r"[\d.]+", number) else 0.0
    ranked = region_shares.withColumn("_r", F.row_number().over(Window.partitionBy("search_location_id").orderBy(F.desc("share"), "item_location_id")))
    if base_rule(rule) == "R3_4b":
        parts = [own(), named(), *by_share(1)]
    elif name in ("R1", "R2", "R3", "R4a", "R4b", "R5", "R2t", "R32"):
        parts = [own()] + {
            "R1": lambda: [shares(0.0)],
            "R2": lambda: [shares(least)],
            "R2t": lambda: [shares(least), shares(0.0, 1)],
            "R3": lambda: [named(), shares(0.0, 1)],
            "R32": lambda: [named(), shares(least, 1)],
            "R4a": lambda: [region.join(ranked, "search_location_id").select(*keys, "item_location_id", F.when(F.col("_r") == 1, 0).otherwise(1).alias("tier"))],
            "R4b": lambda: by_share(0),
            "R5": lambda: [named()],
        }[name]()
    else:
        parts = {
            "C0R0": lambda: [own()],
            "C1": lambda: [own(), near(least, 1)],
            "C2": lambda: [own(), paired(0.0, 1)],
            "C2s": lambda: [own(), paired(0.01, 1)],
            "C3": lambda: [own(), near(100, 1), paired(0.0, 1)],
            "C3s": lambda: [own(), near(100, 1), paired(0.01, 1)],
            "C4": lambda: [own(), near(100, 0), paired(0.01, 0)],
            "C4all": lambda: [own(), near(100, 0), paired(0.0, 0)],
        }[name]()
    rows = reduce(DataFrame.unionByName, parts).groupBy(*keys, "item_location_id").agg(F.min("tier").alias("tier"))
    return rows.join(items.select("item_location_id").distinct(), "item_location_id", "left_semi").select(*keys, "item_location_id", "tier")


def soft_bonus(rule: str, searches: DataFrame, region_ids: DataFrame, region_shares: DataFrame) -> DataFrame:
    """(search_location_id, item_location_id, bonus): SOFT_w for the own city, RSOFT_w for cities of 1 % and more."""
    name, _, w = rule.partition("_")
    places = searches.select("search_location_id").distinct()
    if name == "SOFT":
        return places.join(region_ids, "search_location_id", "left_anti").select("search_location_id", F.col("search_location_id").alias("item_location_id"), F.lit(float(w)).alias("bonus"))
    if name == "RSOFT":
        return places.join(region_shares.where("share >= 0.01"), "search_location_id").select("search_location_id", "item_location_id", F.lit(float(w)).alias("bonus"))
    return places.select("search_location_id", F.col("search_location_id").alias("item_location_id"), F.lit(0.0).alias("bonus")).where("false")


def pool_rows(queries: DataFrame, pool_df: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, item_id, tier): the items of a query's pool."""
    return queries.select("query_id", "search_location_id").join(pool_df, "search_location_id").join(items.select("item_id", "item_location_id"), "item_location_id").select("query_id", "item_id", "tier")


def pool_sizes(queries: DataFrame, pool_df: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, n, low): how many rows ``pool_rows`` has for a query, and their lowest tier; queries without any are left out.

    Items are counted by place and the counts added by search location, so no (query, item) pair is made.
    """
    per_place = items.groupBy("item_location_id").agg(F.count("*").alias("n"))
    per_search = pool_df.join(per_place, "item_location_id").groupBy("search_location_id").agg(F.sum("n").alias("n"), F.min("tier").alias("low"))
    return queries.select("query_id", "search_location_id").join(per_search, "search_location_id").groupBy("query_id").agg(F.sum("n").alias("n"), F.min("low").alias("low"))


def address_parts(params: str | Column) -> Column:
    """City-like parts of an address in a parameter text: no regions, streets, numbers; 4 to 30 letters."""
    found = F.regexp_extract(text(params), PLACE, 1)
    parts = F.transform(F.split(found, ","), lambda p: F.trim(p))
    kept = F.filter(parts, lambda p: ~p.rlike(REGION_WORDS) & ~p.rlike(STREET_WORDS) & F.length(p).between(4, 30))
    return F.transform(kept, lambda p: F.translate(F.lower(p), "ё", "е"))


def city_names(items: DataFrame, cent: DataFrame, rows: int = 5, share: float = 0.2, big: tuple[str, ...] = BIG_CITIES) -> DataFrame:
    """(name, item_location_id): the most frequent address part of each location with enough support; of locations with
    one name, that with more items. Names of ``big`` cities that no location has are there without a location."""
    parts = items.select("item_location_id", F.explode(address_parts("params")).alias("name")).groupBy("item_location_id", "name").agg(F.count("*").alias("k"))
    w = Window.partitionBy("item_location_id")
    best = parts.withColumn("total", F.sum("k").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("k"), "name"))).where("_r = 1")
    best = best.where((F.col("k") >= rows) & (F.col("k") >= share * F.col("total"))).join(cent.select("item_location_id", "n_items"), "item_location_id", "left")
    found = best.groupBy("name").agg(F.max_by("item_location_id", F.struct(F.coalesce("n_items", F.lit(0)), -F.col("item_location_id"))).alias("item_location_id"))
    if not big:
        return found
    extra = items.sparkSession.createDataFrame([(b,) for b in big], "name string").join(found, "name", "left_anti")
    return found.unionByName(extra.withColumn("item_location_id", F.lit(None).cast(found.schema["item_location_id"].dataType)))


def city_forms(names: DataFrame, aliases: dict[str, str] = ALIASES, stop: tuple[str, ...] = STOP_NAMES) -> DataFrame:
    """(form, name, multi): inflected forms of one-word names, whole names of several words, and aliases."""
    kept = names.select("name").where(~F.col("name").isin(*stop)) if stop else names.select("name")
    multi = F.col("name").rlike("[ -]")
    stem = F.when(F.col("name").rlike("[аеиоуыяьй]$") & (F.length("name") >= 5), F.expr("substr(name, 1, length(name) - 1)")).otherwise(F.col("name"))
    forms = kept.where(~multi & (F.length("name") >= 4)).select("name", F.explode(F.array_union(F.transform(F.array(*map(F.lit, ENDINGS)), lambda e: F.concat(stem, e)), F.array("name"))).alias("form"))
    forms = forms.groupBy("form").agg(F.min("name").alias("name")).withColumn("multi", F.lit(False))
    whole = kept.where(multi).select(F.col("name").alias("form"), "name", F.lit(True).alias("multi"))
    known = names.sparkSession.createDataFrame([(a, n, False) for a, n in aliases.items()], "form string, name string, multi boolean")
    return known.unionByName(forms.join(known.select("form"), "form", "left_anti")).unionByName(whole)


def named_city(queries: DataFrame, forms: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """(query_id, name): the city a query names: a name of several words first (the longest), else the earliest word.

    The query's runs of as many words as the longest form has are joined with the forms; nothing is compared pairwise.
    """
    words = F.regexp_extract_all(F.translate(F.lower(text("search_query")), "ё", "е"), F.lit(r"[а-яa-z\-]+"), F.lit(0))
    rows = queries.select("query_id", words.alias("w"))
    longest = forms.agg(F.max(F.size(F.split("form", " ")))).first()[0] or 1
    runs = [rows.select("query_id", F.posexplode(word_runs(F.col("w"), n)).alias("at", "form")) for n in range(1, longest + 1)]
    found = reduce(DataFrame.unionByName, runs).join(forms, "form")
    order = Window.partitionBy("query_id").orderBy(F.desc("multi"), F.when(F.col("multi"), -F.length("form")).otherwise(F.lit(0)), "at", "form")
    best = found.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("query_id", "name")
    return best.join(bad.select("name"), "name", "left_anti") if bad is not None else best


def unreliable_names(named: DataFrame, log: DataFrame, names: DataFrame, cent: DataFrame, km: float = 100, rows: int = 5, near: float = 0.2) -> DataFrame:
    """Names that are seldom near what was chosen: (name). ``log``: query_id, lat, lon of the chosen item."""
    at = names.join(cent.select("item_location_id", "clat", "clon"), "item_location_id", "left").select("name", "clat", "clon")
    dist = log.join(named, "query_id").join(at, "name", "left").withColumn("km", haversine(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")))
    stats = dist.groupBy("name").agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("km") < km, F.lit(False)).cast("int")).alias("share"))
    return stats.where((F.col("n") >= rows) & (F.col("share") < near)).select("name")


def filter_loss(log: DataFrame, pairs: DataFrame, km: float = 100) -> DataFrame:
    """What a hard filter would lose, one row: share of rows in the own city, within ``km`` of it, or in a known pair.

    ``log``: search_location_id, item_location_id, km (distance, nullable).
    """
    known = pairs.select("search_location_id", "item_location_id", F.lit(True).alias("paired"))
    rows = log.join(known, ["search_location_id", "item_location_id"], "left")
    own, close = F.col("search_location_id") == F.col("item_location_id"), F.coalesce(F.col("km") <= km, F.lit(False))
    pair = F.col("paired").isNotNull()
    return rows.agg(*(F.avg((~c).cast("int")).alias(n) for n, c in (("exact", own), ("radius", own | close), ("pair_map", own | pair), ("all", own | close | pair))))


def filter_loss_split(log: DataFrame, region_ids: DataFrame, items: DataFrame, key: str = "query_key", least: float = 0.01, km: float = 100, seed: int = 5) -> DataFrame:
    """``filter_loss`` with a pair map learned on one half of the keys (by MD5) and applied to the other: half, n and the
    shares lost, a row for each half. A map that is tested on what it has learned from looks better than it is."""
    half = F.conv(F.substring(seeded_order(key, seed=seed), 1, 6), 16, 10).cast("long") % 2
    rows, out = log.withColumn("_half", half), []
    for k in (0, 1):
        own = rows.where(F.col("_half") == k)
        loss = filter_loss(own, city_pairs(rows.where(F.col("_half") != k), region_ids, items, least), km)
        out.append(loss.crossJoin(own.agg(F.count("*").alias("n"))).select(F.lit(k).alias("half"), "n", *loss.columns))  # one row each
    return reduce(DataFrame.unionByName, out)


def source_recall(pool_items: DataFrame, labels: DataFrame, sources: dict[str, DataFrame], k: int = 300) -> DataFrame:
    """(source, answers, answers_in_pool, recall, recall_in_pool): of each source's first ``k``, the share of all labels
    and of those in the pool that it has."""
    own = labels.select("query_id", "item_id").distinct().join(pool_items.select("query_id", "item_id").distinct().withColumn("_in", F.lit(1)), ["query_id", "item_id"], "left")
    out = []
    for name, cands in sources.items():
        hit = own.join(cands.where(F.col("rank") <= k).select("query_id", "item_id").distinct().withColumn("_hit", F.lit(1)), ["query_id", "item_id"], "left")
        found = F.coalesce(F.col("_hit"), F.lit(0))
        out.append(hit.agg(F.lit(name).alias("source"), F.count("*").alias("answers"), F.count("_in").alias("answers_in_pool"), F.avg(found).alias("recall"), F.avg(F.when(F.col("_in") == 1, found)).alias("recall_in_pool")))
    return reduce(DataFrame.unionByName, out)


def pool_report(queries: DataFrame, pool_df: DataFrame, items: DataFrame, labels: DataFrame) -> DataFrame:
    """Per query: pool size, and the share of its labels that are in the pool. Only labelled pairs are looked up in it."""
    size = pool_sizes(queries, pool_df, items).select("query_id", F.col("n").alias("pool_size"))
    own = labels.join(queries.select("query_id", "search_location_id").distinct(), "query_id").join(items.select("item_id", "item_location_id").distinct(), "item_id")
    inside = own.join(pool_df, ["search_location_id", "item_location_id"], "left_semi").select("query_id", "item_id").distinct().withColumn("_in", F.lit(1))
    hit = labels.join(inside, ["query_id", "item_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("_in", F.lit(0))).alias("answers_in_pool"))
    return queries.select("query_id").distinct().join(size, "query_id", "left").join(hit, "query_id", "left").select("query_id", F.coalesce("pool_size", F.lit(0)).alias("pool_size"), "answers_in_pool")
