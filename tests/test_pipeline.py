"""The whole pipeline on a small made-up domain."""

import random

import pytest
from pyspark.sql import functions as F

from trovine.pipeline import Config, Pipeline, load
from trovine.sources import io

KINDS = ["ремонт квартир", "уборка дома", "стрижка собак", "перевозка мебели"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('domain')}"
    rng = random.Random(8)
    items = [(f"{k:016x}", f"{KINDS[k % 4]} {k % 7}", f"{KINDS[k % 4]} быстро и недорого", f"Вид услуги {KINDS[k % 4]}", k % 5 + 1, str(50.0 + k % 5), str(40.0 + k % 5), k % 4, 114, 4.5, float(k % 9), 100.0 * k, False, k % 2 == 0) for k in range(120)]
    names = "item_id string, item_title_raw string, item_description_raw string, item_infm_params_text string, item_location_id int, item_latitude string, item_longitude string, item_microcat_id int, item_category_id int, item_rating double, item_rating_reviews_count double, item_price double, item_is_phone_hidden boolean, item_is_message_forbidden boolean"
    rows = []
    for n in range(200):
        k = rng.randrange(120)
        rows.append((f"{KINDS[k % 4]} срочно {n % 60}", 900 if n % 10 == 0 else k % 5 + 1, 0, f"Вид услуги {KINDS[k % 4]}" if n % 3 else None, 114, *items[k]))
    search = "search_query string, search_location_id int, search_is_delivery_search int, search_infm_params_text string, search_category int"
    spark.createDataFrame(items, names).write.parquet(f"{path}/benchmark_items.parquet")
    spark.createDataFrame(rows, f"{search}, {names}").write.parquet(f"{path}/train.parquet")
    queries = [("q1", "ремонт квартир", 2, 0, None, 114), ("q2", "уборка дома", 900, 0, "Вид услуги уборка дома", 114), ("q3", "нечто иное", 3, None, None, 114)]
    spark.createDataFrame(queries, f"query_id string, {search}").write.parquet(f"{path}/benchmark_queries.parquet")
    return path


@pytest.mark.parametrize("scheme", ["meta", "ltr"])
def test_schemes_answer_every_query(spark, folder, scheme, tmp_path):
    data = load(spark, folder)
    out = Pipeline(data, Config(n_cands=40, held=40, models=1, vector_size=256, trees=3)).run(scheme).cache()
    assert {r.query_id: r["count"] for r in out.groupBy("query_id").count().collect()} == {"q1": 40, "q2": 40, "q3": 40}
    top = out.where("rank <= 10").join(data.items.select("item_id", "class", "item_location_id"), "item_id")
    right = {r.query_id: r.n for r in top.where("query_id = 'q1' AND class = '0' OR query_id = 'q2' AND class = '1'").groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert all(right.get(q, 0) >= 6 for q in ("q1", "q2")), right
    found = io.write_answer(out, data.queries, f"file://{tmp_path}/answer", 40, data.items)
    assert not [r for r in found if r.severity == "FAIL"]


def test_unknown_scheme(spark, folder):
    with pytest.raises(ValueError):
        Pipeline(load(spark, folder), Config(n_cands=5, vector_size=64)).run("none")
