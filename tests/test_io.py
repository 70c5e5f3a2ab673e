"""Sources, sinks, increments, the registry and the entry points."""

import importlib
import sys

import pytest
from pyspark.sql import functions as F

from trovine.plans import registry
from trovine.sources import io
from trovine.streaming import incremental


def test_projection_reaches_the_scan(spark, sf):
    ids = spark.createDataFrame([(1,), (2,)], "p_partkey long")
    df = io.read(spark, f"{sf}/part.parquet", ["p_partkey", "p_name"], ids, "p_partkey")
    assert df.count() == 2 and "ReadSchema: struct<p_partkey:bigint,p_name:string>" in df._jdf.queryExecution().executedPlan().toString()


def test_coordinates_and_strings(spark, tmp_path):
    df = spark.createDataFrame([("1.5", "x"), (None, "2")], "item_latitude string, item_longitude string")
    assert [(r.lat, r.lon) for r in io.coordinates(df).collect()] == [(1.5, None), (None, 2.0)]
    (tmp_path / "a.csv").write_text("query_id,answer\n001,\n002,a b\n")
    assert sorted(map(tuple, io.read_strings(spark, f"file://{tmp_path}/a.csv", ["query_id", "answer"]).collect())) == [("001", ""), ("002", "a b")]


def test_answers_and_csv(spark, tmp_path):
    cands = spark.createDataFrame([("q2", "b" * 16, 0.5, 2), ("q2", "a" * 16, 0.9, 1)], "query_id string, item_id string, score double, rank int")
    queries = spark.createDataFrame([("q1",), ("q2",)], "query_id string")
    assert dict(io.answers(cands, queries).collect()) == {"q1": "", "q2": "a" * 16 + " " + "b" * 16}
    io.write_answer(cands, queries, f"file://{tmp_path}/out")
    assert dict(map(tuple, io.read_strings(spark, f"file://{tmp_path}/out", ["query_id", "answer"]).collect()))["q2"] == "a" * 16 + " " + "b" * 16
    io.write_candidates(cands, f"file://{tmp_path}/c")
    assert spark.read.parquet(f"file://{tmp_path}/c").dtypes == [("query_id", "string"), ("item_id", "string"), ("score", "float"), ("rank", "int")]


def test_resumed_write_adds_only_new_keys(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    assert io.resume_write(spark.range(10), path, "id") == 10
    assert io.resume_write(spark.range(15), path, "id") == 5
    assert io.resume_write(spark.range(15), path, "id") == 0


def test_cache_by_parameters(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for part in (1, 1, 2):
        assert io.cached(spark, f"file://{tmp_path}", ["x", part], build).count() == 3
    assert len(built) == 2


def test_vectors_are_checked(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "item_id long, vector array<float>").write.parquet(path)
    with pytest.raises(ValueError):
        io.read_vectors(spark, path, 2)


def test_timings_and_report(spark, tmp_path):
    t = io.Timings()
    with t.step("a"):
        pass
    with t.step("a"):
        pass
    assert list(t.steps) == ["a"]
    io.write_report(spark.range(2), f"file://{tmp_path}/r", k=1)
    assert spark.read.text(f"file://{tmp_path}/r.config").first().value == '{"k": 1}'


def test_split_and_sample(spark):
    log = spark.createDataFrame([(k, k % 5) for k in range(50)], "row_id int, query_key int")
    out = io.split(log, spark.createDataFrame([(3,), (1,), (2,)], "query_id int"), spark.createDataFrame([(4,)], "query_key int"), 2)
    assert out["train_fit"].count() == 40 and sorted(r.query_id for r in out["queries"].collect()) == [1, 2]
    small, large = (io.sample_by_key(log, "row_id", n) for n in (100, 500))
    assert small.join(large, "row_id", "left_anti").count() == 0


def test_new_files_are_processed_once(spark, tmp_path):
    src, sink, cp = (f"file://{tmp_path}/{x}" for x in ("src", "sink", "cp"))
    spark.range(5).write.parquet(src)
    schema = spark.range(1).schema
    step = lambda df: df.withColumn("y", F.col("id") * 2)
    assert incremental.process_new_files(spark, src, sink, cp, step, schema) == 5
    assert incremental.process_new_files(spark, src, sink, cp, step, schema) == 0
    spark.range(5, 8).write.mode("append").parquet(src)
    assert incremental.process_new_files(spark, src, sink, cp, step, schema) == 3
    assert spark.read.parquet(sink).count() == 8


def test_score_new(spark):
    pairs = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, item_id string")
    done = spark.createDataFrame([("q", "a", 1.0)], "query_id string, item_id string, ce double")
    got = incremental.score_new(pairs, done, lambda df: df.withColumn("ce", F.lit(9.0)))
    assert {r.item_id: r.ce for r in got.collect()} == {"a": 1.0, "b": 9.0}


def test_registry_and_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 150 and len(sql) >= 0.85 * len(registry.queries())
    df = entry.entry(spark)
    assert df.columns == ["query_id", "item_id", "score", "rank"] and df.limit(1).count() == 1


def test_library_does_not_import_the_preparation_package():
    code = "import sys, trovine.plans.registry as r; r.queries(); sys.exit(any(m.startswith('trovine.llm') for m in sys.modules))"
    import subprocess
    from pathlib import Path

    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=False).returncode == 0


def test_a_saved_split_comes_back(spark, tmp_path):
    log = spark.createDataFrame([(f"k{n % 4}", n) for n in range(12)], "query_key string, row_id int")
    keys = spark.createDataFrame([("k1",), ("k3",)], "query_key string")
    held = log.join(keys, "query_key", "left_semi")
    io.save_split(f"file://{tmp_path}/s", held.select("query_key").distinct(), held, held.select("row_id"), keys)
    got = io.load_split(spark, f"file://{tmp_path}/s", log)
    assert set(got) == {*io.SPLIT, "train_fit"} and {r.query_key for r in got["train_fit"].collect()} == {"k0", "k2"} and got["mask"].count() == 6


def test_timings_and_stubs():
    from trovine.operators import rerank as R

    t = io.Timings()
    with t.step("a"):
        pass
    assert t.steps["a"] >= 0 and t.memory["a"] > 1
    for stub in (R.apply_cross_encoder, R.apply_extra_dense):
        with pytest.raises(NotImplementedError):
            stub()
