"""Every operator and stage on nulls, empty and very long texts, repeated rows, clashing names and empty tables."""

from collections import Counter

import pytest

from trovine.llm import chat_format, decontaminate, html_extract, mixing, near_dedup, pii, quality_rules, sharding, substring_dedup, token_count
from trovine.llm import queries as Q

LONG = " ".join(f"w{k % 5000}" for k in range(120_000))
ROWS = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (3, ""), (4, " \n\t "), (None, "a text without id"), (None, None), (5, LONG), (6, LONG)]
#: Names that operators use inside or return.
CLASH = ["component_id", "kept", "id", "key", "item_ids", "digest", "shard", "block", "position", "epoch", "n_words", "n_tokens", "stratum", "_row", "_w", "_t", "title", "at"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en" if d else None, "s" if d != 3 else None, None, *["x"] * len(CLASH)) for d, t in ROWS], SCHEMA).repartition(2)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "two three four five six"), (None, "x"), (2, None), (3, "")], "item_id long, text string")


OPERATORS = {
    "quality_rules": lambda d, labels, bench, path: quality_rules.quality_rules(d, labels, "lang"),
    "pii": lambda d, labels, bench, path: pii.pseudonymise(d, b"k"),
    "near_dedup": lambda d, labels, bench, path: near_dedup.near_duplicates(d),
    "mixing": lambda d, labels, bench, path: mixing.schedule(mixing.token_sizes(d), entropy=0.9),
    "token_count": lambda d, labels, bench, path: token_count.count_tokens(d, Q.tokenizer_file("byte_bpe_50k.json")),
    "substring_dedup": lambda d, labels, bench, path: substring_dedup.remove_repeats(d),
    "decontaminate": lambda d, labels, bench, path: decontaminate.find_benchmark(d, bench),
    "sharding": lambda d, labels, bench, path: sharding.shard_documents(d, path),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(docs, labels, bench, tmp_path, name):
    got = OPERATORS[name](docs, labels, bench, f"file://{tmp_path}/s").collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in ROWS)
    if name == "decontaminate":
        assert {r.doc_id for r in got if r.contaminated} == {1}
    if name == "near_dedup":
        assert {(r.doc_id, r.component_id) for r in got if r.doc_id} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5)}
    if name == "substring_dedup":
        assert {(r.doc_id, r.n_removed > 0) for r in got if r.doc_id} == {(1, False), (2, False), (3, False), (4, False), (5, True), (6, True)}


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_no_rows(docs, labels, bench, tmp_path, name):
    full = OPERATORS[name](docs, labels, bench, f"file://{tmp_path}/a")
    empty = OPERATORS[name](docs.where("false"), labels.where("false"), bench.where("false"), f"file://{tmp_path}/b")
    assert empty.count() == 0 and empty.columns == full.columns


def test_stages_keep_columns_and_rows(spark, docs, labels, bench, tmp_path):
    import corpus_pipeline as P

    folder = f"{tmp_path}/t"
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns and stage(spark, docs.where("false"), folder).count() == 0, name
    kept = {name: Counter(r.doc_id for r in stage(spark, docs, folder).collect()) for name, stage in P.STAGES[:-1]}
    assert kept["near_dedup"] == Counter({1: 2, 2: 1, 3: 1, 4: 1, 5: 1, None: 2})
    assert kept["decontaminate"] == Counter({2: 1, 3: 1, 4: 1, 5: 1, 6: 1, None: 2}) and kept["mix"] == Counter(d for d, _ in ROWS)
    assert set(kept["quality"]) <= {5, 6, None}
    assert P.run(spark, folder).count() >= 1


def test_pages_and_chats_without_rows(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert html_extract.extract_pages(pages).count() == 0 and chat_format.format_chats(chats, spark.sql(Q.SCHEMAS)).count() == 0
