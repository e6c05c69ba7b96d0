"""The stages of the corpus pipeline on a table with nulls, empty texts, repeated rows and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p

EXTRA = ["score", "rejected", "lang_pred", "_text", "_rejected", "_neardup_key", "_decontam_key", "_mix_key", "_times", "_copy", "row_key", "size", "shard"]
EN, FR = "the cat sat on the mat and looked at the {} bird near the old house by the river", "le chat est assis sur la table et regarde un {} oiseau pres de la vieille maison"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, (EN if i % 2 else FR).format(" ".join(f"w{i}x{j}" for j in range(i % 7 + 20))), "en" if i % 2 else "fr", ["s1", "s2", None][i % 3], 1) for i in range(60)]
    rows += [(100 + i, rows[3][1], "en", "s1", 1) for i in range(5)]  # copies
    rows += [(200, None, "en", "s1", 1), (201, "", "en", "s1", 1), (202, "123 !!", None, None, 1), (None, FR.format(" ".join(f"w77x{j}" for j in range(22))), "fr", "s1", 1)] + [rows[7]] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in EXTRA:
        docs = docs.withColumn(c, F.lit("kept"))
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, rows[10][1])], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in p.STAGES[:-1]:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == before.columns
        assert docs.select(*EXTRA).distinct().collect() == [tuple(["kept"] * len(EXTRA))]
        kept[name] = sorted((r["doc_id"] is None, r["doc_id"]) for r in docs.select("doc_id").collect())
    ids = {k: {i for none, i in v if not none} for k, v in kept.items()}
    assert not ids["language"] & {200, 201, 202} and ids["language"] >= set(range(60))
    assert (True, None) in kept["language"]
    assert (True, None) in kept["near_dedup"]
    assert 3 in ids["near_dedup"]
    assert not ids["near_dedup"] & set(range(100, 105))
    assert kept["near_dedup"].count((False, 7)) == 1
    # those that share 13 words with the benchmark's one item in over a twentieth of their words go
    assert 10 not in ids["decontaminate"] and 3 in ids["decontaminate"]
    last = p.STAGES[-1][1](spark, docs, folder).toPandas()
    assert len(last) == docs.count() and all(sorted(g["slot"]) == list(range(len(g))) for _, g in last.groupby("shard"))


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
