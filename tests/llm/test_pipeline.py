import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from flowsentry.llm import common, secrets, simhash
from tests.llm.conftest import SF
from tests.llm.test_packing import check
from tests.llm.test_simhash import brute_components, brute_fingerprint


def step(spark, tmp_path, k, docs, sf_dir):
    corpus_pipeline.STAGES[k][1](spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
    return spark.read.parquet(str(tmp_path / str(k)))


def test_stages_on_a_corpus(spark, tmp_path):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(300)]
    toxic = [f"{w} {' '.join(rng.choices(words, k=30))} {w} {w}" for w in ["vile", "nasty"] * 150]
    clean = [" ".join(rng.choices(words, k=60)) for _ in range(300)]
    texts = toxic + clean + clean[:20] + [c + " password=abcdefgh12" for c in clean[20:30]] + [None, "", "unique tail"]
    docs = [(i, t, "en", None if i % 5 == 0 else "hot", len(t) if t is not None else None) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 300), 1) for i in range(600)]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    frame = common.table(spark, str(tmp_path), "documents")

    kept = step(spark, tmp_path, 0, frame, str(tmp_path))
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert kept.columns == corpus_pipeline.COLUMNS and set(rows) == set(range(300, len(texts)))

    single = step(spark, tmp_path, 1, kept, str(tmp_path))
    ids = sorted(rows)
    codes = [brute_fingerprint(rows[i]["text"]) for i in ids]
    least = {}
    for i, g in zip(ids, brute_components(codes, 4)):
        least[g] = min(i, least.get(g, i))
    one = {r["doc_id"]: r for r in single.collect()}
    assert set(one) == set(least.values()) and len(one) < len(ids)

    masked = step(spark, tmp_path, 2, single, str(tmp_path))
    after = {r["doc_id"]: r for r in masked.collect()}
    assert set(after) == set(one) and masked.columns == corpus_pipeline.COLUMNS
    for i, r in after.items():
        assert not secrets.base_spans(r["text"] or "")
        assert r["text"] == one[i]["text"] or "[SECRET]" in r["text"]
    assert check(corpus_pipeline.STAGES[3][1](spark, masked, str(tmp_path)).collect(), [(i, r["text"]) for i, r in after.items()], 2048) == 0


def test_repeated_and_null_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, "x y", None, None, None), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, schema)
    got = corpus_pipeline.simhash_dedup(spark, frame, str(tmp_path)).collect()
    assert sum(r["doc_id"] == 1 for r in got) == 1 and sum(r["doc_id"] is None for r in got) == 2
    # Near copies without a doc_id are one group like others, and give way to a document that has one.
    text = " ".join(f"w{i}" for i in range(200))
    unnamed = [(None, text, "en", s, 5) for s in ("a", "b", "b", None)] + [(None, text + " end", "en", "c", 9)]
    frame2 = spark.createDataFrame([*rows, *unnamed], schema)
    got = corpus_pipeline.simhash_dedup(spark, frame2, str(tmp_path)).collect()
    assert sum(r["doc_id"] is None for r in got) == 3 and sum((r["text"] or "").startswith("w0 ") for r in got) == 1
    got = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame([*rows, *unnamed, (7, text, "en", "z", 1)], schema), str(tmp_path)).collect()
    assert sum(r["doc_id"] is None for r in got) == 2 and sum(r["doc_id"] == 7 for r in got) == 1
    assert corpus_pipeline.simhash_dedup(spark, frame.limit(0), str(tmp_path)).collect() == []
    assert corpus_pipeline.secret_scan(spark, frame, str(tmp_path)).count() == 4


def test_registered_queries(spark):
    names = set(entry_points.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_run_over_the_test_table(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fill = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("top"))
    assert fill.where("n <> top or n > 2048").count() == 0
    dedup = simhash.near_duplicates(common.table(spark, SF, "documents")).select("component_id").distinct().count()
    assert got.select("doc_id").distinct().count() == pytest.approx(dedup, rel=0.2)
