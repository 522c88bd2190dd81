"""The pipeline's stages, each judged on its own input against plain versions."""

import cases
import corpus_pipeline
from pyspark.sql import functions as F

from tidewatch.llm import quality

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        out = stage(spark, docs, FOLDER)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = [r.doc_id for r in docs.collect()]
        if name == "quality":
            scores = {r.doc_id: r.score for r in quality.classify(spark.createDataFrame([(i, t) for i, t, _ in before], "doc_id long, text string"), spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()}
            assert sorted(after) == sorted(i for i, s in scores.items() if s >= quality.THRESHOLD) and 0 < len(after) < len(before)
        if name == "near_duplicates":
            sets = {i: frozenset(cases.shingles(t, 5)) for i, t, _ in before}
            for i in set(sets) - set(after):  # what goes has a like text with it or before it
                assert any(len(sets[i] & s) >= 0.8 * len(sets[i] | s) for j, s in sets.items() if j != i)
            left = [sets[i] for i in after]
            assert sum(len(x & y) >= 0.8 * len(x | y) for k, x in enumerate(left) for y in left[k + 1 :]) <= 1
            assert len(after) < len(before)
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
            kept = [i for (i, *_), (n, hit, _) in zip(before, cases.contamination(before, items), strict=True) if not (hit and 20 * hit >= n)]
            assert sorted(after) == sorted(kept) and len(kept) < len(before)
        if name == "mix":
            size, target = cases.targets(before)
            taken = docs.groupBy("source").agg(F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))).alias("n")).collect()
            assert all(abs(r.n - target[r.source]) <= 0.05 * target[r.source] + 20 for r in taken)
        if name == "shards":
            assert sorted(after) == sorted(i for i, *_ in before) and docs.agg(F.max("shard")).first()[0] == 15
    assert sorted(map(str, corpus_pipeline.run(spark, FOLDER).select("doc_id", "size").collect())) == sorted(map(str, docs.select("doc_id", "size").collect()))


def test_odd_and_empty_documents(spark):
    for docs in (cases.documents(spark), cases.empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            assert name == "shards" or out.columns == docs.columns
            out.collect()
