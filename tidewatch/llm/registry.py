"""The thin queries over the sample tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, licenses, media, mixing, negatives, periodic, quality, repeats, sharding, simhash, tokens, toxicity, urls
from .common import crc32_of_id


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.media_features(_read(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.tokenise(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("spans")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents")).drop("places")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages")).drop("listed")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    rows = rows.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), "embedding")
    return negatives.mine(rows, rows.where(F.col("vec_id") % 50 == 0))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``documents``; by the crc32 of its id, a tenth of them goes on with words that repeat. A null id has none."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \x09-\x0D]+"), lambda w: w != "")
    h = crc32_of_id(F.col("doc_id"))
    g = F.floor(h / 10).cast("long")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
        # n and a are bound once: an expression in a lambda is computed at every call
        places = F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda k: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < k["a"], i).otherwise(k["a"] + F.pmod(i - k["a"], k["p"]))))[0]
        return F.array_join(F.transform(places, lambda i: F.get(w, i.cast("int"))), " ")

    text = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))[0]
    planted = F.col("doc_id").isNotNull() & (F.pmod(h, F.lit(10)) == 0)
    return docs.select("doc_id", F.when(planted, text).otherwise(F.col("text")).alias("text"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(_with_planted_runs(_read(spark, sf_dir, "documents")))
    # greater length/period first; products of whole numbers, no quotient
    first = F.expr("""array_sort(runs, (x, y) -> CASE
        WHEN x.length * y.period <> y.length * x.period THEN IF(x.length * y.period > y.length * x.period, -1, 1)
        WHEN x.start <> y.start THEN IF(x.start < y.start, -1, 1)
        ELSE IF(x.period < y.period, -1, IF(x.period > y.period, 1, 0)) END)""")
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.withColumn("most", F.get(first, F.lit(0)))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"most.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * most.length) div most.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_media, op2_tokens, op3_decontaminate, op4_quality, op5_sharding, op6_licenses, op7_simhash, op8_toxicity, op9_mixing, op10_urls, op11_negatives, op12_periodic, op13_repeats, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Queries whose whole result SQL can state; the others are tested against brute force in ``tests/llm``."""
    when = "\n".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{{}}}}'".replace("{{}}", f"{h}{p}|{v}")
        for h, p, v in sorted(urls.RULES, key=lambda r: -(len(r[0]) + len(r[1])))
    )
    return {
        "op10_urls": rf"""
        WITH parts AS (
            SELECT page_id,
                CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
                CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
            FROM pages),
        ruled AS (SELECT *, CASE {when} END AS fits FROM parts)
        SELECT page_id, host, path, split_part(fits, '|', 1) AS rule,
            CASE WHEN fits IS NOT NULL THEN split_part(fits, '|', 2)
                WHEN regexp_matches(host, '{urls.LISTED}') THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled""",
        "op11_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
        p AS (
            SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score
            FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE label = anchor_label)
            WHERE r <= 5),
        n AS (
            SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
                row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS r
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
                AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
        SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 3""",
    }
