"""The queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgrid.llm import exact_dedup, hilbert_ann, html_main, mixing, packing, quality, simhash, substring_dedup, tokens, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(_documents(spark, sf_dir))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit that goes, and the document that keeps it."""
    return substring_dedup.removed_units(_documents(spark, sf_dir)).drop("uid")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir)).drop("uid")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_quality": op3_quality,
    "op4_pack": op4_pack,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_toxicity": op7_toxicity,
    "op8_html_main_text": op8_html_main_text,
    "op9_token_counts": op9_token_counts,
    "op10_exact_dedup": op10_exact_dedup,
    "pipeline": pipeline,
}

ORACLES = {
    "op1_mix_sources": f"""
        WITH s AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {mixing.ALPHA}) AS w FROM documents GROUP BY source),
             r AS (SELECT source, w / (SELECT sum(w) FROM s) * (SELECT sum(n) FROM s) / n AS rate FROM s),
             p AS (SELECT source, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS j, rate FROM r),
             c AS (SELECT source, j, sum(exp(-rate + j * ln(rate) - lgamma(j + 1))) OVER (PARTITION BY source ORDER BY j) AS cdf FROM p),
             l AS (SELECT source, list(cdf) AS cdf FROM c GROUP BY source),
             d AS (SELECT d.*, ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, '')))), 1, 13))::BIGINT / pow(2, 52) AS u, l.cdf
                   FROM documents d JOIN l ON d.source IS NOT DISTINCT FROM l.source)
        SELECT doc_id, text, lang, source, n_chars, unnest(range(1, len(list_filter(cdf, lambda x: x <= u)) + 1))::INTEGER AS copy FROM d""",
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
