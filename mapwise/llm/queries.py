"""The operators as queries over the given tables, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mapwise.llm import decontamination, importance, language, line_dedup, mixing, near_duplicates, neighbours, quality, repeats, runs, token_counts, token_files, url_filters
from mapwise.plans.session import shared_dir

#: Tokenizer files, which must be on every executor under the same path.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op1_language_crf(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(_table(spark, folder, "documents"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.rate_documents(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, folder, "documents"), words=4, percent=80)


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    target = shared_dir(spark, "token-files")
    token_files.write_tokens(_table(spark, folder, "documents"), target, TOKENIZER)
    return token_files.read_tokens(spark, target)


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op7_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, folder, "documents"))


def op8_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(_table(spark, folder, "embeddings"))


def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filters.filter_urls(_table(spark, folder, "pages"), url_filters.rules_frame(spark))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.repeated_lines(_table(spark, folder, "documents"))


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, folder, "documents"), BYTE_TOKENIZER)


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.collapse_runs(_table(spark, folder, "documents"), tail=runs.periodic_tail)
    return found.drop("n_words")


QUERIES = {
    "op13_periodic_runs": op13_periodic_runs,
    "op12_token_counts": op12_token_counts,
    "op11_importance_resampling": op11_importance_resampling,
    "op10_line_dedup": op10_line_dedup,
    "op4_url_filters": op4_url_filters,
    "op8_nearest_vectors": op8_nearest_vectors,
    "op7_repeated_passages": op7_repeated_passages,
    "op9_decontamination": op9_decontamination,
    "op1_language_crf": op1_language_crf,
    "op5_quality": op5_quality,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_token_files": op3_token_files,
    "op6_mix_sources": op6_mix_sources,
}

SQL = {
    "op13_periodic_runs": runs.RUNS_SQL,
    "op11_importance_resampling": importance.RESAMPLE_SQL,
    "op4_url_filters": url_filters.URL_SQL,
    "op6_mix_sources": mixing.MIX_SQL,
}
