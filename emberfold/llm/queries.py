"""The queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from emberfold.llm import chat, classifier, decontaminate, extract, infill, jaccard_join, line_dedup, mixture, negatives, quality_rules, tokenfile, urls, warc
from emberfold.llm.common import prepare, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_probe(table(spark, sf_dir, "conversations"))
    return chat.digests(chat.conversations(rows))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = line_dedup.dedup(table(spark, sf_dir, "documents"), "lines_deleted")
    return deduped.select("doc_id", "lines_deleted", "text")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rate(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(table(spark, sf_dir, "documents"))


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # vocabulary files; only this query needs them

    return tokenfile.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(prepare(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (
        op1_decontamination, op2_source_mixing, op3_ngram_jaccard_join, op4_chat_formatting,
        op5_url_filters, op6_warc, op7_line_dedup,
        op8_quality_classifier, op9_quality_rules, op10_html_extraction,
        op11_hard_negatives, op12_fill_in_middle, op13_token_ids,
        pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mixing": mixture.ORACLE_SQL, "op4_chat_formatting": chat.ORACLE_SQL,
            "op6_warc": warc.ORACLE_SQL, "op11_hard_negatives": negatives.ORACLE_SQL,
            "op12_fill_in_middle": infill.ORACLE_SQL}
