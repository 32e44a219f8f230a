"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import automaton, decontaminate, html, line_dedup, mixing, periodic, perplexity, quality, records, simhash, suffix_array, toxicity, vector_codes
from veilspark.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.write_and_read(table(spark, sf_dir, "documents"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.report(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op8_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.report(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.report(table(spark, sf_dir, "pages"))


def op10_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.report(table(spark, sf_dir, "documents"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(table(spark, sf_dir, "embeddings"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_records": op3_records,
    "op4_suffix_array": op4_suffix_array,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_perplexity": op8_perplexity,
    "op9_html": op9_html,
    "op10_automaton": op10_automaton,
    "op11_periodic": op11_periodic,
    "op12_vector_codes": op12_vector_codes,
    "op13_line_dedup": op13_line_dedup,
}
