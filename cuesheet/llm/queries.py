"""The registered queries of the operators: name -> (function of session and folder, DuckDB statement or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuesheet.llm import decontaminate, html_text, licenses, neighbours, packing, prefix_trie, quality, simhash, spelling, substring, suffix_tree, toxicity, warc
from cuesheet.llm.common import read


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": (pipeline, None),
    "op4_quality_classifier": (op4_quality_classifier, None),
    "op6_simhash": (op6_simhash, None),
    "op7_license_scan": (licenses.query, licenses.SQL),
    "op10_decontaminate": (decontaminate.query, None),
    "op1_near_duplicates": (neighbours.query, neighbours.SQL),
    "op5_html_text": (html_text.query, None),
    "op2_suffix_tree": (suffix_tree.query, None),
    "op9_substring_dedup": (substring.query, substring.SQL),
    "op8_warc": (warc.query, warc.SQL),
    "op11_spelling_variants": (spelling.query, spelling.SQL),
    "op12_prefix_trie": (prefix_trie.query, prefix_trie.SQL),
    "op13_toxicity": (toxicity.query, None),
    "op3_best_fit_packing": (op3_best_fit_packing, None),
}
