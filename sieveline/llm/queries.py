"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import centroids, class_lm, decontamination, language_id, mixing, near_dedup, packing, quality_classifier, quality_rules, substring_dedup, topk, toxicity
from .common import table


def op1_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_report(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_class_lm(spark, sf_dir):
    return class_lm.score(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_decontamination(spark, sf_dir):
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_centroid_clustering(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_minhash_near_dedup, op3_best_fit_packing, op4_substring_dedup, op5_source_mixing, op6_quality_rules, op7_exact_top_k, op8_quality_classifier, op9_language_id, op10_class_lm, op11_decontamination, op12_centroid_clustering)}
ORACLES = {
    "op2_minhash_near_dedup": near_dedup.ORACLE,
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op5_source_mixing": mixing.ORACLE,
    "op7_exact_top_k": topk.ORACLE,
    "op11_decontamination": decontamination.ORACLE,
    "op12_centroid_clustering": centroids.ORACLE,
}
