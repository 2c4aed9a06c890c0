"""The registered queries of the training-data operators and, where SQL can express one, its oracle."""

from __future__ import annotations

from . import common, decontaminate, html_extract, quality_nbsvm, quality_rules, sentencepiece_codec, simhash_vptree, suffix_dedup, token_counts, toxicity_cnn, url_filter


def op1_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.digests(common.texts(spark, sf_dir, "documents"))


def op2_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(common.texts(spark, sf_dir, "documents"))


def op3_html_extract(spark, sf_dir):
    return html_extract.extract(common.texts(spark, sf_dir, "pages"))


def op4_simhash(spark, sf_dir):
    return simhash_vptree.near_duplicates(common.texts(spark, sf_dir, "documents"))


def op5_decontaminate(spark, sf_dir):
    docs, benchmark = common.texts(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    return decontaminate.digests(decontaminate.decontaminate(docs, benchmark))


def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digests(common.texts(spark, sf_dir, "documents"))


def op7_url_filter(spark, sf_dir):
    return url_filter.filter_urls(common.table(spark, sf_dir, "pages"))


def op8_quality(spark, sf_dir):
    return quality_nbsvm.score_quality(common.texts(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op9_token_counts(spark, sf_dir):
    return token_counts.token_counts(common.texts(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity_cnn.score_toxicity(common.texts(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_quality_rules, op3_html_extract, op4_simhash, op5_decontaminate, op6_suffix_dedup, op7_url_filter, op8_quality, op9_token_counts, op10_toxicity)}
ORACLES = {"op7_url_filter": url_filter.ORACLE_SQL}
