"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shoebox.llm import bpe, crf, decontam, forest, licences, pii, prefixtrie, quotes, rankedsearch, sketch, template, trietokens, urlrules
from shoebox.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_lsh_forest(spark, sf_dir):
    return forest.near_groups(table(spark, sf_dir, "documents"))


@query
def op9_chunked_bpe(spark, sf_dir):
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


@query
def op8_crf_language(spark, sf_dir):
    return crf.label_documents(table(spark, sf_dir, "documents"))


@query
def op7_prefix_decontamination(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op1_quote_threads(spark, sf_dir):
    return quotes.reply_order(table(spark, sf_dir, "conversations"))


@query
def op2_scaled_sketch(spark, sf_dir):
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


@query
def op3_url_rules(spark, sf_dir):
    return urlrules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query
def op4_trie_tokens(spark, sf_dir):
    return trietokens.token_counts(table(spark, sf_dir, "documents"))


@query
def op5_licence_scan(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


@query
def op6_site_templates(spark, sf_dir):
    return template.extract(table(spark, sf_dir, "pages"))


@query
def op12_prefix_tree(spark, sf_dir):
    return prefixtrie.prefix_tree(table(spark, sf_dir, "conversations"))


@query
def op13_term_pipeline(spark, sf_dir):
    return rankedsearch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_weak_pii(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))
