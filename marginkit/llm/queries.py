"""The registered queries of this subpackage: thin wrappers that derive the result columns
from each operator's own output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, katz, language, mixing, near_dup, pii, posting_lists, prefix_trie, quality, spelling, url_rules, warc
from .common import fold, materialise, read

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"),
             ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return (quality.clean_lines(docs, keep=["doc_id"], with_text=False)
            .select(F.col("_row.doc_id").alias("doc_id"), *quality.COUNTS, "base_failed", "kept"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.train(read(spark, sf_dir, "documents").select("text", "lang"))
    return language.identify(read(spark, sf_dir, "pages").select("page_id", "url", "html"), model)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.page_records(spark, folder)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read(spark, sf_dir, "pages").select("page_id", "html"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("digest", "class")


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    docs = read(spark, sf_dir, "documents").select("doc_id", (crc % 5 == 1).alias("held_out"), "text")
    return katz.score_corpus(docs)


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(read(spark, sf_dir, "documents").select("doc_id", "text"), count="n_entities")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.find_hits(docs, read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontaminate.judge(hits).select(F.col("_row.doc_id").alias("doc_id"), "n_words", "n_hit", "n_items",
                                            "items_sha256", "contaminated")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.letter_runs(read(spark, sf_dir, "documents").select("doc_id", "text"), least=7)
    run = fold("run")
    h = F.crc32(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (F.col("_h") % F.length("_run")).cast("int")
    spoilt = F.concat(F.col("_run").substr(F.lit(1), at), F.col("_run").substr(at + 2, F.length("_run")))
    words = runs.select(run.alias("_run"), h.alias("_h")).select(F.when(F.col("_h") % 31 == 0, spoilt).otherwise(F.col("_run")).alias("word"))
    return spelling.variant_groups(materialise(spelling.vocabulary(words, least_length=7, least_count=2), "vocabulary"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    talk = materialise(prefix_trie.conversations(talk), "conversations")
    nodes = prefix_trie.prefix_nodes(prefix_trie.with_common_head(talk, every=100, most=6))
    return nodes.withColumnRenamed("ends", "ends_sha256").drop("turn")


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = posting_lists.vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return posting_lists.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), 20)


QUERIES = (op1_quality_rules, op2_language, op3_warc, op4_html_text, op5_near_dup, op6_katz, op7_url_rules, op8_mixing,
           op9_pii, op10_decontaminate, op11_spelling, op12_prefix_trie, op13_neighbours)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
