"""One registered query an operator, over its whole table and with production parameters; SQL where it can say the same."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from takt.llm import centroids, collocations, embedding_dedup, mixing, packing, quality_classifier, quality_rules, secret_scan, sharding, simhash, token_files, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_subword_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.scored(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.measured(docs, bands=quality_rules.PROSE_BANDS, chunk_band=quality_rules.PROSE_CHUNK).drop("text")


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_cover_tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked(table(spark, sf_dir, "embeddings"))


def op5_stratified_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleaved(table(spark, sf_dir, "documents"))


def op6_url_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op7_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "full", "extra")


def op10_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written_tokens(table(spark, sf_dir, "documents"))


def op11_geometric_drift_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings")).drop("scans")


def op12_zstandard_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op13_collocation_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_subword_classifier, op2_quality_rules, op3_sum_of_squares_packing, op4_cover_tree_links, op5_stratified_interleaving, op6_url_sweep, op7_simhash_ball,
    op8_secret_scan, op9_sainte_lague_mix, op10_arrow_token_files,
    op11_geometric_drift_centroids, op12_zstandard_warc, op13_collocation_automata)}
ORACLE: dict[str, str] = {"op4_cover_tree_links": embedding_dedup.ORACLE, "op6_url_sweep": url_filter.ORACLE,
                          "op11_geometric_drift_centroids": centroids.ORACLE, "op12_zstandard_warc": warc.ORACLE,
                          "op13_collocation_automata": collocations.ORACLE}
