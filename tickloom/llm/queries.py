"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import (
    chat,
    decontaminate,
    html,
    lines,
    mixing,
    neighbours,
    periods,
    phrases,
    pieces,
    quality,
    secrets,
    simhash,
    toxicity,
)
from tickloom.llm.base import LLM_QUERIES, llm_query
from tickloom.llm.text import bucket_of
from tickloom.session import tune

__all__ = ["LLM_QUERIES"]

EXTRA_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


@llm_query("op1_decontaminate")
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaked_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@llm_query("op2_html_extract")
def op2_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract_pages(table(spark, folder, "pages"))


@llm_query("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "n_chars")
    return lines.dedup_lines(docs)


@llm_query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit_quality(docs, table(spark, folder, "labels"))
    keep = [F.col("doc_id"), (bucket_of(F.col("doc_id")) == 0).alias("held_out")]
    return quality.score_quality(docs, model, keep, F.col("text"))


@llm_query("op5_chat_format", chat.SQL)
def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    rows = given.unionByName(spark.createDataFrame(EXTRA_TURNS, given.schema))
    return chat.digests(chat.format_conversations(rows))


@llm_query("op6_toxicity_cnn")
def op6_toxicity_cnn(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = toxicity.score_toxicity(docs, labels, toxicity.fit_toxicity(docs, labels))
    return scored.select(
        "doc_id", (bucket_of(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", "lang", "threshold", "flagged"
    )


@llm_query("op7_nearest_neighbours")
def op7_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@llm_query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(table(spark, folder, "documents")))


@llm_query("op9_simhash_dedup")
def op9_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), words=3, form=simhash.Form(lanes=1, radius=2, first=2))


@llm_query("op10_source_mix", mixing.SQL)
def op10_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@llm_query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    text = periods.planted(F.col("doc_id"), F.col("text"))
    return periods.digests(periods.find_runs(table(spark, folder, "documents"), [F.col("doc_id")], text))


@llm_query("op12_phrase_collocations", phrases.SQL)
def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"), F.col("lang"), F.col("text"))


@llm_query("op13_sentencepiece_chunks")
def op13_sentencepiece_chunks(spark: SparkSession, folder: str) -> DataFrame:
    model = pieces.read_model()
    encoded = pieces.encode(table(spark, folder, "documents"), [F.col("doc_id")], F.col("text"), model)
    return pieces.digests(pieces.decode(encoded, model))
